"""Each operator against brute force or an exact round trip, and its edge cases."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from creditflow.llm import byte_bpe, embedding_dedup, jaccard_join, language_id, mixing, queries, sharding, token_counts, token_output, topk, warc
from creditflow.llm.components import components
from creditflow.llm.shared import scratch_path

P = pytest.importorskip("public_tokenizers")
LONG = "word " * 20_000 + "x" * 5_000
ODD = [None, "", " ", "  a  b ", "\n \n x", LONG, "same text here", "same text here", "<s> </s> <|endoftext|>", "é ß 中文 ▁ \x00 　 \x1c z", "THE the ThE"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, n long, key string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 0, 1, 2, 3, "k") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6], (None, "same text here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def closure(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_components(rows, width, percent):
    """(id, set size, component) by row; a row is a document of its own, a component has its smallest id."""
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    sets = [shingles(t, width) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sorted((rows[i][0], len(sets[i]), rows[t][0]) for i, t in enumerate(closure(len(rows), links)))


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 9), (5, 5), (7, 4), (None, 1)]
    got = {r["x"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 1, 8: 8, 9: 8, 5: 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, docs, odd, width, percent):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = [tuple(r) for r in jaccard_join.jaccard_components(df, width=width, percent=percent).collect()]
        assert sorted(x for x in got if x[0] is not None) == brute_components(rows, width, percent)
        assert [x[2] for x in got if x[0] is None] == [None] * sum(r[0] is None for r in rows)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_join_chains_that_no_pivot_links(spark):
    """A drifting chain: neighbours link, ends do not; every bucket holds pairs below the threshold."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([f"d{j}" for j in range(k * 2)] + base[k * 2 :]) for k in range(40)] + [" ".join(base[:60] + [f"z{k}_{i}" for i in range(60)]) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"head_rounds": 0, "extra": 0}, {"head_rounds": 1, "extra": 60}):
        got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df, width=3, percent=90, **options).collect())
        assert got == brute_components(list(enumerate(texts)), 3, 90)


def test_jaccard_join_of_dense_groups(spark):
    """Copies of one text with a few words changed, cut or added, copies of copies, and a passage that many share."""
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(150)]
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for k in range(260):
        own = list(base)
        for j in rng.choice(150, rng.integers(0, 8), replace=False):
            own[j] = f"n{rng.integers(0, 400)}"
        if k % 9 == 0:
            own = own[: int(rng.integers(60, 150))]
        texts.append(" ".join(own))
    texts += [" ".join([*passage, *(f"u{k}_{i}" for i in range(rng.integers(0, 60)))]) for k in range(60)]
    rows = [(i // 2 if i % 7 == 0 else i, t) for i, t in enumerate([*texts, *texts[:50]])]  # ids repeat, with other texts too
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 90), (5, 80), (2, 60)):
        got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df, width=width, percent=percent).collect())
        assert got == brute_components(rows, width, percent)


def test_jaccard_join_with_a_repeated_id(spark):
    """Two texts of one id are two documents: what is like the one is not like the other."""
    words = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(1, words("a")), (1, words("b")), (1, words("b")), (2, words("a") + " end"), (3, words("b") + " end"), (0, words("b") + " z")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gone string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df, width=3, percent=90).collect())
    assert got == brute_components(rows, 3, 90)
    kept = sorted((r["doc_id"], r["text"][0]) for r in jaccard_join.keep_first(df, width=3, percent=90).collect())
    assert kept == [(0, "b"), (1, "a")]


def test_keep_first(spark, odd):
    kept = jaccard_join.keep_first(odd)
    assert kept.columns == odd.columns
    assert sum(r["text"] == "same text here" and r["doc_id"] is not None for r in kept.collect()) == 2  # the kept id's repeated row stays


def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 16))
    tight = x[0] + 0.02 * rng.standard_normal((60, 16))
    loose = x[1] + 0.28 * rng.standard_normal((60, 16))
    rows = [(i, v.astype("float32").tolist()) for i, v in enumerate(np.vstack([x, tight, loose, x[2:6]]))]
    n = len(rows)
    return [*rows, (n, None), (n + 1, [0.0] * 16), (n + 2, [math.nan] * 16), (n + 3, [None] + [1.0] * 15), (n + 4, []), (n + 5, [math.inf] + [1.0] * 15), (n + 6, [-0.0] + [1.0] * 15), (n + 7, [0.0] + [1.0] * 15), (n + 8, [1.0] * 3)]


def test_embedding_near_dedup(spark):
    rows = vectors(spark)
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, passes=24, block=32).collect()}
    unit = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, "float32").astype("float64")
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a, b in combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    count = Counter(x for p in links for x in p)
    top = closure(len(rows), links)
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i, _ in rows)
    assert found >= 0.97 * 2 * len(links)
    assert all(got[i]["n_links"] <= count[i] for i, _ in rows)
    assert sum(got[i]["component_id"] == top[i] for i, _ in rows) >= 0.97 * len(rows)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i, _ in rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def planted_pairs(n, dim, cosine, seed=9):
    """n vectors spread in all directions, each with one that has this cosine with it."""
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return np.vstack([x, cosine * x + math.sqrt(1 - cosine**2) * y])


@pytest.mark.parametrize("n", [1000, 8000])
def test_embedding_recall_of_the_query(spark, tmp_path, n):
    """The registered query with its own parameters: lone pairs just over the threshold are found at any size."""
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(planted_pairs(n, 64, 0.905))], "vec_id long, embedding array<float>, node string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op4_embedding_near_dedup(spark, str(tmp_path)).collect()
    right = [r for r in rows if r["n_links"] == 1 and r["component_id"] == r["vec_id"] % n]
    assert len(rows) == 2 * n and all(r["n_links"] <= 1 for r in rows) and len(right) >= 0.95 * 2 * n
    few, many = (embedding_dedup.passes_for(n, 0.9, 32, 0.99) for n in (2_000, 10_000_000))
    assert few <= 16 and many > 70


def test_embedding_repeated_and_null_ids(spark):
    e1, e2 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, e1), (1, e2), (2, [1.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.1]), (None, e1), (4, e2), (5, [0.0, 0.0, 1.0])]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id IS NOT NULL").collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True)]


def test_components_of_a_long_chain(spark):
    n = 400  # 0, n-1, n-2, ..., 1
    links = [(0, n - 1), *[(i, i - 1) for i in range(n - 1, 1, -1)]]
    got = components(spark.createDataFrame([*links, (1000, 1001), (1001, 1001)], "a long, b long")).collect()
    assert Counter(tuple(r) for r in got) == Counter([*[(i, 0) for i in range(n)], (1000, 1000), (1001, 1000)])


def test_top_k_equals_brute_force(spark, sf):
    rows = [r for r in vectors(spark) if r[1] is None or len(r[1]) != 3]
    df = spark.createDataFrame([*rows, rows[5], (None, [1.0] * 16)], "vec_id long, embedding array<float>")
    ints = topk.integer_weights(df)
    good = [(r["vec_id"], np.array(r["weights"])) for r in ints.collect() if r["weights"]]
    for options in ({}, {"shard_rows": 20, "query_rows": 3}):
        got = defaultdict(list)
        for r in sorted(topk.top_k(ints, ints.where("vec_id % 10 = 0"), k=7, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got[r["query_id"]].append((r["score"], r["vec_id"]))
        for q, v in good:
            if q % 10 == 0:
                assert got[q] == sorted(((int(v @ w), i) for i, w in good if i != q), key=lambda x: (-x[0], x[1]))[:7]
    assert topk.top_k(ints.limit(0), ints.limit(0)).count() == 0


def test_top_k_with_queries_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-9, 9, (0, 3, 16, 16)[i % 4]).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, weights array<long>").coalesce(1)
    got = defaultdict(list)
    for r in sorted(topk.top_k(df, df, k=5).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for q, v in rows:
        assert got[q] == sorted(((int(np.dot(v, w)), i) for i, w in rows if v and i != q and len(v) == len(w)), key=lambda x: (-x[0], x[1]))[:5]


def test_sharding(spark, docs, odd):
    for df, shards in ((docs, 40), (odd, 3), (docs.limit(0), 5), (docs.union(docs.limit(1)), 7)):
        rows = sharding.shard_documents(df, shards=shards).collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(i, [])) for i in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))


def test_sharding_moves_little(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text")
    for epsilon, most in ((0.25, 0.35), (0.0, 0.75)):
        a = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, shards=10, epsilon=epsilon).collect()}
        b = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, shards=11, epsilon=epsilon).collect()}
        assert max(Counter(a.values()).values()) <= math.ceil((1 + epsilon) * 600) and 1 / 11 - 0.05 < sum(a[i] != b[i] for i in a) / 6000 < most


def test_mixing(spark, docs, odd):
    for df in (docs, odd, docs.limit(0)):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        words = {(r["doc_id"], r["source"]): len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect()}
        assert sorted(r["size"] for r in rows) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect())
        assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in rows)
        if df is docs:
            by = defaultdict(lambda: [0, 0, 0])
            for (i, s), n in words.items():
                r = next(x for x in rows if x["doc_id"] == i)
                by[s][0] += r["taken"]
                by[s][1] = r["target"]
                by[s][2] = max(by[s][2], n)
            assert all(abs(t - want) <= most / 2 + 1 for t, want, most in by.values())
            assert abs(sum(x[1] for x in by.values()) - 1.5 * sum(words.values())) < 1e-6 * sum(words.values())


def test_water_fill_equals_rounds_of_clamping(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 1, "e": 400, "f": 0, None: 90}
    got = {r["source"]: r["target"] for r in mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2).collect()}
    order = [*sorted(x for x in sizes if x is not None), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        left -= sum(2 * sizes[s] for s in over)
        free = free - over if over else set()
    assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-6 for s in got)


def test_token_counts(spark, docs, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for df in (docs, odd, docs.limit(0)):
        got = Counter(tuple(r) for r in token_counts.count_tokens(df, P.path("piece_bpe_32k.model")).collect())
        texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        assert got == Counter((i, len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts)


def test_byte_bpe(spark, docs, odd):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, odd, docs.limit(0)):
        rows = byte_bpe.encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
        want = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in df.collect())
        assert Counter((r["doc_id"], struct.unpack(f"<{r['n_tokens']}I", r["ids"]), bytes(r["decoded"])) for r in rows) == want


def test_token_orc(spark, docs, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for df in (docs, odd, docs.limit(0)):
        path = scratch_path(spark, "orc")
        token_output.write_orc(df, path, P.path("byte_bpe_50k.json"), P.PATTERN, bytes_per_file=50_000)
        back = token_output.read_orc(spark, path)
        rows = sorted(token_output.with_crc32(back).collect(), key=lambda r: r["start"])
        want = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in df.collect()]
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in want)
        start = 0
        for r in rows:
            assert r["start"] == start
            start += r["n_tokens"]
        assert [r["doc_id"] for r in rows if r["doc_id"] is not None] == sorted(i for i, _ in want if i is not None)
        again = token_output.read_orc(spark, path, files_per_block=3)
        assert Counter(again.select("doc_id", "start").collect()) == Counter((r["doc_id"], r["start"]) for r in rows)
    plan = back.where("doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    twin = "z" * 1000
    extra = [(900, "u\r\nv", twin), (901, None, twin), (902, "u", twin[1:]), (903, "u", twin[1:]), (904, "u", None), (905, "u", ""), (None, "u", twin), (906, "u", "é" * 500), (907, "u", "é" * 500), (901, "again", twin)]
    pages = pages.union(spark.createDataFrame(extra, pages.schema)).withColumn("digest", pages.url).withColumn("first", pages.page_id)
    for words in (None, b""):
        archives = warc.write_archives(pages, dictionary=words, file_bytes=30_000)
        rows = warc.read_archives(spark, archives, chunk=1000).collect()
        assert archives.agg({"records": "sum"}).first()[0] == len(rows) == pages.count()
        responses = {r["record_id"]: bytes(r["payload"]) for r in rows if r["record_type"] == "response"}
        html = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
        assert Counter((r["record_id"], r["payload_bytes"], r["payload_digest"]) for r in rows) == Counter((i, len(b), hashlib.sha1(b).hexdigest()) for i, b in html)
        kinds = {(r["record_id"], r["payload_digest"]): (r["record_type"], r["refers_to"]) for r in rows}
        best = {}
        for i, b in html:
            best[b] = max(best.get(b, -1), -1 if i is None else i)
        for i, b in html:
            revisit = len(b) >= 1000 and best[b] != -1 and i != best[b]
            assert kinds[i, hashlib.sha1(b).hexdigest()] == (("revisit", best[b]) if revisit else ("response", None))
            assert revisit or i is None or responses[i] == b
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_warc_frames_stand_alone(spark, sf, tmp_path):
    import zstandard

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    big = pages.union(pages.selectExpr("page_id + 10000", "url", "concat(html, page_id)"))
    archives = warc.write_archives(big, path=f"file://{tmp_path}/w", dictionary=warc.train_dictionary(warc.classify(big, 1000), size=4096))
    path = archives.first()["path"].removeprefix("file://")
    raw = open(path, "rb").read()
    magic, n = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and n > 1000
    words = zstandard.ZstdCompressionDict(raw[8 : 8 + n])
    at = warc.read_archives(spark, archives.limit(1)).select("offset").collect()[3]["offset"]
    assert zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(raw[at:]).startswith(b"WARC/1.1\r\n")


def test_warc_always_has_a_dictionary_of_records(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert len(warc.train_dictionary(warc.classify(pages, 1000))) > 4096
    for few in (pages.limit(1), pages.limit(3), spark.createDataFrame([(1, None, None)], pages.schema)):
        words = warc.train_dictionary(warc.classify(few, 1000))
        assert words and (b"WARC" in words or len(words) >= 256)
        back = warc.read_archives(spark, warc.write_archives(few)).collect()
        assert Counter((r["record_id"], bytes(r["payload"])) for r in back) == Counter((r["page_id"], (r["html"] or "").encode()) for r in few.collect())
    assert warc.train_dictionary(warc.classify(pages.limit(0), 1000)) == b""


def test_orc_files_have_stripes_indexes_and_filters(spark, tmp_path):
    from pathlib import Path

    from pyarrow import orc

    docs = spark.range(0, 24_000, 1, 4).selectExpr("id * 2 AS doc_id", "concat('word ', id, ' ', md5(string(id)), md5(string(id + 1)), md5(string(id + 2))) AS text")
    path = f"file://{tmp_path}/o"
    token_output.write_orc(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN, stripe_bytes=1 << 18)
    files = [orc.ORCFile(f) for f in Path(tmp_path, "o").glob("*.orc")]
    assert sum(f.nrows for f in files) == 24_000 and all(f.nstripes > 1 and f.row_index_stride == 1000 and f.compression == "ZSTD" for f in files)
    raw = Path(next(Path(tmp_path, "o").glob("*.orc"))).read_bytes()
    assert len(raw) < 0.75 * 4 * sum(r["n_tokens"] for r in spark.read.orc(path).select("n_tokens").collect())  # run-length and compression
    found = spark.read.schema(token_output.SCHEMA).orc(path).where("doc_id = 24002")
    assert len(found.collect()) == 1

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().head()
        return plan.metrics().get("numOutputRows").get().value()

    assert scanned(found) <= 2000 and scanned(found.where("doc_id = 24002")) <= 2000
    assert scanned(spark.read.schema(token_output.SCHEMA).orc(path).where("doc_id = 24003")) == 0  # between two ids: the Bloom filter


def test_sharding_equals_a_ring_walked_by_hand(spark):
    from pyspark.sql import functions as F

    shards, replicas, cells, seed = 5, 4, 64, 20240101
    df = spark.range(400).selectExpr("id AS doc_id", "repeat('x', int(id % 7)) AS text")
    for epsilon in (0.0, 0.3):
        got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, shards=shards, replicas=replicas, cells=cells, epsilon=epsilon).collect()}
        at = {r["id"]: r["at"] for r in spark.range(400).select("id", F.xxhash64(F.lit(seed), "id").alias("at")).collect()}
        spots = spark.range(shards * replicas).select((F.col("id") % shards).alias("s"), F.pmod(F.xxhash64(F.lit(seed), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(cells)).alias("c"))
        nodes = [(r["s"], r["c"]) for r in spots.collect()]
        ties = spark.range(cells * shards).select((F.col("id") % shards).cast("int").alias("s"), F.floor(F.col("id") / shards).cast("int").alias("g"))
        tie = {(r["s"], r["g"]): r["t"] for r in ties.select("s", "g", F.xxhash64(F.lit(seed), "s", "g").alias("t")).collect()}
        turns = [r["c"] for r in spark.range(cells).select(F.col("id").cast("int").alias("c")).orderBy(F.xxhash64(F.lit(seed), "c")).collect()]
        room = [int((1 + epsilon) * 400 / shards)] * shards
        want = {}
        for cell in turns:
            gaps = sorted((g, tie[s, g], s) for s in range(shards) for g in [min((c - cell) % cells for x, c in nodes if x == s)])
            for i in sorted((i for i in at if at[i] % cells == cell), key=lambda i: at[i]):
                want[i] = next(s for _, _, s in gaps if room[s])
                room[want[i]] -= 1
        assert got == want


def test_language_model_equals_plain_kneser_ney(spark):
    import pandas as pd

    words = {"x": ["the", "then", "other", "tea", "tea", "ate", "heat"], "y": ["der", "die", "das", "tee", "erde", "rede"]}
    order, n = 4, Counter()
    for lang, ws in words.items():
        for w in ws:
            s = language_id.START * (order - 1) + w + language_id.END
            n.update((lang, s[i : i + order]) for i in range(len(w) + 1))
    model = language_id.build(pd.DataFrame([(*k, v) for k, v in n.items()], columns=["lang", "gram", "n"]), order)
    counts = {order: n}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter((lang, g[1:]) for lang, g in counts[k + 1])
    characters = len({g for _, g in counts[1]}) + 1

    def p(lang, gram):
        if not gram:
            return 1 / characters
        own = {g: c for (x, g), c in counts[len(gram)].items() if x == lang}
        ones, twos = (sum(c == i for c in own.values()) for i in (1, 2))
        d = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
        after = {g: c for g, c in own.items() if g[:-1] == gram[:-1]}
        if not after:
            return p(lang, gram[1:])
        return (max(after.get(gram, 0) - d, 0) + d * len(after) * p(lang, gram[1:])) / sum(after.values())

    for gram in ["\x02the", "them", "tea\x03", "\x02\x02de", "zzzz", "erde", "eede", "ther"]:
        got = model.characters(language_id._codes(gram), np.array([order - 1]), order)[0]
        assert np.allclose(np.exp(got), [p(lang, gram) for lang in model.languages], rtol=1e-4), gram


def test_language_id(spark, docs, odd):
    fold = language_id.fold(docs["doc_id"])
    model = language_id.train(docs.where(fold != 1))
    rows = {r["doc_id"]: r for r in language_id.predict(docs, model, extra=["lang"]).withColumn("held", fold == 1).collect()}
    held = [r for r in rows.values() if r["held"] and r["lang"] and r["n_letters"] > 20]
    assert len(held) > 30 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert sum(r["rejected"] for r in held) <= 0.02 * len(held)
    got = {r["text"]: r for r in language_id.predict(odd, model, extra=["text"]).collect()}
    for t in (None, "", " "):
        assert (got[t]["lang_pred"], got[t]["score"], got[t]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    noise = spark.createDataFrame([(1, " ".join(["qxzvkjq wqzxkvj"] * 30))], "doc_id long, text string")
    assert language_id.predict(noise, model).first()["rejected"]
    assert language_id.train(docs.limit(0)) is None
    assert language_id.predict(docs.limit(2), None).first()["lang_pred"] == "und"


def test_every_label_is_learned(spark):
    names = [f"l{i}" for i in range(700)]
    rows = spark.createDataFrame([(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} " * 12, x) for i, x in enumerate(names)], "doc_id long, text string, lang string")
    assert sorted(language_id.train(rows, calibrate=0).languages) == sorted(names)


def test_sample_is_bounded_where_an_id_repeats(spark):
    rows = spark.range(20_000).selectExpr("id", "concat('text ', id) AS text", "'x' AS lang").cache()
    plain = language_id.sample(rows, 70)
    assert 30 < plain.count() < 140
    hot = plain.first()["id"]  # an id that the draw takes
    many = rows.where("id >= 6000").unionByName(rows.where("id < 6000").withColumn("id", F.lit(hot)))
    assert 100 < language_id.sample(many, 70).count() < 250
    equal = rows.where("id >= 6000").unionByName(rows.where("id < 6000").select(F.lit(hot).alias("id"), F.lit("same").alias("text"), "lang"))
    assert 20 < language_id.sample(equal, 70).count() < 150
    rows.unpersist()


def test_language_id_rejects_on_workers_that_calibrated(spark, docs):
    model = language_id.train(docs.repartition(16))
    noise = spark.range(0, 320, 1, 16).selectExpr("id AS doc_id", f"'{' '.join(['qxzvkjq wqzxkvj'] * 30)}' AS text")
    assert language_id.predict(noise, model).where("rejected").count() == 320


def test_language_model_is_a_distribution(spark):
    import pandas as pd

    n = Counter()
    for word in ["the", "then", "other", "tea", "ate", "heat"]:
        s = language_id.START * 3 + word + language_id.END
        for i in range(len(word) + 1):
            n["x", s[i : i + 4]] += 1
    model = language_id.build(pd.DataFrame([(*k, v) for k, v in n.items()], columns=["lang", "gram", "n"]))
    chars = sorted({g[-1] for _, g in n}) + ["?"]
    for context in ("\x02\x02\x02", "\x02th", "hea", "???"):
        codes = language_id._codes("".join(context + c for c in chars))
        assert abs(float(np.exp(model.characters(codes, np.arange(3, len(codes), 4), 4)).sum()) - 1) < 1e-5


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, sf)
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall()), name
