"""The pipeline's stages against brute force on a small table."""

import base64
import re
import struct
from collections import Counter

import pytest

import corpus_pipeline
from creditflow.llm import mixing
from creditflow.llm.shared import written
from tests.llm.test_operators import brute_components

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Documents of the folder and a few more; what every stage kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = docs.where("doc_id = 3").first()["text"]
    extra = [(9001, text, None, "src1", 1), (9002, text + " tail", "en", None, 1), (9003, None, "en", "src1", 0), (9004, "12 34 !!", None, "src2", 8), (9005, "", "de", "src2", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf), "test-stage"))
    return out


def test_columns(stages):
    assert [len(corpus_pipeline.STAGES), *[s.columns == stages[0].columns for s in stages[:4]]] == [4, True, True, True, True]


def test_language_keeps_clean_documents(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[:2])
    letters = {i for i, r in before.items() if re.search(r"[^\W\d_]", r["text"] or "")}
    assert set(after) <= letters and len(after) >= 0.98 * len(letters)
    assert all(r["text"] == before[i]["text"] and r["lang"] is not None and before[i]["lang"] in (None, r["lang"]) for i, r in after.items())


def test_near_duplicates_equal_brute_force(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    keep = {top for _, _, top in brute_components(rows, 5, 80)}
    assert Counter(r["doc_id"] for r in stages[2].collect()) == Counter(keep)


def test_mixture(stages):
    docs = {r["doc_id"]: r for r in stages[2].collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in docs.items()}
    taken = Counter(r["doc_id"] for r in stages[3].collect())
    assert set(taken) <= set(docs) and max(taken.values()) <= 2
    total = {}
    for i, r in docs.items():
        total[r["source"]] = total.get(r["source"], 0) + size[i]
    order = [*sorted(s for s in total if s is not None), *([None] if None in total else [])]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in over} if over else share
        left -= sum(2 * total[s] for s in over)
        free = free - over if over else set()
    for s in order:
        got = sum(size[i] * n for i, n in taken.items() if docs[i]["source"] == s)
        assert abs(got - target[s]) <= max(size[i] for i in docs if docs[i]["source"] == s) / 2 + 1


def test_mixture_takes_rows_without_id_as_the_mix_does(spark, stages, sf):
    rows = [(None if i % 4 == 0 else i // 2, " ".join(["w"] * (1 + i % 7) + [f"t{i}"]), "en", (None, "a", "b", "b")[i % 5 % 4], 1) for i in range(200)]
    docs = spark.createDataFrame(rows, stages[0].schema)
    got = corpus_pipeline.mixture(spark, docs, sf).collect()
    want = mixing.mix(docs, with_source=True).collect()
    sizes, wanted = Counter(), Counter()
    for r in got:
        sizes[r["doc_id"], r["source"], len(r["text"].split())] += len(r["text"].split())
    for r in want:
        wanted[r["doc_id"], r["source"], r["size"]] += r["taken"]
    assert sizes == +wanted and any(i is None for i, _, _ in sizes)
    assert max(Counter(r["text"] for r in got).values()) <= 2


def test_tokens_equal_the_library(stages):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    want = {i: library.encode_ordinary(t) for i, t in text.items()}
    rows = stages[4].collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in stages[3].collect())
    assert all(list(struct.unpack(f"<{r['n_tokens']}I", r["ids"])) == want[r["doc_id"]] for r in rows)


CLASHING = ["copy", "times", "more", "mixed_id", "score", "rejected", "gone", "row", "found", "words", "size", "turn", "key", "node", "a.b", "lang_pred"]


def test_stages_keep_clashing_and_reordered_columns(spark, stages, sf):
    docs = stages[0].limit(60)
    extra = spark.createDataFrame([(None, docs.where("doc_id = 3").first()["text"], "en", None, 1)], docs.schema)
    docs = docs.unionByName(extra).selectExpr(*[f"CAST(coalesce(doc_id, -1) AS STRING) AS `{c}`" for c in CLASHING], "text", "source", "doc_id", "n_chars", "lang")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, sf), "clash-stage")
        assert docs.columns == [*CLASHING, "text", "source", "doc_id", "n_chars", "lang"]
        rows = docs.collect()
        assert rows and all(r[c] == str(-1 if r["doc_id"] is None else r["doc_id"]) for r in rows for c in CLASHING)
        assert any(r["doc_id"] is None for r in rows), stage
    assert corpus_pipeline.tokens(spark, docs, sf).count() == docs.count()


def test_empty(spark, stages, sf):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "empty-stage")
        assert docs.count() == 0
