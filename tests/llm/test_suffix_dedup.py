"""Removal of repeated strings against a brute-force count of all of them."""

import hashlib
import random
from collections import Counter

import pytest

from creditflow.llm import queries, suffix_dedup


def brute(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(raw[p : p + length] for _, raw in texts for p in range(len(raw) - length + 1))
    out = []
    for i, raw in texts:
        gone, end = bytearray(len(raw)), 0
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                end = p + length
                gone[p:end] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + gone, strict=False))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus(seed):
    """Near copies, shared passages of all lengths, own texts, and odd ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9)))
    words = lambda n: [word() for _ in range(n)]
    base = [words(200) for _ in range(5)]
    rows = []
    for i in range(120):
        own = list(rng.choice(base))
        if i % 4 == 0:
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = word()
        elif i % 4 == 1:
            text = " ".join(own)
            a = rng.randrange(len(text))
            own = [*words(60), text[a : a + rng.randint(150, 600)], *words(60)]
        elif i % 4 == 2:
            own = words(rng.randint(0, 200))
        rows.append((i, " ".join(own)))
    odd = [None, "", "x", "a" * 1000, "ab" * 150, "a" * 199, "a" * 200 + "b" + "c" * 200, "word " * 3000, "\x00" * 250 + "z", "\x00" * 250 + "zz", rows[0][1]]
    return [*rows, *((200 + i, t) for i, t in enumerate(odd)), (207, "word " * 3000), (None, rows[3][1]), (None, rows[3][1]), (None, None)]


def result(df, **options):
    return Counter(tuple(r) for r in suffix_dedup.remove_repeats(df, **options).drop("kept").collect())


@pytest.mark.parametrize("options", [{}, {"group_rows": 20}, {"group_rows": 1}])
def test_equals_brute_force(spark, options):
    """Keys with many occurrences are counted another way; the results are the same."""
    rows = corpus(3)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, key string, at int, length int")
    assert result(df, **options) == brute(rows)


def test_other_lengths_and_pieces(spark, monkeypatch):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, length=150) == brute(rows, 150)
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)  # texts longer than a piece; this process alone sees it
    import numpy as np

    text = np.frombuffer(" ".join(t or "" for _, t in rows).encode(), dtype=np.uint8)

    def strings(stretches):
        out = set()
        for a, b in stretches:
            at, near, far, key = suffix_dedup.entries(text[a:b], np.array([0]), np.array([b - a]), 200)
            out |= {(x - e + a, e, k) for x, lo, hi, k in zip(at.tolist(), near.tolist(), far.tolist(), key.tolist(), strict=True) for e in range(lo, hi + 1)}
        return out

    cut = [(a, b) for part in suffix_dedup.pieces(np.array([len(text)]), 200) for _, a, b in part]
    assert len(cut) > 10 and strings(cut) == strings([(0, len(text))])
    assert sorted(p for p, _, _ in strings(cut)) == list(range(len(text) - 199))


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=100)


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in queries.op11_suffix_array_dedup(spark, sf).collect())
    assert got == brute(docs)
