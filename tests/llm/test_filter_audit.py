"""The filter audit against plain Python over every document and every order, and against its SQL."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from creditflow.llm import filter_audit, queries

LONG = "word Wörd " * 20_000
TEXTS = [None, "", " \n\t", LONG, "same text", "same text", "A B C", "a b\x0bc d\x1ce", "x#y", "é" * 400, "Up UP up " * 100, "w " * 250, "q" * 9000 + " " + "q" * 9000, "中文 text 　 here"]


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def brute(docs, labels):
    out = Counter()
    shares = Counter()
    parts = set()
    for doc_id, text, lang in docs:
        words, distinct, capitals, characters, symbols = counts(text)
        copy = doc_id is not None and any(d is not None and d < doc_id and (t or "") == (text or "") for d, t, _ in docs)
        fails = {x for x, bad in zip("ABCDE", (words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * characters, symbols > 0, copy), strict=True) if bad}
        own = [(q, t) for d, q, t in labels if d is not None and d == doc_id]
        part = lang or ""
        parts.add(part)
        for order in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                key = (part, "".join(order), step)
                hit = x in fails
                out[*key, "redundant"] += hit and gone
                out[*key, "removed"] += hit and not gone
                out[*key, "unique_fails"] += fails == {x}
                out[*key, "good_lost"] += hit and not gone and any(q == 1 for q, _ in own)
                out[*key, "toxic_lost"] += hit and not gone and any(t == 1 for _, t in own)
                shares[part, x] += hit and not gone
                gone |= hit
                out[*key, "kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, "".join(o), s, *(out[p, "".join(o), s, n] for n in names), shares[p, o[s - 1]]) for p in parts for o in permutations("ABCDE") for s in range(1, 6))


def test_counts_equal_python(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r[0]: tuple(r)[1:] for r in filter_audit.text_counts(df, "text", ["doc_id"]).collect()}
    assert got == {i: counts(t) for i, t in rows}


def test_words_of_equal_hashes_are_compared(monkeypatch):
    """With a hash that tells nothing apart the counts stay right."""
    monkeypatch.setattr(filter_audit.Keys, "between", lambda self, a, b: np.zeros(len(a), dtype=np.uint64))
    texts = [b"a b a c", b"", b"long-word-one long-word-two long-word-one", b"x"]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    assert filter_audit.scan(data, offsets, filter_audit.byte_classes())["n_distinct"].tolist() == [3, 0, 2, 1]


def test_equals_brute_force(spark):
    """Nulls in every column, repeated rows and labels, ids that labels lack, clashing columns."""
    docs = [(i, t, (None, "en", "de")[i % 3]) for i, t in enumerate(TEXTS)] + [(None, "same text", "en"), (None, None, None), (4, "same text", "de"), (2, "Z", "en"), (99, LONG, "de")]
    labels = [(4, 1, None), (4, 0, 1), (5, 1, 1), (None, 1, 1), (1, None, 0), (500, 1, 1), (99, 1, 0)]
    df = spark.createDataFrame([(*d, 1, 2, "k") for d in docs], "doc_id long, text string, lang string, n int, fails int, part string")
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, lf)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)
    assert filter_audit.audit(df.limit(0), lf).count() == 0
    assert filter_audit.audit(df, lf.limit(0)).count() == 3 * 600


def test_fewer_filters(spark):
    df = spark.createDataFrame([(1, "a", "en"), (2, "B#", "en")], "doc_id long, text string, lang string")
    lf = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.audit(df, lf, {"C": "n_capitals > 0", "D": "n_symbols > 0"}).collect()))
    assert got == [("en", "CD", 1, 1, 1, 0, 0, 0, 0, 1), ("en", "CD", 2, 1, 0, 1, 0, 0, 0, 1), ("en", "DC", 1, 1, 1, 0, 0, 0, 0, 1), ("en", "DC", 2, 1, 0, 1, 0, 0, 0, 1)]
    with pytest.raises(ValueError):
        filter_audit.interactions(df, "AA")


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.op13_filter_audit(spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op13_filter_audit']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
