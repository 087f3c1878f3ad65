"""Cases at the edges of numbers and of groups: extreme components, overflowing scores, ids that very many rows have."""

from collections import Counter

import numpy as np
import pytest

from creditflow.llm import embedding_dedup, mixing, topk


def test_cosines_of_extreme_components(spark):
    """Very large and very small doubles neither overflow nor vanish."""
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e196]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [0.0, 1e300]), (6, [0.0, 5e-324]), (7, [0.0, 0.0]), (8, [-1e200, 1e150])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, threshold=0.9).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8)}


def test_scores_that_leave_64_bits_are_refused(spark):
    big = spark.createDataFrame([(1, [1e17, 1.0]), (2, [1e17, 2.0])], "vec_id long, embedding array<double>")
    rows = topk.integer_weights(big)
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(rows, rows, k=1).collect()
    fits = topk.integer_weights(spark.createDataFrame([(1, [1e5, 1.0]), (2, [1e5, 2.0])], "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in topk.top_k(fits, fits, k=1).collect()) == [(1, 1, 2, (1024 * 10**5) ** 2 + 2 * 1024**2), (2, 1, 1, (1024 * 10**5) ** 2 + 2 * 1024**2)]


def walked(rows):
    """(id, size, taken) by a plain walk along each source's order, equal rows one after another."""
    import hashlib
    import re

    sized = [(i, src, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))) for i, text, src in rows]
    totals = Counter()
    for _, src, n in sized:
        totals[src] += n
    names = sorted(totals, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    free, heavy, target = 1.5 * sum(totals.values()), sum(weight.values()), {}
    for x in sorted(names, key=lambda x: (2 * totals[x] / weight[x], x is None, x or "")):
        target[x] = min(2.0 * totals[x], free / heavy * weight[x])
        free, heavy = free - target[x], heavy - weight[x]
    out = []
    for x in names:
        whole, before = int(target[x] // totals[x]) if totals[x] else 0, 0
        key = lambda r: (hashlib.md5("-".join(["17", *([] if r[0] is None else [str(r[0])])]).encode()).hexdigest(), r[2], r[0] is not None)
        for i, _, n in sorted((r for r in sized if r[1] == x), key=key):
            out.append((i, n, n * (whole + (before + n / 2 <= target[x] - whole * totals[x]))))
            before += n
    return Counter(out)


def test_mix_of_ids_that_very_many_rows_have(spark, monkeypatch):
    """Null and repeated ids are counted before they are ordered: a task's window holds their sizes, not their rows."""
    monkeypatch.setattr(mixing, "RUN", 64)
    rng = np.random.default_rng(3)
    rows = [(None, "w " * int(rng.integers(1, 20)), "a") for _ in range(3000)] + [(7, "same text here", "b")] * 1000 + [(i, "w " * int(rng.integers(0, 9)), "abc"[i % 3]) for i in range(400)]
    rows += [(None, None, None), (None, "x", None)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df)
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got.collect()) == walked(rows)
    assert got.count() == len(rows) and mixing.mix(df.limit(0)).count() == 0
