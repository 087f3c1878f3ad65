"""Exact top-k inner-product search by MaxScore over shards, merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Shard:
    """Postings of one shard: per term the weights of its vectors (all have one), with their least and greatest."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.postings = ids, np.ascontiguousarray(weights.T)
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)

    def top(self, query: np.ndarray, own: int, k: int, chunk: int = 2048) -> list[tuple[int, int]]:
        """The k best (score, id) but for the query's own id; ties to smaller ids.

        A term's bounds are the most and the least it can add.  The threshold is the k-th best score of the chunks before;
        terms are non-essential as long as a vector that has the most in all of them and the least in the others stays
        below it.  A chunk's essential postings are traversed whole, the others probed one after another for the vectors
        that can still reach the threshold.  It rises from chunk to chunk, and the split moves with it.
        """
        most = np.maximum(np.abs(self.low.astype("float64")), np.abs(self.high.astype("float64")))
        if float(np.abs(query.astype("float64")) @ most) >= 2.0**62:
            raise OverflowError("a score may leave 64 bits: components are too large for integer products")
        bound = np.maximum(query * self.low, query * self.high)
        least = np.minimum(query * self.low, query * self.high)
        order = np.argsort(-(bound - least), kind="stable")
        rest_up = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        rest_low = np.append(np.cumsum(least[order][::-1])[::-1], 0)
        reach = rest_up + (rest_low[0] - rest_low)  # of a vector with the least in all essential terms
        best_scores, best_ids, threshold = np.zeros(0, "int64"), np.zeros(0, "int64"), None
        for start in range(0, len(self.ids), chunk):
            live = np.flatnonzero(self.ids[start : start + chunk] != own) + start
            essential = len(query) if threshold is None else int(np.argmax(np.append(reach < threshold, True)))
            score = query[order[:essential]] @ self.postings[order[:essential]][:, live]
            for t in range(essential, len(query)):
                competitive = score + rest_up[t] >= threshold
                if not competitive.all():
                    live, score = live[competitive], score[competitive]
                    if not len(live):
                        break
                score = score + query[order[t]] * self.postings[order[t]][live]
            best_scores, best_ids = np.concatenate([best_scores, score]), np.concatenate([best_ids, self.ids[live]])
            by = np.lexsort((best_ids, -best_scores))[:k]
            best_scores, best_ids = best_scores[by], best_ids[by]
            if len(by) == k:
                threshold = best_scores[-1]
        return list(zip(best_scores.tolist(), best_ids.tolist(), strict=True))


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 8192, query_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "weights") -> DataFrame:
    """query_id, rank, id, score: each query's k best rows of ``df`` by inner product of integer arrays.

    Vectors go to shards and queries to blocks by a hash, each of a bounded size; every block meets every shard in a
    task of its own, and the shards' lists are merged by rank.  Rows with the query's own id are no candidates.
    Nulls: rows with a null id, a null vector or a null component take no part, nor do empty vectors.  A query
    meets the vectors of its own length only.  Ties go to smaller ids; repeated rows are candidates each.  Empty tables give no rows.
    Scores are 64-bit integers: where the sum of a query's components times the largest ones of a shard comes to 2 ** 62,
    an OverflowError says so instead of a score that has wrapped.
    """
    good = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull()) & (F.size(vector_col) > 0)
    vectors = df.where(good).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v"))
    asked = queries.where(good).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v"))
    n, m = vectors.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    at = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(parts)).cast("int")
    left = vectors.withColumn("shard", at(shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", at(blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def meet(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(own) and len(ask):
            shard = Shard(own["id"].to_numpy(), np.stack(own["v"].to_list()))
            for q, v in zip(ask["id"], ask["v"], strict=True):
                out += [(q, s, i) for s, i in shard.top(np.asarray(v), q, k)]
        return pd.DataFrame(out, columns=["query_id", "score", "id"]).astype("int64")

    keys = ["shard", "block", F.size("v").alias("width")]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, score long, id long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def integer_weights(df: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and weights: floor(scale * x) of every component as double; vectors that are null or hold null or
    non-finite components are left out, as are null ids.  Repeated rows give repeated rows; other columns are left out."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(id_col, F.transform(x, lambda v: F.floor(v * scale)).alias("weights"))
