"""Near-duplicate vectors by sorted projection passes.

Each pass orders all vectors lexicographically by the concatenated signs of random projections and compares
every vector with a bounded window of its neighbours; pairs at or above the threshold are united across
passes.  Equal vectors are one node, named by a hash of its components, and take part once.  A run of windows hands on
only the pairs that unite two of its groups.  The windows find which vectors belong together;
inside a component the links are then counted exactly: members within half the threshold's angle of a pivot
are all linked with each other, and the others are compared with every member in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditflow.llm.components import components
from creditflow.llm.shared import written


def _unit(vectors) -> np.ndarray:
    """Vectors of length one; each is divided by its greatest component first, so no square over- or underflows."""
    x = np.stack(vectors).astype("float64")
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits))


def passes_for(rows: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold that nothing else links has met with chance ``recall`` at least.

    Such a pair agrees in a sign with chance 1 - angle / pi, and meets in a pass if it agrees in the first
    log2(rows / window) signs, when its bucket fits the window.  That holds for vectors spread in all directions.
    """
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    meets = agree ** math.log2(max(2.0, rows / window))
    return 1 if meets >= recall else math.ceil(math.log(1 - recall) / math.log1p(-meets))


def _passes(vectors: DataFrame, passes: int, bits: int, window: int, threshold: float, recall: float, rows_per_part: int, seed: int) -> DataFrame:
    """Links (a, b), a < b, that the windows of any pass verify and that unite; ``passes`` or as many as the table's size needs."""
    kind = vectors.schema["v"].dataType.elementType.simpleString()
    total = vectors.count()
    passes = max(passes, passes_for(total, threshold, window, recall))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby(batch["v"].map(len)):
                x = _unit(own["v"].to_list())
                for p in range(passes):
                    signs = x @ _planes(dim, bits, seed + p) > 0
                    code = signs @ (1 << np.arange(bits - 1, -1, -1, dtype="int64"))
                    yield pd.DataFrame({"pass": np.int32(p), "dim": np.int32(dim), "code": code, "id": own["id"].to_numpy(), "v": own["v"].to_numpy()})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last window of what came before
        for batch in batches:
            held = batch if held is None else pd.concat([held.tail(window), batch])
            yield from _window(held, len(batch), window, threshold)

    coded = vectors.mapInPandas(project, f"pass int, dim int, code long, id long, v array<{kind}>")
    parts = max(1, -(-total * passes // rows_per_part))
    tie = F.xxhash64("pass", "id")  # equal codes may span partitions, in another order each pass
    placed = coded.withColumn("tie", tie).repartitionByRange(parts, "pass", "dim", "code", "tie").sortWithinPartitions("pass", "dim", "code", "tie")
    found = placed.select("pass", "dim", "id", "v").mapInPandas(compare, "a long, b long")
    return found.distinct()


def _window(rows: pd.DataFrame, new: int, window: int, threshold: float) -> Iterator[pd.DataFrame]:
    """Of the pairs of one of the last ``new`` rows with one of the ``window`` rows before it, those that unite two groups."""
    start = len(rows) - new
    for _, own in rows.assign(at=np.arange(len(rows))).groupby(["pass", "dim"], sort=False):
        x, ids, at = _unit(own["v"].to_list()), own["id"].to_numpy(), own["at"].to_numpy()
        top, links = np.arange(len(own)), []
        for gap in range(1, min(window, len(own) - 1) + 1):
            apart = np.flatnonzero((top[gap:] != top[:-gap]) & (at[gap:] >= start))
            hit = apart[np.einsum("ij,ij->i", x[apart + gap], x[apart]) >= threshold]
            for i in hit.tolist():
                a, b = top[i], top[i + gap]
                if a != b:
                    top[top == max(a, b)] = min(a, b)
                    links.append((i, i + gap))
        if links:
            a, b = ids[np.array(links)].T
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _linked_inside(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, label, n, v) of components -> (id, links): rows linked by cosine with each, copies counted, itself left out.

    The pivot is the node that names the component.  Others are split into those in the pivot's ball (angle at
    most half the threshold's), whose links with each other need no comparison, and the rest.  The rest
    meets all members block by block; members and rest get their counts from both directions.
    """
    half = math.cos(math.acos(threshold) / 2) + 1e-9

    greatest = lambda v: F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scaled = lambda v: F.transform(F.array(greatest(v)), lambda m: F.transform(v, lambda x: x.cast("double") / m))[0]  # noqa: E731  found once a vector
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.zip_with("sv", "sp", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    pivots = written(members.where("id = label").select("label", scaled(F.col("v")).alias("sp")), "pivots")
    near = members.join(pivots, "label").withColumn("sv", scaled(F.col("v"))).withColumn("core", dot / (norm(F.col("sv")) * norm(F.col("sp"))) >= half)
    near = written(near.select("id", "label", "n", "v", "core"), "near")
    sizes = near.groupBy("label").agg(
        F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_n"), F.count(F.lit(1)).alias("size"), F.sum((~F.col("core")).cast("long")).alias("outside")
    )
    sizes = written(sizes, "sizes")
    inside = near.where("core").join(sizes, "label").select("id", (F.col("core_n") - F.col("n")).alias("links"))
    rest = sizes.where("outside > 0").select("label", F.ceil(F.col("size") / block).cast("int").alias("blocks"), F.ceil(F.col("outside") / block).cast("int").alias("rests"))
    rest = written(rest, "rest")
    busy = near.join(rest, "label")
    at = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(parts)).cast("int")
    left = busy.withColumn("block", at("blocks", 1)).withColumn("rest", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    right = busy.where("NOT core").withColumn("rest", at("rests", 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["label", "block", "rest", "id", "n", "v", "core"]

    def meet(own: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(outside):
            return pd.DataFrame({"id": [], "links": []}).astype("int64")
        links = (_unit(own["v"].to_list()) @ _unit(outside["r_v"].to_list()).T >= threshold) & (own["id"].to_numpy()[:, None] != outside["r_id"].to_numpy())
        to_rest = (links * own["n"].to_numpy()[:, None]).sum(axis=0)  # each outside row meets every member
        core = own["core"].to_numpy()
        to_core = (links * outside["r_n"].to_numpy()).sum(axis=1)[core]  # core members only add the outside rows
        return pd.DataFrame({"id": np.concatenate([outside["r_id"], own["id"][core]]), "links": np.concatenate([to_rest, to_core])}).astype("int64")

    left = left.select(*columns).groupBy("label", "block", "rest")
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in columns]).groupBy("r_label", "r_block", "r_rest")
    met = left.cogroup(right).applyInPandas(meet, "id long, links long")
    return inside.union(met).groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    df: DataFrame,
    threshold: float = 0.9,
    passes: int = 16,
    bits: int = 48,
    window: int = 32,
    recall: float = 0.99,
    rows_per_part: int = 20_000,
    block: int = 1024,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Cosine in double precision.  Vectors that are null, zero or empty, or hold a null or non-finite component, link with
    nothing (no links, their own component); vectors of different lengths never link.  A row with a null id
    takes part in nothing and has a null component.  Equal vectors always link; rows that repeat an id count as
    one row each, by their vectors, so two components may have one name where an id repeats.  Extra columns are
    ignored; an empty table gives no rows.  Passes may miss a link between components; inside a component none is
    missed.  ``passes`` is the least number; it grows with the table so that a lone pair at the threshold is found with
    chance ``recall`` at any size.
    """
    x = F.col(vector_col) if dict(df.dtypes)[vector_col] in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("v"))
    finite = ~F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("v", lambda v: v != 0)
    good = F.coalesce(F.col("id").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    # +0.0 turns -0.0 into 0.0, so that equal vectors have equal hashes
    rows = rows.withColumn("node", F.when(good, F.xxhash64(F.size("v"), F.transform("v", lambda v: v.cast("double") + F.lit(0.0)))))
    rows = written(rows, "vectors")
    sizes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rid"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    nodes = written(sizes, "nodes").withColumnRenamed("node", "id")
    links = written(_passes(nodes.select("id", "v"), passes, bits, window, threshold, recall, rows_per_part, seed), "links")
    labels = written(components(links).withColumnRenamed("x", "id"), "labels")
    members = written(nodes.select("id", "n", "v").join(labels, "id"), "members")
    counts = written(_linked_inside(members, threshold, block), "counts")
    tops = nodes.select("id", "rid", "n").join(labels, "id", "left").join(counts, "id", "left")
    tops = written(tops.select("id", "rid", F.coalesce("label", "id").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "tops")
    least = tops.groupBy("label").agg(F.min("rid").alias("component_id"))
    tops = written(tops.join(least, "label").select(F.col("id").alias("node"), "component_id", "links"), "tops")
    out = rows.select("id", "node").join(tops, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
