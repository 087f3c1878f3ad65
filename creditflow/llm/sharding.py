"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has ``cells`` equal cells.  A document falls into the cell of its hash; every shard owns
``replicas`` virtual nodes, each in the cell of its own hash.  Documents go to the first shard
clockwise that is not full.  A shard's bound is ``(1 + epsilon) * rows / shards``; with ``epsilon=0``
the remainder is dealt one row each to the first shards, so that counts differ by one at most.

Only the counts per cell decide where overflow goes: a table of ``cells`` rows whatever the input's
size.  The walk round the ring folds over that table; documents are then numbered inside their cell
(one shuffle, ``rows / cells`` rows in a group) and looked up in the fold's result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditflow.llm.shared import crc32_text, n_bytes


def _position(cells: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(cells)).cast("int")


def ring_preferences(spark: SparkSession, shards: int, replicas: int, cells: int, seed: int) -> DataFrame:
    """Per cell, all shards in the order met when walking clockwise: (cell, pref array<int>).

    Depends on the configuration alone.  Adding a shard leaves the order of the others as it was.
    """
    nodes = spark.range(shards * replicas).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        _position(cells, F.lit(seed), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("at"),
    )
    nodes = nodes.groupBy("shard", "at").agg(F.lit(1).alias("node"))
    steps = spark.range(cells * shards).select(
        F.floor(F.col("id") / shards).cast("int").alias("at"), (F.col("id") % shards).cast("int").alias("shard")
    )
    first = nodes.groupBy("shard").agg(F.min("at").alias("first"))
    clockwise = Window.partitionBy("shard").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    near = (
        steps.join(nodes, ["shard", "at"], "left")
        .join(first, "shard")
        .withColumn("next", F.last(F.when(F.col("node") == 1, F.col("at")), ignorenulls=True).over(clockwise))
        .withColumn("gap", F.coalesce(F.col("next"), F.col("first") + cells) - F.col("at"))
    )
    order = F.array_sort(F.collect_list(F.struct("gap", F.xxhash64(F.lit(seed), "shard", "gap").alias("tie"), "shard")))
    return near.groupBy(F.col("at").alias("cell")).agg(F.transform(order, lambda s: s["shard"]).alias("pref"))


def ring_placements(counts: DataFrame, preferences: DataFrame, shards: int, epsilon: float, seed: int) -> DataFrame:
    """Walk the ring: (cell, n) -> (cell, shard, first, taken, base).

    ``first`` is the rank inside the cell at which the shard's run begins, ``base`` the number of the
    shard's rows that come from cells before.  Cells are served in the order of a seeded hash.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    bound = F.floor((F.lit(1.0) + epsilon) * F.col("total") / shards).cast("long")
    left = F.greatest(F.col("total") - bound * shards, F.lit(0))
    caps = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (bound + F.when(s < left, 1).otherwise(0)).cast("long")
    )
    queue = counts.join(preferences, "cell").agg(
        F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "cell").alias("turn"), "cell", "n", "pref"))).alias("queue")
    )
    run = "struct<cell:int,shard:int,first:bigint,taken:bigint>"

    def into(state: Column, shard: Column, cell: Column) -> Column:
        taken = F.least(state["left"], F.element_at(state["caps"], shard + 1))
        return F.when(taken <= 0, state).otherwise(
            F.struct(
                (state["left"] - taken).alias("left"),
                F.transform(state["caps"], lambda c, i: F.when(i == shard, c - taken).otherwise(c)).alias("caps"),
                F.concat(
                    state["runs"],
                    F.array(F.struct(cell["cell"].alias("cell"), shard.alias("shard"), (cell["n"] - state["left"]).alias("first"), taken.alias("taken")).cast(run)),
                ).alias("runs"),
            ).cast(f"struct<left:bigint,caps:array<bigint>,runs:array<{run}>>")
        )

    def serve(state: Column, cell: Column) -> Column:
        start = F.struct(cell["n"].alias("left"), state["caps"].alias("caps"), F.array().cast(f"array<{run}>").alias("runs"))
        start = start.cast(f"struct<left:bigint,caps:array<bigint>,runs:array<{run}>>")
        done = F.aggregate(cell["pref"], start, lambda a, s: into(a, s, cell))
        return F.transform(F.array(done), lambda d: F.struct(d["caps"].alias("caps"), F.concat(state["runs"], d["runs"]).alias("runs")))[0].cast(
            f"struct<caps:array<bigint>,runs:array<{run}>>"
        )

    zero = F.struct(F.col("caps"), F.array().cast(f"array<{run}>").alias("runs")).cast(f"struct<caps:array<bigint>,runs:array<{run}>>")
    runs = (
        total.select(caps.alias("caps"))
        .crossJoin(queue)  # one row beside one row
        .select(F.explode(F.aggregate(F.coalesce("queue", F.array()), zero, serve, lambda s: s["runs"])).alias("run"))
        .select("run.*")
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("base", F.coalesce(F.sum("taken").over(before), F.lit(0)).cast("long"))


def shard_documents(
    df: DataFrame,
    shards: int = 40,
    replicas: int = 64,
    cells: int = 8192,
    epsilon: float = 0.0,
    seed: int = 20240101,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
) -> DataFrame:
    """Place every row of ``df``: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``.  ``grown_shard`` is null, since bounds depend on all rows.
    Nulls: a null text counts as no bytes; a null id is placed by the text's crc32.  Rows that repeat an
    id share a position and are told apart by crc32 and size; exact repeats are counted, placed as
    a run, and each gets a slot of its own.  An empty table gives no rows.  Other columns of ``df`` are
    ignored whatever their names.  ``slot`` runs from 0 without gaps in every shard.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), n_bytes(F.col(text_col)).alias("nb"), crc32_text(F.col(text_col)).alias("crc"))
    at = F.coalesce(F.xxhash64(F.lit(seed), F.col("id")), F.lit(0))
    at = F.when(F.col("id").isNull(), F.xxhash64(F.lit(seed), F.col("crc"))).otherwise(at)
    rows = rows.select("id", "crc", (F.col("nb") + overhead).alias("size"), at.alias("at"))
    kinds = rows.groupBy("at", "id", "crc", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.pmod("at", F.lit(cells)).cast("int"))
    counts = rows.groupBy(F.pmod("at", F.lit(cells)).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    runs = ring_placements(counts, ring_preferences(spark, shards, replicas, cells, seed), shards, epsilon, seed)
    # At most one run per cell and one more per filled shard: cells + shards * cells / cells rows, a fixed bound.
    per_cell = runs.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("first", "taken", "shard", "base"))).alias("runs"))
    inside = Window.partitionBy("cell").orderBy("at", "id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = kinds.withColumn("rank", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = ranked.join(F.broadcast(per_cell), "cell")
    last, run = F.col("rank") + F.col("n") - 1, 1000  # exact repeats are numbered run by run, so that no array grows with them
    each = placed.withColumn("from", F.explode(F.sequence(F.col("rank"), last, F.lit(run).cast("long"))))
    each = each.withColumn("i", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + run - 1, last))))
    hit = F.filter("runs", lambda r: (F.col("i") >= r["first"]) & (F.col("i") < r["first"] + r["taken"]))[0]
    return each.withColumn("hit", hit).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("hit.shard").alias("shard"),
        (F.col("hit.base") + F.col("i") - F.col("hit.first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
