"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditflow.llm.shared import WORD, written

#: Hex digits of a document's seeded hash that choose its bucket; a source's words are summed per bucket.
BUCKET_DIGITS = 3
#: Copies of one row that one task brings back at a time.
RUN = 4096


def water_fill(sources: DataFrame, weights: Sequence[int], budget: float, max_epochs: int) -> DataFrame:
    """(source, source_size) -> and target, by source.

    Sources take ``weights`` in turn by code point, null last, and share ``budget`` times all
    words.  Sources whose share is over ``max_epochs`` times their size are clamped and the excess goes
    to the rest by weight until none is over.  In the order of size over weight the clamped sources come
    first, so running sums find the point where clamping ends.  One row per source, all in one task: for
    up to some millions of sources.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    seen, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (
        sources.withColumn("weight", w)
        .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("free", F.col("total") - F.coalesce(F.sum("cap").over(seen), F.lit(0.0)))
        .withColumn("heavy", (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(seen), F.lit(0))).cast("double"))
        .withColumn("level", F.when(F.col("cap") / F.col("weight") > F.col("free") / F.col("heavy"), F.col("free") / F.col("heavy")))
        .withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return s.select("source", "source_size", target.alias("target"))


def words(text_col: str) -> Column:
    """A text's size in words; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    df: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    budget: float = 1.5,
    max_epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_source: bool = False,
) -> DataFrame:
    """Every row with its size in words, its source's size and target, and ``taken``, the words the mix takes.

    A source at ``e`` epochs repeats each document ``floor(e)`` times; the fraction is made by taking, in the
    order of a seeded hash, documents once more until their words come nearest to it.  That order is cut
    into buckets whose sums find the bucket where taking ends, so no source is gathered in one task.
    Nulls: a null text has size 0, a null source is a source of its own that comes last, a null id hashes as
    the empty text.  Rows that repeat an id have one place in the order and are told apart by size; exact
    repeats are interchangeable and are counted before they are ordered, so an id that very many rows have (or null) is no
    task's load but for its different sizes.  An empty table gives no rows.  Extra columns are ignored; ``with_source`` adds the
    source's.
    """
    size = words(text_col)
    turn = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), turn.alias("turn"))
    rows = rows.groupBy("source", "turn", "size", "id").agg(F.count(F.lit(1)).alias("copies"))  # before anything is ordered
    rows = written(rows.withColumn("bucket", F.substring("turn", 1, BUCKET_DIGITS)), "mix-sizes")
    buckets = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("bucket_size"))
    targets = water_fill(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, budget, max_epochs)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).alias("b")
    starts = starts.join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bucket", "b.start", "t.source_size", "t.target")
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))).alias("r")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    found = placed.join(starts.alias("s"), (F.col("r.bucket") == F.col("s.bucket")) & F.col("r.source").eqNullSafe(F.col("s.source"))).withColumn("whole", whole)
    # Equal rows stand one after another: each comes back as a row, made in runs that different tasks take.
    runs = found.select("r.*", "s.start", "source_size", "target", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN))).alias("run"))
    runs = runs.repartition("turn", "size", "run")
    own = F.explode(F.sequence(F.col("run"), F.least(F.col("run") + F.lit(RUN), F.col("copies")) - 1)).alias("place")
    each = runs.select("*", own)
    more = F.col("start") + F.col("inside") + F.col("place") * F.col("size") + F.col("size") / F.lit(2.0) <= F.col("target") - F.col("whole") * F.col("source_size")
    return each.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("whole") + more.cast("long"))).cast("long").alias("taken"),
        *([F.col("source").alias(source_col)] if with_source else []),
    )


#: The same rows for DuckDB.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('-', '17', CAST(doc_id AS VARCHAR))) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight,
             CAST(2 * source_size AS DOUBLE) AS cap FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(cap) OVER before, 0) AS free,
             CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS heavy
      FROM w WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by(free / heavy, cap / weight) AS level FROM f WHERE cap / weight > free / heavy),
t AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM f, l),
x AS (SELECT doc_id, size, source_size, target,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, size, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""
