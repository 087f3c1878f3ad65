"""Exact distinct counts that can be added up: bitmaps over dense ids, built per chunk and merged later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditflow.operators.scan import global_rank

NO_ID = -1


def dense_ids(rows: DataFrame, column: str, name: str = "dense_id") -> DataFrame:
    """(column, name): the distinct values, nulls left out, numbered from 0 by range partitions and offsets."""
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return global_rank(values, [column], name).withColumn(name, F.col(name) - 1)


def bitmaps(rows: DataFrame, by: list[str], dense_id: str) -> DataFrame:
    """by, bucket, bitmap, rows: who was there, 32,768 ids to a bitmap of 4 KB; rows without an id are only counted.

    The ids of a group are spread over as many rows as they have buckets, so no group's set is in one buffer.
    """
    bucket = F.coalesce(F.bitmap_bucket_number(F.col(dense_id) + 1), F.lit(NO_ID)).cast("long")
    place = F.bitmap_bit_position(F.col(dense_id) + 1)
    known = rows.withColumns({"bucket": bucket, "_place": place})
    out = known.where(F.col("bucket") != NO_ID).groupBy(*by, "bucket").agg(F.bitmap_construct_agg("_place").alias("bitmap"), F.count(F.lit(1)).alias("rows"))
    unknown = known.where(F.col("bucket") == NO_ID).groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("rows"))
    return out.unionByName(unknown.withColumn("bitmap", F.lit(None).cast("binary")))


def merged(chunks: list[DataFrame], by: list[str]) -> DataFrame:
    """Bitmaps of several chunks in one, to be merged further or counted."""
    rows = reduce(DataFrame.unionByName, chunks)
    return rows.groupBy(*by, "bucket").agg(F.bitmap_or_agg(F.coalesce("bitmap", F.lit(b""))).alias("bitmap"), F.sum("rows").alias("rows"))


def counted(chunks: DataFrame, by: list[str], ids: str = "distinct_ids", rows: str = "rows") -> DataFrame:
    """by, distinct ids and rows of (merged) bitmaps."""
    n = F.sum(F.when(F.col("bucket") != NO_ID, F.bitmap_count("bitmap")).otherwise(0)).cast("long")
    return chunks.groupBy(*by).agg(n.alias(ids), F.sum("rows").cast("long").alias(rows))
