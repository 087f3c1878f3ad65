"""Daily shards as a date-partitioned table: whole days are skipped, by constants or by what a small table says at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD = "event_date"


def write_shards(rows: DataFrame, path: str, ts: str, mode: str = "errorifexists") -> None:
    """One folder a day (``event_date=yyyyMMdd``); rows of a day are put together first, so a day is few files.

    ``mode`` overwrite replaces the days that ``rows`` has and leaves the others.
    """
    dated = rows.withColumn(SHARD, F.date_format(ts, "yyyyMMdd"))
    dated.repartition(SHARD).write.partitionBy(SHARD).mode(mode).option("partitionOverwriteMode", "dynamic").parquet(path)


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """All shards; ``event_date`` is text, as in the names of daily tables."""
    days = spark.read.option("inferSchema", False).parquet(path)
    return days.withColumn(SHARD, F.col(SHARD).cast("string"))


def between(shards: DataFrame, start: str, end: str) -> DataFrame:
    """Shards from start to end, both included: a partition filter, so no file of another day is opened."""
    return shards.where(F.col(SHARD).between(start, end))


def of_days(shards: DataFrame, days: DataFrame) -> DataFrame:
    """Shards of the days in ``days`` (event_date): a join whose build side prunes the scan at run time.

    A calendar is some hundreds of rows a year; Spark broadcasts it by its size.
    """
    return shards.join(days.select(F.col(SHARD)).distinct(), SHARD, "left_semi")


def missing_days(shards: DataFrame, days: DataFrame) -> DataFrame:
    """Days of ``days`` that have no shard; partition values alone are read."""
    return days.select(SHARD).distinct().join(shards.select(SHARD).distinct(), SHARD, "left_anti")
