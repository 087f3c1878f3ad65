"""Tables bucketed by a key: what is joined or grouped by that key again and again is shuffled once, when it is stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from creditflow.sources.writers import scratch


def save_bucketed(rows: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Store ``rows`` as a catalog table in ``buckets`` buckets, sorted inside them, and read it back.

    Rows go to their bucket's task first, so that a bucket is one file; where they are there already, Spark leaves that
    shuffle out.  With a ``path`` the table is external.
    """
    writer = rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("compression", "zstd").mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return rows.sparkSession.table(table)


def scratch_bucketed(rows: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """A bucketed table of a new name, with its files in the folder that the machines share."""
    table = f"{name}_{uuid.uuid4().hex}"
    return save_bucketed(rows, table, keys, buckets, scratch(rows.sparkSession, table))


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
