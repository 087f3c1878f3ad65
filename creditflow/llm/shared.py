"""Scratch tables in the cluster's shared folder, and small helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (tests on one machine), a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    key = id(spark.sparkContext)
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The files outlive any executor, so a lost one costs only the tasks it ran.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few longs that a side may have to be broadcast: some 16 MB, whatever the table's size.
BROADCAST_ROWS = 250_000


def side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A side of a join that is broadcast while it has at most ``most`` rows, and shuffled beyond that."""
    return F.broadcast(df) if df.count() <= most else df


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound Arrow batches by bytes, so that a batch of very long texts fits a Python worker.

    The bound is a setting of the session, read when a result is computed, so it stays set.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).strip().lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= size:
        spark.conf.set(key, str(size))


def named(column: str) -> Column:
    """The column of this very name, dots and back-ticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def crc32_text(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; of none where the text is null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
