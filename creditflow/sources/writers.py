"""Writing results: create-only, replace or append, clustered; CSV and JSON for people."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save(df: DataFrame, path: str, mode: str = "errorifexists", cluster: list[str] | None = None, partition: list[str] | None = None) -> None:
    """Parquet; ``cluster`` puts equal keys into one file in order, so that statistics can skip row groups."""
    if cluster:
        df = df.repartition(*cluster).sortWithinPartitions(*cluster)
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def save_chunks(chunks: list[DataFrame], path: str) -> None:
    """The first chunk creates the table, the others append."""
    for i, df in enumerate(chunks):
        save(df, path, "append" if i else "errorifexists")


def save_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str, path: str) -> int:
    """Create-only from rows with an explicit schema; the stored count must be theirs."""
    save(spark.createDataFrame(rows, schema), path)
    stored = spark.read.parquet(path).count()
    if stored != len(rows):
        raise RuntimeError(f"{path} holds {stored} rows of {len(rows)}")
    return stored


def csv_ready(df: DataFrame) -> DataFrame:
    """Nulls as nothing, dates in ISO form, nested values as JSON; quotes inside a value are doubled."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def save_csv(df: DataFrame, path: str, order: list[str]) -> None:
    csv_ready(df).orderBy(*order).write.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_baseline(tables: dict[str, DataFrame], path: str, version: str) -> str:
    """A JSON record per table (rows, schema, fingerprint), and one file with the SHA-256 over all of them, which is returned."""
    from creditflow.sources.readers import snapshot

    rows = reduce(DataFrame.unionByName, [snapshot(df).withColumn("table_name", F.lit(name)) for name, df in sorted(tables.items())])
    rows.withColumn("version", F.lit(version)).coalesce(1).write.json(path)
    spark = rows.sparkSession
    total = baseline_digest(read_baseline(spark, path))
    put_text(spark, f"{path}/_BASELINE", total)
    return total


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("table_name string, rows long, schema string, fingerprint string, version string").json(path)


def baseline_digest(records: DataFrame) -> str:
    line = F.concat_ws("|", "table_name", "rows", "schema", "fingerprint", "version")
    return records.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)).first()[0]  # a record per table


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file wherever tables can be; what was there is replaced."""
    fs, at = _file(spark, path)
    out = fs.create(at, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; null where there is none."""
    fs, at = _file(spark, path)
    if not fs.exists(at):
        return None
    source = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which a cluster's machines share; a local one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
