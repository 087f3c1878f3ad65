"""Reading and describing tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(df: DataFrame, start: str, end: str, column: str = "event_date") -> DataFrame:
    """Rows of the daily shards from start to end, both included; on a partition column whole folders are skipped."""
    return df.where(F.col(column).between(start, end))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))


def field_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of every field, nested ones dotted, arrays entered."""
    out = []
    for f in schema.fields:
        path, kind = f"{prefix}{f.name}", f.dataType
        out.append((path, kind.simpleString()))
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += field_paths(kind, f"{path}.")
    return out


def catalog_fields(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(name, path, kind) for name, df in tables.items() for path, kind in field_paths(df.schema)]
    return spark.createDataFrame(rows, "table_name string, field_path string, data_type string")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, under the header's names."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def suffix_rules(path: str) -> tuple[str, ...]:
    """Rules of a file in the public suffix list's format, for ``Settings.public_suffixes``; other scripts in Punycode too."""
    rules = []
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            rule = line.split()[0].lower() if line.split() else "//"
            if not rule.startswith("//"):
                rules += [rule, *([] if rule.isascii() else [".".join(x if x in "*" else x.encode("idna").decode() for x in rule.split("."))])]
    return tuple(rules)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at the path; its schema alone is read."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of a table's files, hidden ones left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    found, out = root.getFileSystem(conf).listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def probe(spark: SparkSession, path: str) -> bool:
    """Whether a table is there and can be read: at most one row is."""
    return exists(spark, path) and len(spark.read.parquet(path).limit(1).collect()) <= 1


def snapshot(df: DataFrame) -> DataFrame:
    """One row: rows, schema and a fingerprint that no order of rows changes, repeated rows included."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).alias("fingerprint")).withColumn("schema", F.lit(df.schema.simpleString()))
