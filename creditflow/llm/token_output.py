"""Token ids as ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Files hold a range of document ids each, in ascending order.  A row is a document: doc_id, part (its file's place in
the order), part_start (ids before it in the file), n_tokens, ids.  Spark's ORC reader splits files by stripe, and
prunes stripes and row groups by the statistics and Bloom filters on doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditflow.llm.shared import n_bytes, side, small_batches, written
from creditflow.llm.word_ids import encoder

SCHEMA = "doc_id long, part int, part_start long, n_tokens int, ids array<int>"


def write_orc(
    df: DataFrame,
    path: str,
    tokenizer_path: str,
    pattern: str,
    end_id: int = 0,
    bytes_per_file: int = 64 << 20,
    stripe_bytes: int = 8 << 20,
    row_index_stride: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text with the tokenizers library, append ``end_id`` and write ORC files under ``path``.

    Texts, not ids, are shuffled into ranges of doc_id, so encoding runs once.  Nulls: a null text is encoded as
    empty (the end id alone); null ids come first.  Rows that repeat an id follow each other ordered by
    text; a hot id may span files.  An empty table writes no rows.  There is a file per ``bytes_per_file`` of text, however
    many that are; raise it for a table of more than some 10 TB, as the shuffle keeps a size per file and task.
    """
    spark = df.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    total = df.agg(F.sum(n_bytes(F.col(text_col)))).first()[0] or 0
    parts = max(1, -(-total // bytes_per_file))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, start = encoder(tokenizer_path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            offsets, ids = own.encode(batch.column("text"), end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(batch.num_rows, part, "int32")),
                    pa.array(start + offsets[:-1]),
                    pa.array(np.diff(offsets).astype("int32")),
                    pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(ids)),
                ],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            start += int(offsets[-1])

    out = rows.drop("tie").mapInArrow(encode, SCHEMA)
    (
        out.write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str, files_per_block: int = 1024) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids.  A filter on doc_id reaches the ORC reader.

    A first job sums each file's ids, from two columns.  What comes before a file is summed in blocks of files: before it in
    its block, and before its block.  So no task holds all files, and they are broadcast only while they are few.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    block = F.floor(F.col("part") / files_per_block).alias("block")
    files = written(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")), "orc-files").select("part", block, "n")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = files.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(Window.orderBy("block")).alias("earlier"))
    files = files.withColumn("inside", before(Window.partitionBy("block").orderBy("part"))).join(side(blocks), "block")
    bases = files.select("part", (F.col("earlier") + F.col("inside")).alias("base"))
    return rows.join(side(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).cast("long").alias("start"), F.col("n_tokens").cast("long"), "ids")


def with_crc32(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(crc, "int64")], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
