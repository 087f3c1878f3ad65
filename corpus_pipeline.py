"""A training-data pipeline of four operators over ``documents``.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  Each stage's result is
written and read again before the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditflow.llm import byte_bpe, jaccard_join, language_id, mixing
from creditflow.llm.shared import named, side, written


def whole_row(docs: DataFrame) -> Column:
    """All columns in one, so that no name of theirs meets one of a stage's own."""
    return F.struct(*[named(c).alias(c) for c in docs.columns]).alias("row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept; a missing ``lang`` becomes the predicted one.

    Rejected: no letters, or a cross-entropy over the calibrated limit of the best language.
    """
    model = language_id.train(docs.where(language_id.fold(F.col("doc_id")) != 1))
    found = docs.select(whole_row(docs), language_id.judgement(spark, model, F.col("text")).alias("found")).where("NOT found.rejected")
    lang = F.coalesce("row.lang", "found.lang_pred")
    return found.select(*[(lang if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates (5 words, similarity 0.8)."""
    return jaccard_join.keep_first(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: repeated rows for repeated epochs, none where it takes none.

    Rows are matched by id, source and size, null ids and sources too.  Where rows that are equal in those are
    taken unequally, the order of their texts' hashes says which are taken once more, so words stay the mix's.
    """
    keys = ["doc_id", "origin", "size"]
    times = (F.col("taken") / F.col("size")).cast("int")
    mixed = mixing.mix(docs, with_source=True).where("size > 0").withColumn("origin", F.xxhash64("source")).groupBy(*keys).agg(F.min(times).alias("times"), (F.sum(times) - F.count(F.lit(1)) * F.min(times)).alias("more"))
    mixed = side(written(mixed.where("times > 0 OR more > 0"), "mixed")).alias("m")  # longs alone, broadcast while they are few
    sized = docs.select(whole_row(docs), mixing.words("text").alias("words")).alias("d")
    same = F.col("row.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64("row.source") == F.col("m.origin")) & (F.col("words") == F.col("m.size"))
    even = sized.join(mixed.where("more = 0"), same).select("row", "times")
    # Only groups at the place where a source's last epoch ends: few rows, unless very many are alike.
    turn = Window.partitionBy("row.doc_id", "row.source", "words").orderBy(F.xxhash64("row.text"), "row.text")
    uneven = sized.join(mixed.where("more > 0"), same).withColumn("turn", F.row_number().over(turn))
    uneven = uneven.select("row", (F.col("times") + (F.col("turn") <= F.col("more")).cast("int")).alias("times"))
    return even.union(uneven).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and whether decoding gives the text back, per row."""
    import public_tokenizers

    coded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL has neither the language models nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
