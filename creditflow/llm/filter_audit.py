"""How text filters overlap: what each removes at each place of every order, and its fair share of all removals.

Texts are scanned as Arrow buffers: NumPy classifies all bytes of a batch at once, prefix sums give words, capitals and
symbols per document, and word hashes sorted inside a document give its distinct words; words of equal hashes are
compared byte by byte.  A document then is a mask of the filters that it fails, and only counts of masks go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditflow.llm.shared import small_batches
from creditflow.llm.suffix_dedup import Keys, texts_of

SYMBOLS = b"#$%&*|"
#: Bytes that are scanned at a time; a longer text is scanned alone.
CHUNK = 1 << 20

SPACE, CAPITAL, SYMBOL, CHARACTER = 1, 2, 4, 8


def byte_classes(symbols: bytes = SYMBOLS) -> np.ndarray:
    """Bits of every byte: white space, A-Z, a symbol, the first byte of a character."""
    table = np.where((np.arange(256) & 0xC0) != 0x80, CHARACTER, 0).astype(np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] |= SPACE
    table[ord("A") : ord("Z") + 1] |= CAPITAL
    table[list(symbols)] |= SYMBOL
    return table


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from place a equal those from place b, eight at a time; ``data`` has eight bytes more than needed."""
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    same, rest, k = np.ones(len(a), dtype=bool), np.arange(len(a)), 0
    while len(rest) and k < 1024:
        left = np.minimum(size[rest] - k, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - left))
        same[rest] &= ((eight[a[rest] + k] ^ eight[b[rest] + k]) & mask) == 0
        k += 8
        rest = rest[(size[rest] > k) & same[rest]]
    for i in rest.tolist():
        same[i] = np.array_equal(data[a[i] + k : a[i] + size[i]], data[b[i] + k : b[i] + size[i]])
    return same


def scan(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
    """Per document [offsets[i], offsets[i + 1]) of ``data``: words, distinct words, capitals, characters, symbols."""
    n, base = len(offsets) - 1, int(offsets[0])
    offsets = offsets - base
    text = np.zeros(int(offsets[-1]) + 8, dtype=np.uint8)
    text[: offsets[-1]] = data[base : base + offsets[-1]]
    kind = classes[text[: offsets[-1]]]

    def per_document(bit: int) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum((kind & bit) != 0, dtype=np.int64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    edge = np.zeros(len(kind) + 1, dtype=bool)
    edge[offsets] = True
    inside = np.concatenate(([False], (kind & SPACE) == 0, [False]))
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    before = np.searchsorted(starts, offsets)
    words = np.diff(before)
    own = np.repeat(np.arange(n), words)
    keys = Keys(text[: offsets[-1]]).between(starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    # The document's number and as many bits of the hash as there is room for; unequal words of one key are found below.
    room = np.uint64(64 - max(1, int(n).bit_length()))
    code = (own.astype(np.uint64) << room) | (keys >> (np.uint64(64) - room))
    order = np.argsort(code)
    pair = np.flatnonzero(code[order][1:] == code[order][:-1])
    a, b = order[pair], order[pair + 1]
    size = ends - starts
    same = size[a] == size[b]
    same[same] = _same_bytes(text, starts[a[same]], starts[b[same]], size[a[same]])
    distinct = words - np.bincount(own[a[same]], minlength=n)
    for i in np.unique(own[a[~same]]).tolist():  # hashes that meet by chance: this document's words are counted as they are
        distinct[i] = len({text[s:e].tobytes() for s, e in zip(starts[before[i] : before[i + 1]], ends[before[i] : before[i + 1]], strict=True)})
    return {"n_words": words, "n_distinct": distinct, "n_capitals": per_document(CAPITAL), "n_characters": per_document(CHARACTER), "n_symbols": per_document(SYMBOL)}


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_characters", "n_symbols")


def text_counts(docs: DataFrame, text_col: str, keep: list[str], symbols: bytes = SYMBOLS) -> DataFrame:
    """The columns ``keep`` and the counts of :func:`scan` for every row; a null text is empty."""
    small_batches(docs.sparkSession)
    docs = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS])
    classes = byte_classes(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch["_text"])
            a, parts = 0, []
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
                b = min(b, len(batch))
                parts.append(scan(data, offsets[a : b + 1], classes))
                a = b
            if parts:
                found = {c: pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS}
                yield pa.RecordBatch.from_pydict({c: batch[c] for c in keep} | found)

    return docs.mapInArrow(run, schema)


#: Failure conditions by letter over the counts and ``is_copy``.
FILTERS: dict[str, Column | str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_characters",
    "D": "n_symbols > 0",
    "E": "is_copy",
}


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """part, fails (bit i: the i-th filter's condition holds), good, toxic, n: counts of documents.

    ``is_copy``: another document of a smaller id has the very same text, in the whole table.  Nulls: a null text is empty,
    a null lang the part ''; a null id is no smaller id and has none, and no label.  Repeated rows count as often as they
    are there and are no copies of each other (their ids are equal).  Several labels of an id: good or toxic if one is.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    firsts = rows.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("text_key", "first_id")
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    counted = text_counts(rows, "text", ["doc_id", "part", "text_key"]).join(firsts, "text_key", "left").join(known, "doc_id", "left")
    counted = counted.withColumn("is_copy", F.col("doc_id") > F.col("first_id"))
    no = F.lit(False)
    bits = [F.when(F.coalesce(F.expr(c), no), 1 << i).otherwise(0) for i, c in enumerate(filters.values())]
    masks = counted.select("part", reduce(Column.__add__, bits).alias("fails"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return masks.groupBy("part", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def interactions(masks: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from counts of masks; at most 2 ** filters masks a part come in.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: documents of the part.
    """
    if not 1 <= len(letters) <= 7 or len(set(letters)) < len(letters):
        raise ValueError("one to seven filters of different letters")
    k, orders = len(letters), ["".join(p) for p in permutations(letters)]
    rows = masks.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(orders) * k - 1))).alias("i"))
    rows = rows.withColumns({"filter_order": F.array(*[F.lit(o) for o in orders])[F.floor(F.col("i") / k).cast("int")], "step": (F.col("i") % k + 1).cast("int")})
    rows = rows.withColumn("bit", reduce(Column.__add__, [F.when(F.substring("filter_order", F.col("step"), F.lit(1)) == x, 1 << i).otherwise(0) for i, x in enumerate(letters)]))
    rows = rows.withColumn("earlier", reduce(Column.__add__, [F.when(F.instr("filter_order", x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(letters)]))
    both = lambda a, b: F.col(a).bitwiseAND(F.col(b)) != 0
    fails, late = both("fails", "bit"), both("fails", "earlier")
    total = lambda condition, value=F.col("n"): F.sum(F.when(condition, value).otherwise(0)).cast("long")
    # A filter removes a document in the orders where it stands before the document's other failures.
    share = F.lit(len(orders)) / F.bit_count("fails")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~late).alias("kept"),
        total(fails & ~late).alias("removed"),
        total(fails & late).alias("redundant"),
        total(F.col("fails") == F.col("bit")).alias("unique_fails"),
        total(fails & ~late & F.col("good")).alias("good_lost"),
        total(fails & ~late & F.col("toxic")).alias("toxic_lost"),
        total(fails, (F.col("n") * share).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """:func:`interactions` of the documents' :func:`failures`; an empty table gives no rows, extra columns are ignored."""
    return interactions(failures(docs, labels, filters), "".join(filters))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY part, good, toxic, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) k),
r AS (SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS hit,
             least(CASE WHEN contains(fails, 'A') THEN strpos(filter_order, 'A') ELSE 9 END, CASE WHEN contains(fails, 'B') THEN strpos(filter_order, 'B') ELSE 9 END,
                   CASE WHEN contains(fails, 'C') THEN strpos(filter_order, 'C') ELSE 9 END, CASE WHEN contains(fails, 'D') THEN strpos(filter_order, 'D') ELSE 9 END,
                   CASE WHEN contains(fails, 'E') THEN strpos(filter_order, 'E') ELSE 9 END) AS hit_at
      FROM m, s),
g AS (SELECT part, filter_order, step, own,
             CAST(sum(CASE WHEN hit_at > step THEN n ELSE 0 END) AS BIGINT) AS kept,
             CAST(sum(CASE WHEN hit_at = step THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN hit AND hit_at < step THEN n ELSE 0 END) AS BIGINT) AS redundant,
             CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN hit_at = step AND good = 1 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
             CAST(sum(CASE WHEN hit_at = step AND toxic = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""
