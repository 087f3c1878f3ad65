"""Removal of passages that occur elsewhere in the corpus, by prefix-free parsing.

A rolling hash of eight bytes puts triggers into the texts; what lies between two triggers is a phrase.  Where a string
of ``length`` bytes has no trigger, the least hash in it is one.  Every string of ``length`` bytes is then a suffix of a
phrase of the dictionary, up to its first trigger, and a prefix of the parse from there on.  Equal strings have
their trigger at the same place, so strings are compared trigger by trigger: occurrences whose bytes next to the trigger
agree are sorted once by the phrase read backwards from the trigger (the dictionary's suffixes) and once by the parse
read onwards (the parse's suffixes).  Neighbours' common lengths in both orders say for every string, which is a pair
of a suffix and a prefix, whether it has a second occurrence.  That is the corpus's suffix order, cut at ``length``, with
one entry for a trigger instead of one for a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditflow.llm.shared import n_bytes, small_batches, written

#: A trigger's bytes, and how many bytes a phrase has on average.
GRAM, MEAN_PHRASE = 8, 64
#: Distances before a trigger that one entry stands for.
SPAN = 128
#: Bytes of text that are parsed at a time; a longer text is parsed in pieces.
PIECE = 1 << 20

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_BASE = 0x2545F4914F6CDD1D


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the eight bytes from every place; near the end, of those that are left."""
    v = np.zeros(len(data) + GRAM, dtype=np.uint64)
    v[: len(data)] = data
    for k in (1, 2, 4):
        v[:-k] |= v[k:] << np.uint64(8 * k)
    v = v[: len(data)] * _MIX[0]
    v ^= v >> np.uint64(29)
    v *= _MIX[1]
    return v ^ (v >> np.uint64(32))


class Keys:
    """64-bit hashes of any stretch of some bytes by prefix sums; they only gather what may be equal."""

    _powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
    _codes = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers[0]) < n:
            made = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(2 * n, base, dtype=np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            cls._powers = tuple(made)
        return cls._powers

    def __init__(self, data: np.ndarray):
        up, self.down = self.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self._codes[data] * up[: len(data)], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        return x ^ (x >> np.uint64(31))

    def of(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.between(at, at + size).view(np.int64)


def entries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(at, near, far, key) for the strings of ``length`` bytes inside the stretches [starts, ends) of ``data``.

    An entry stands for the strings that begin ``near`` to ``far`` bytes before ``at``; ``at`` is a trigger or ``span`` bytes
    before one.  ``key`` is a hash of the bytes from ``at`` that all strings of such entries hold.
    """
    none = np.zeros(0, dtype=np.int64)
    long_enough = ends - starts >= length
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return none, none, none, none
    reach = length - GRAM
    turn = np.zeros(len(data) + 1, dtype=np.int8)
    turn[starts] += 1
    turn[ends - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(turn, dtype=np.int8)[:-1])
    h = rolling_hashes(data)
    place = np.arange(len(data), dtype=np.int64)
    first = np.minimum.accumulate(np.where(h < np.uint64((1 << 64) // MEAN_PHRASE), place, 1 << 62)[::-1])[::-1][at]
    missing = first - at > reach
    if missing.any():
        least = (h >> np.uint64(32) << np.uint64(32)) | place.view(np.uint64)
        size = 1
        while 2 * size <= reach + 1:
            least[:-size] = np.minimum(least[:-size], least[size:])
            size *= 2
        p = at[missing]
        first[missing] = (np.minimum(least[p], least[p + reach + 1 - size]) & np.uint64(0xFFFFFFFF)).view(np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    last = np.append(fresh[1:], len(at)) - 1
    trigger, far, near = first[fresh], first[fresh] - at[fresh], first[fresh] - at[last]
    parts = []
    for k in range(reach // span + 1):
        has = (far >= k * span) & (near < (k + 1) * span)
        parts.append((trigger[has] - k * span, np.maximum(near[has] - k * span, 0), np.minimum(far[has] - k * span, span - 1)))
    place, near, far = (np.concatenate(x) for x in zip(*parts, strict=True))
    return place, near, far, Keys(data).of(place, length - span + 1)


def pieces(sizes: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, from, to) of about PIECE bytes; pieces of one text overlap by what its strings need."""
    out, total = [], 0
    for row in np.flatnonzero(sizes >= length).tolist():
        for a in range(0, int(sizes[row]) - length + 1, PIECE):
            b = min(int(sizes[row]), a + PIECE + length - 1)
            out.append((row, a, b))
            total += b - a
            if total >= PIECE:
                yield out
                out, total = [], 0
    if out:
        yield out


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column, and where each row's begin (a row more: where they end)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets


def parse(docs: DataFrame, length: int, with_place: bool) -> DataFrame:
    """(doc_id, text_hash, key, at, near, far) per entry of each text, or the keys alone."""
    kept = ["doc_id", "text_hash"] if with_place else []
    extra = [T.StructField("key", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in ("at", "near", "far") if with_place]
    schema = T.StructType([docs.schema[c] for c in kept] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch["text"])
            for part in pieces(np.diff(offsets), length):
                rows, begin, end = (np.array(x) for x in zip(*part, strict=True))
                text = np.concatenate([data[offsets[r] + a : offsets[r] + b] for r, a, b in part])
                ends = np.cumsum(end - begin)
                starts = ends - (end - begin)
                at, near, far, key = entries(text, starts, ends, length)
                own = np.searchsorted(ends, at, side="right")
                columns = {"key": pa.array(key)}
                if with_place:
                    columns = {c: batch[c].take(pa.array(rows[own])) for c in kept} | columns
                    columns |= {"at": pa.array((at - starts[own] + begin[own]).astype(np.int32)), "near": pa.array(near.astype(np.int32)), "far": pa.array(far.astype(np.int32))}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(*kept, "text").mapInArrow(run, schema)


def _matrix(parts: list[bytes], width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """A row for each of some byte strings, filled up with zeros, read backwards or onwards; and their lengths."""
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    m, cell = np.zeros((len(parts), width), dtype=np.uint8), np.arange(width)
    m[cell >= width - sizes[:, None] if backwards else cell < sizes[:, None]] = np.frombuffer(b"".join(parts), dtype=np.uint8)
    return np.ascontiguousarray(m[:, ::-1] if backwards else m), sizes


def _suffix_order(group: np.ndarray, parts: list[bytes], width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings inside their groups, and how much each has in common with the one before it."""
    width += -width % 8
    m, sizes = _matrix(parts, width, backwards)
    words = m.view(">u8").astype(np.uint64)
    order = np.lexsort((sizes, *words.T[::-1], group))
    a, b = order[:-1], order[1:]
    differ = m[a] != m[b]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.where(group[a] == group[b], np.minimum(common, np.minimum(sizes[a], sizes[b])), -1)
    return order, np.concatenate(([-1], common))


def repeated_strings(group: np.ndarray, before: list[bytes], after: list[bytes], times: np.ndarray, length: int, span: int = SPAN) -> np.ndarray:
    """For entries (bytes before the place, bytes from it) a row of ``span`` bits: which of their strings occur again."""
    n = len(group)
    found = np.zeros((n, span), dtype=bool)
    back, back_common = _suffix_order(group, before, span - 1, True)
    on, on_common = _suffix_order(group, after, length, False)
    far = np.fromiter(map(len, before), dtype=np.int64, count=n)
    near = length - np.fromiter(map(len, after), dtype=np.int64, count=n)
    left, right = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for e in range(span):
        left[back] = np.cumsum(back_common < e)
        right[on] = np.cumsum(on_common < length - e)
        rows = np.flatnonzero((near <= e) & (e <= far))
        if len(rows):
            code = left[rows] * (n + 1) + right[rows]
            order = np.argsort(code, kind="stable")
            new = np.concatenate(([True], np.diff(code[order]) != 0))
            total = np.add.reduceat(times[rows][order], np.flatnonzero(new))
            found[rows[order], e] = (total > 1)[np.cumsum(new) - 1]
    return found


def _packed(found: np.ndarray) -> list[np.ndarray]:
    """Bits as two columns of longs."""
    return list(np.packbits(found, axis=1, bitorder="little").view("<i8").T)


ENTRY = ("doc_id", "text_hash", "at")


def contexts(texts: DataFrame) -> DataFrame:
    """Candidate entries with their bytes: what lies before the place in its strings, and what follows it."""
    e = texts.select("doc_id", "text_hash", "length", F.col("text").cast("binary").alias("text"), F.explode("entries").alias("e"))
    before = F.expr("substring(text, e.at - e.far + 1, e.far)")
    return e.select("doc_id", "text_hash", "e.at", "e.key", "e.times", before.alias("before"), F.expr("substring(text, e.at + 1, length - e.near)").alias("after"))


def _compared(rows: DataFrame, length: int, group_rows: int) -> DataFrame:
    """Entries of keys with at most ``group_rows`` occurrences, many keys to a task's group: (entry, m0, m1)."""
    schema = T.StructType([rows.schema[c] for c in ENTRY] + [T.StructField(m, T.LongType()) for m in ("m0", "m1")])

    def run(t: pa.Table) -> pa.Table:
        key = t["key"].combine_chunks().to_numpy()
        one = np.ones(len(key), dtype=np.int64)
        found = repeated_strings(key, t["before"].to_pylist(), t["after"].to_pylist(), one, length)
        bits = _packed(found)
        out = pa.table({c: t[c] for c in ENTRY} | {f"m{i}": pa.array(b) for i, b in enumerate(bits)})
        return out.filter(pa.array(found.any(axis=1)))

    total = rows.count()
    tasks = max(1, total // group_rows)
    return rows.withColumn("bin", F.pmod("key", F.lit(tasks))).groupBy("bin").applyInArrow(run, schema)


def _spelled(rows: DataFrame, length: int) -> DataFrame:
    """Entries of keys with very many occurrences: equal ones are counted first, then every string by its digest."""
    own = F.sha2(F.concat(F.col("before"), F.lit(b"|"), F.col("after"), F.lit(b"|"), F.length("before").cast("string").cast("binary")), 256)
    rows = rows.withColumn("context", F.unhex(own))
    once = rows.groupBy("context").agg(F.count(F.lit(1)).alias("times"), F.any_value("before").alias("before"), F.any_value("after").alias("after"))
    far, near = F.length("before"), length - F.length("after")
    strings = once.select("context", "times", "before", "after", F.explode(F.sequence(near, far)).alias("e"))
    text = F.concat(F.expr("substring(before, length(before) - e + 1, e)"), F.expr(f"substring(after, 1, {length} - e)"))
    strings = strings.select("context", "times", "e", F.unhex(F.sha2(text, 256)).alias("string"))
    again = strings.groupBy("string").agg(F.sum("times").alias("n")).where("n > 1").select("string")
    bit = lambda k: F.expr(f"bit_or(CASE WHEN e DIV 64 = {k} THEN shiftleft(1L, CAST(e % 64 AS INT)) ELSE 0L END)")
    found = strings.join(again, "string", "left_semi").groupBy("context").agg(bit(0).alias("m0"), bit(1).alias("m1"))
    return rows.select(*ENTRY, "context").join(found, "context").select(*ENTRY, "m0", "m1")


def _covered(size: int, marks: list[tuple[int, int, int]], length: int) -> np.ndarray:
    """Which bytes of a text lie in a repeated string."""
    turn = np.zeros(size + 1, dtype=np.int32)
    at = np.array([m[0] for m in marks], dtype=np.int64)
    bits = np.unpackbits(np.array([m[1:] for m in marks], dtype="<i8").view(np.uint8).reshape(len(marks), 16), axis=1, bitorder="little")
    row, e = np.nonzero(bits)
    np.add.at(turn, at[row] - e, 1)
    np.add.at(turn, at[row] - e + length, -1)
    return np.cumsum(turn)[:-1] > 0


def remove_repeats(docs: DataFrame, length: int = 200, group_rows: int = 50_000) -> DataFrame:
    """Every row of ``docs`` without the bytes of strings of ``length`` bytes that start anywhere else too.

    doc_id, n_bytes, n_removed, n_spans, kept (binary; null where nothing is removed: then it is the text), kept_sha256.

    Strings never cross documents and are judged on the input.  Nulls: a null text is empty; a null id is an id of its
    own, and rows of one id with different texts are different documents.  Repeated rows are occurrences of each other, so
    they lose all but texts shorter than ``length``; empty tables give no rows; extra columns are ignored.  Texts of any
    length are parsed whole, in pieces.  Keys with more than ``group_rows`` occurrences are counted by digests of their
    strings in plain aggregates, so no group grows with the corpus.
    """
    if length < SPAN + GRAM:
        raise ValueError(f"strings of at least {SPAN + GRAM} bytes")
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    again = written(parse(docs, length, False).groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "keys")
    found = parse(docs, length, True).join(again, "key")
    lists = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("key", "at", "near", "far", "times")).alias("entries"))
    same = lambda other: F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("d.text_hash") == F.col(f"{other}.text_hash"))
    texts = written(docs.alias("d").join(lists.alias("l"), same("l")).select("d.*", "entries", F.lit(length).alias("length")), "candidates")
    rows = contexts(texts)
    marks = _compared(rows.where(F.col("times") <= group_rows), length, group_rows)
    if not again.where(F.col("times") > group_rows).isEmpty():
        marks = marks.union(_spelled(rows.where(F.col("times") > group_rows), length))
    marks = marks.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "m0", "m1")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch["text"], batch["marks"], strict=True):
                raw = text.as_py().encode()
                gone = _covered(len(raw), [(m["at"], m["m0"], m["m1"]) for m in own.as_py()], length)
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append((len(raw) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
            values = {n: pa.array(c, k) for n, c, k in zip(("n_removed", "n_spans", "kept", "kept_sha256"), columns, kinds, strict=True)}
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("doc_id", "text_hash")} | values)

    schema = T.StructType([docs.schema["doc_id"], docs.schema["text_hash"], *T._parse_datatype_string("n_removed long, n_spans long, kept binary, kept_sha256 string").fields])
    cuts = texts.select("doc_id", "text_hash", "text").dropDuplicates(["doc_id", "text_hash"]).alias("d").join(marks.alias("m"), same("m")).select("d.*", "marks").mapInArrow(cut, schema)
    whole = docs.select("doc_id", "text_hash", n_bytes(F.col("text")).alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    out = whole.alias("d").join(cuts.alias("c"), same("c"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("d.doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), "kept", F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
