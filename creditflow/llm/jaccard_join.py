"""Exact n-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams, as 64-bit hashes; equal sets are one node.  N-grams have a global
order, by hash.  For the pairs that may link the order is cut into fragments; their overlap is counted fragment by
fragment and the partial counts are summed per pair.

Which pairs may link:

* Sets that meet the threshold share at least ``l`` of the first ``n - ceil(t n) + l`` n-grams of each.  Over the whole
  table the nodes of every such n-gram are counted.  A node with fewer than ``l`` shared ones links with nothing; the
  others keep their rarest, so many that a linking pair shares one of them.
* The node of a kept n-gram's bucket with the fewest n-grams of its own is its pivot.  Nodes are gathered by
  pivot, not by n-gram, so what a group of copies shares many times is looked at once.
* Members meet the pivot first, and after that one head of those that no head has united yet; this joins dense
  groups by few links.  At the end members of different components meet each other, so no link is lost.  Sizes and a
  parity sketch, whose Hamming distance never exceeds the sets' difference, drop pairs inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditflow.llm.components import components
from creditflow.llm import memo
from creditflow.llm.shared import BROADCAST_ROWS, side, small_batches, written

_lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SKETCH_WORDS = 16
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), "uint64", len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word ``width``-grams; of its whole sequence, if that is shorter."""
    words = text.encode().translate(_lower).split() if text else []
    if not words:
        return np.zeros(0, "int64")
    h = _word_hashes(words)
    n = len(h) - width + 1
    if n < 1:  # the number of words is part of the hash
        h, n, width = h[:], 1, len(h)
    out = np.full(n, width, "uint64")
    for k in range(width):
        out = _mix(out + h[k : k + n])
    return np.unique(out).view("int64") if n > 1 else out.view("int64")


def _node(s: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _share(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def first_grams(s: np.ndarray, percent: int, extra: int) -> np.ndarray:
    """The n-grams among which a linking pair shares ``ceil(extra n)`` at least, n being the smaller set's size."""
    n = len(s)
    return s[: n - _share(n, percent) + _share(n, extra)]


def _sketch(s: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parities of the n-grams that fall on each bit; halves of a longer one, XORed, are the next shorter one."""
    bits = np.bincount((s.view("uint64") % np.uint64(64 * words)).astype("int64"), minlength=64 * words) & 1
    return np.packbits(bits.astype("uint8")).view("int64")


def _fine_words(n: int) -> int:
    """Words of the longer sketch, of two bits an n-gram; 0 where the short one has that."""
    words = 1 << max(0, (2 * n - 1) // 64).bit_length()
    return words if words > SKETCH_WORDS else 0


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype("int32")  # batches are bounded by bytes
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, "int64")))


def _signatures(rows: DataFrame, width: int, percent: int, extra: int) -> DataFrame:
    """doc_id, key, node, n, the sketch's words, fine (a longer sketch of long sets, else empty), grams (``first_grams``)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.forget()
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            sketches = np.stack([_sketch(s) for s in sets]) if sets else np.zeros((0, SKETCH_WORDS), "int64")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array([_node(s) for s in sets], "int64"),
                    pa.array([len(s) for s in sets], "int64"),
                    *[pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(SKETCH_WORDS)],
                    _lists([_sketch(s, w) if (w := _fine_words(len(s))) else s[:0] for s in sets]),
                    _lists([first_grams(s, percent, extra) for s in sets]),
                ],
                names=["doc_id", "key", "node", "n", *SKETCH, "fine", "grams"],
            )

    longs = ", ".join(f"{c} long" for c in ("doc_id", "key", "node", "n", *SKETCH))
    return rows.mapInArrow(sign, f"{longs}, fine array<long>, grams array<long>")


def _nodes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, rid) of all sets, rid being the smallest document id; and one signature of each node."""
    real = signed.where("n > 0 AND doc_id IS NOT NULL")
    ids = real.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    nodes = written(ids.groupBy("node").agg(F.min("doc_id").alias("rid"), F.count(F.lit(1)).alias("ids"), F.max("times").alias("times")), "nodes")
    copied = side(nodes.where("ids > 1").select("node", "rid"))
    copies = written(real.select("node", "doc_id").join(copied, "node").where("doc_id <> rid").select("node", "doc_id"), "copies")
    few = copies.count() <= BROADCAST_ROWS
    once = real.join(F.broadcast(copies) if few else copies, ["node", "doc_id"], "left_anti").drop("doc_id", "key")
    repeated = nodes.where("times > 1").select("node")  # the same id and text in several rows
    if not repeated.isEmpty():
        repeated = side(repeated)
        once = once.join(repeated, "node", "left_anti").union(once.join(repeated, "node", "left_semi").dropDuplicates(["node"]))
    return nodes.select("node", "rid"), once if few else written(once, "one")  # so that it is shuffled once


def _kept_grams(one: DataFrame, percent: int, extra: int) -> DataFrame:
    """(gram, node, own): the grams that a node keeps, and how many of its first ones no other node has."""
    grams = one.select("node", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rare = grams.join(shared, "gram").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("rare"))
    share = lambda n, p: F.ceil(n * p / F.lit(100.0) - F.lit(1e-9)).cast("int")
    found = one.select("node", "n").join(rare, "node")
    found = found.withColumn("first", (F.col("n") - share(F.col("n"), percent)).cast("int") + share(F.col("n"), extra))
    found = found.withColumn("own", F.col("first") - F.size("rare"))
    keep = F.col("first") - share(share(F.col("n"), percent), extra) + 1 - F.col("own")
    return found.where(keep > 0).select("node", "own", F.explode(F.slice("rare", F.lit(1), keep)).alias("r")).select("r.gram", "node", "own")


def _members(kept: DataFrame, one: DataFrame) -> DataFrame:
    """(pivot, node, own, n, sketch): every node beside the pivot of each of its buckets, once."""
    kept = written(kept, "kept")
    heads = kept.groupBy("gram").agg(F.min(F.struct("own", "node")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    found = kept.join(heads.select("gram", F.col("head.node").alias("pivot")), "gram").select("pivot", "node", "own").distinct()
    return written(found.join(one.select("node", "n", *SKETCH), "node"), "members")


def _alike(na: Column, nb: Column, percent: int) -> Column:
    """Whether sets of these sizes can meet the threshold."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _spare(na: Column, nb: Column, percent: int) -> Column:
    """The largest symmetric difference of sets of these sizes that link."""
    return na + nb - 2 * F.ceil((na + nb) * percent / F.lit(100.0 + percent) - F.lit(1e-9)).cast("long")


def _meet(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of one pivot and two components that sizes and sketches let link."""
    p, q = left.alias("p"), right.alias("q")
    differ = sum((F.bit_count(F.col(f"p.{s}").bitwiseXOR(F.col(f"q.{s}"))) for s in SKETCH), F.lit(0))
    na, nb = F.col("p.n"), F.col("q.n")
    on = (F.col("p.pivot") == F.col("q.pivot")) & (F.col("p.label") != F.col("q.label")) & _alike(na, nb, percent) & (differ <= _spare(na, nb, percent))
    a, b = F.struct(F.col("p.node").alias("x"), na.alias("n")), F.struct(F.col("q.node").alias("x"), nb.alias("n"))
    ends = p.join(q, on).select(F.least(a, b).alias("l"), F.greatest(a, b).alias("r")).distinct()
    return ends.select(F.col("l.x").alias("a"), F.col("r.x").alias("b"), F.col("l.n").alias("na"), F.col("r.n").alias("nb"))


def _fragments(rows: DataFrame, ids: DataFrame, width: int, fragment_bits: int) -> DataFrame:
    """node, fragment, part (the set's n-grams there) of the documents in ``ids``; their whole sets are made again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fragments, parts = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                at = (s.view("uint64") >> np.uint64(64 - fragment_bits)).astype("int64")
                cuts = np.searchsorted(at, np.arange((1 << fragment_bits) + 1))
                for f, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if x < y:
                        nodes.append(_node(s))
                        fragments.append(f)
                        parts.append(s[x:y])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, "int64"), pa.array(fragments, "int32"), _lists(parts)], names=["node", "fragment", "part"])

    return rows.join(side(ids), "doc_id").select("text").mapInArrow(cut, "node long, fragment int, part array<long>")


def _differ(x: Column, y: Column) -> Column:
    """Hamming distance of two sketches: at most the sets' symmetric difference."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


def _folded(x: Column) -> Column:
    half = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))


class _Verifier:
    """Which of the pairs that may link do: whole sets, cut into fragments of the global order."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, one: DataFrame, width: int, percent: int, fragment_bits: int):
        self.rows, self.nodes, self.width, self.percent, self.bits = rows, nodes, width, percent, fragment_bits
        self.fine = written(one.where(F.size("fine") > 0).select("node", "fine"), "fine")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        long = F.least("na", "nb") > 32 * SKETCH_WORDS  # both have the longer sketch, of one length or the double
        fine = lambda x: self.fine.select(F.col("node").alias(x), F.col("fine").alias(f"f{x}"))
        folded = lambda x, y: F.when(F.size(x) > F.size(y), _folded(F.col(x))).otherwise(F.col(x))
        looked = pairs.where(long).join(fine("a"), "a").join(fine("b"), "b")
        looked = looked.where(_differ(folded("fa", "fb"), folded("fb", "fa")) <= _spare(F.col("na"), F.col("nb"), self.percent))
        pairs = written(pairs.where(~long).unionByName(looked.select(*pairs.columns)), "pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ids = written(ends.join(self.nodes, "node").select(F.col("rid").alias("doc_id")).distinct(), "ids")
        parts = written(_fragments(self.rows, ids, self.width, self.bits), "fragments")
        part = lambda x: parts.select(F.col("node").alias(x), "fragment", F.col("part").alias(f"p{x}"))
        partial = pairs.join(part("a"), "a").join(part("b"), ["b", "fragment"])
        partial = partial.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("pa", "pb")).cast("long").alias("common"))
        partial = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("common").alias("common"))  # repeated rows count once
        summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
        return written(summed.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * self.percent).select("a", "b"), "links")


def _components(df: DataFrame, width: int, percent: int, id_col: str, text_col: str, extra: int, fragment_bits: int, head_rounds: int) -> DataFrame:
    """doc_id, key (of the text), n_shingles, component_id for every row."""
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    signed = written(_signatures(rows, width, percent, extra), "signatures")
    nodes, one = _nodes(signed)
    members = _members(_kept_grams(one, percent, extra), one)
    verify = _Verifier(rows, nodes, one, width, percent, fragment_bits)
    alone = members.withColumn("label", F.col("node"))
    links = verify(_meet(alone, alone.where("node = pivot"), percent))
    labels = components(links)
    heads = members.select("pivot", F.col("pivot").alias("node")).distinct()
    for k in range(head_rounds + 1):
        named = members.join(labels.withColumnRenamed("x", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_ = written(named.groupBy("pivot").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("pivot"), "open")
        if open_.isEmpty():
            break
        named = written(named.join(open_, "pivot"), "named")
        met = named
        if k < head_rounds:  # of those that no head of their group has united, one is the next head
            united = named.join(heads, ["pivot", "node"]).select("pivot", "label").distinct()
            head = named.join(united, ["pivot", "label"], "left_anti").groupBy("pivot").agg(F.min(F.struct("own", "node")).alias("h"))
            head = written(head.select("pivot", "h.node"), "heads")
            heads = heads.union(head)
            met = named.join(head, ["pivot", "node"]).select(*named.columns)
        links = written(links.union(verify(_meet(named, met, percent))), "links")
        labels = components(links)
    tops = nodes.join(labels.withColumnRenamed("x", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    tops = written(tops.select("node", "rid", "label"), "tops")
    least = tops.groupBy("label").agg(F.min("rid").alias("component_id"))
    tops = written(tops.join(least, "label").select("node", "component_id"), "tops")
    out = signed.select("doc_id", "key", F.col("n").alias("n_shingles"), "node").join(tops, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "key", "n_shingles", own.alias("component_id"))


def jaccard_components(
    df: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    extra: int = 10,
    fragment_bits: int = 3,
    head_rounds: int = 2,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: components of links with ``100 I >= percent U``.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  Fewer than ``width`` words make one n-gram of
    the whole sequence; none make an empty set, which links with nothing (its component is its own id).  A null text
    is empty; a row with a null id takes part in nothing and has a null component.  Rows that repeat an id
    are documents of their own: each has its text's component, named by the smallest id in it, so two
    components may have one name where an id repeats.  Equal texts share a component whatever their ids.  Whole texts
    are used, extra columns are ignored, an empty table gives no rows.

    ``extra`` (a percentage of a set, at most ``percent``) and ``head_rounds`` change the work, never the result.
    """
    found = _components(df, width, percent, id_col, text_col, extra, fragment_bits, head_rounds)
    return found.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")


def keep_first(
    df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", extra: int = 10, fragment_bits: int = 3, head_rounds: int = 2
) -> DataFrame:
    """The rows of ``df`` that have the smallest id of their text's component; rows with a null id all stay.

    Rows of one component that repeat the kept id all stay.  Columns keep their names, values and order, whatever
    they are called.
    """
    found = _components(df, width, percent, id_col, text_col, extra, fragment_bits, head_rounds)
    gone = side(written(found.where("doc_id <> component_id").select("doc_id", "key").distinct(), "gone")).alias("gone")
    key = F.xxhash64(F.coalesce(F.col(f"rows.{text_col}"), F.lit("")))
    return df.alias("rows").join(gone, (F.col(f"rows.{id_col}").cast("long") == F.col("gone.doc_id")) & (key == F.col("gone.key")), "left_anti")
