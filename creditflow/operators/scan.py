"""Running values along very long keys, and global ranks: a prefix scan over segments.

A window over a key is one task, however many rows the key has.  Here rows are cut by range of (key, order) into
segments, so that a key with half of all rows lies in many of them.  Each segment is scanned alone; its last row says
what it hands on; these few rows are scanned in turn, and what comes out is added to the rows of the segment.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditflow.sources.writers import scratch

SEGMENT = "_segment"


@dataclass(frozen=True)
class Value:
    """What is carried along a key: ``kind`` is lag, last, next, sum or number."""

    kind: str
    of: Column | None = None
    #: ``last`` only: without the row's own value.
    before: bool = False


def lag(of: Column | str) -> Value:
    """The value of the row before, null or not."""
    return Value("lag", F.col(of) if isinstance(of, str) else of)


def last(of: Column | str, before: bool = False) -> Value:
    """The last value so far that is not null; with ``before``, of the rows before this one."""
    return Value("last", F.col(of) if isinstance(of, str) else of, before)


def following(of: Column | str) -> Value:
    """The first value from this row on that is not null."""
    return Value("next", F.col(of) if isinstance(of, str) else of)


def total(of: Column | str) -> Value:
    """The sum so far, this row's value included; null before the first value."""
    return Value("sum", F.col(of) if isinstance(of, str) else of)


def number() -> Value:
    """1, 2, ... along the key."""
    return Value("number")


@dataclass(frozen=True)
class Segments:
    """Rows with the number of their segment, cut by ``by`` and ``order``; see :meth:`cut`."""

    rows: DataFrame
    by: tuple[str, ...]
    order: tuple[Column, ...]
    #: The rows of keys that lie in several segments: only these can hand anything on.
    divided: DataFrame
    #: The rows of keys that were left whole, and whether these are all rows; see :meth:`long_keys`.
    uncut: DataFrame | None = None
    only_uncut: bool = False

    @classmethod
    def cut(cls, rows: DataFrame, by: tuple[str, ...], order: list[Column | str], segments: int | None = None) -> Segments:
        """Write ``rows`` in ``segments`` ranges (as many as the session's shuffles have partitions) of key and order.

        They are written, as a second pass over the same plan could cut elsewhere.  Rows that agree in key and order stay
        together, and their order among each other is not defined.
        """
        spark = rows.sparkSession
        order = [F.col(c).asc() if isinstance(c, str) else c for c in order]
        n = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = scratch(spark, "segments")
        rows.repartitionByRange(n, *[F.col(b).asc() for b in by], *order).withColumn(SEGMENT, F.spark_partition_id()).write.parquet(path)
        cut = spark.read.parquet(path)
        if not by:
            return cls(cut, (), tuple(order), cut)
        keys = cut.select(SEGMENT, *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(b).alias(f"_d_{b}") for b in by])
        keys = spark.createDataFrame(keys.collect(), keys.schema)  # fewer rows than segments, as a border divides one key at most
        same = [F.col(b).eqNullSafe(F.col(f"_d_{b}")) for b in by]
        return cls(cut, tuple(by), tuple(order), cut.join(F.broadcast(keys), same, "left_semi"))

    @classmethod
    def long_keys(cls, rows: DataFrame, by: tuple[str, ...], order: list[Column | str], segments: int | None = None) -> Segments:
        """As :meth:`cut`, but only keys with more rows than a segment should have are cut.

        The others are left to windows over whole keys: one shuffle by key, which what follows can use too, and nothing
        written.  ``rows`` are read once more to count them, so they should be cheap to read.
        """
        order = [F.col(c).asc() if isinstance(c, str) else c for c in order]
        n = segments or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = long_keys(rows, by, n)
        if keys is None:
            return cls(rows, tuple(by), tuple(order), rows, rows, True)
        same = [F.col(b).eqNullSafe(F.col(f"_d_{b}")) for b in by]
        return replace(cls.cut(rows.join(F.broadcast(keys), same, "left_semi"), by, order, n), uncut=rows.join(F.broadcast(keys), same, "left_anti"))

    def where(self, condition: Column | str) -> Segments:
        uncut = None if self.uncut is None else self.uncut.where(condition)
        return replace(self, rows=self.rows.where(condition), divided=self.divided.where(condition), uncut=uncut)

    def _whole(self, values: dict[str, Value]) -> DataFrame:
        """The uncut rows with running values: plain windows over their keys."""
        own = Window.partitionBy(*self.by).orderBy(*self.order)
        so_far, earlier, onwards = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(0, Window.unboundedFollowing)
        found = {
            "lag": lambda v: F.lag(v.of).over(own),
            "last": lambda v: F.last(v.of, ignorenulls=True).over(earlier if v.before else so_far),
            "next": lambda v: F.first(v.of, ignorenulls=True).over(onwards),
            "sum": lambda v: F.sum(v.of).over(so_far),
            "number": lambda v: F.row_number().over(own).cast("long"),
        }
        return self.uncut.withColumns({name: found[v.kind](v) for name, v in values.items()})

    def with_columns(self, values: dict[str, Value]) -> Segments:
        """The rows with running values, as windows over whole keys would give them.

        What segments hand on is found in the rows of keys that lie in several, so that one shuffle brings all other rows
        to their segments, however many scans follow each other.  It is joined by broadcast: each border between two
        segments cuts one key at most, so there are fewer than two such rows a segment.
        """
        uncut = None if self.uncut is None else self._whole(values)
        if self.only_uncut:
            return replace(self, rows=uncut, divided=uncut, uncut=uncut)
        own = Window.partitionBy(SEGMENT, *self.by).orderBy(*self.order)
        so_far, earlier = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
        onwards, whole = own.rowsBetween(0, Window.unboundedFollowing), own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        local: dict[str, Column] = {"_turn": F.row_number().over(own), "_end": F.lead(F.lit(1)).over(own).isNull()}
        hand: dict[str, Column] = {}
        for name, v in values.items():
            if v.kind == "lag":
                local[f"_l_{name}"], hand[f"_h_{name}"] = F.lag(v.of).over(own), v.of
            elif v.kind == "last":
                local[f"_l_{name}"] = F.last(v.of, ignorenulls=True).over(earlier if v.before else so_far)
                hand[f"_h_{name}"] = F.last(v.of, ignorenulls=True).over(so_far)
            elif v.kind == "next":
                local[f"_l_{name}"] = F.first(v.of, ignorenulls=True).over(onwards)
                hand[f"_h_{name}"] = F.first(v.of, ignorenulls=True).over(whole)
            elif v.kind == "sum":
                local[f"_l_{name}"] = hand[f"_h_{name}"] = F.sum(v.of).over(so_far)
            elif v.kind == "number":
                local[f"_l_{name}"] = hand[f"_h_{name}"] = F.row_number().over(own).cast("long")
            else:
                raise ValueError(v.kind)
        ends = self.divided.select("*", *[c.alias(n) for n, c in hand.items()], local["_end"].alias("_end")).where("_end").select(SEGMENT, *self.by, *hand)
        key = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(0))  # one row a segment
        before = key.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
        after = key.orderBy(SEGMENT).rowsBetween(1, Window.unboundedFollowing)
        carried: dict[str, Column] = {"_several": F.count(F.lit(1)).over(key) > 1}
        for name, v in values.items():
            h = F.col(f"_h_{name}")
            carried[f"_c_{name}"] = {
                "lag": lambda h=h: F.lag(h).over(key.orderBy(SEGMENT)),
                "last": lambda h=h: F.last(h, ignorenulls=True).over(before),
                "next": lambda h=h: F.first(h, ignorenulls=True).over(after),
                "sum": lambda h=h: F.sum(h).over(before),
                "number": lambda h=h: F.sum(h).over(before),
            }[v.kind]()
        carry = ends.select(F.col(SEGMENT).alias("_s"), *[F.col(b).alias(f"_k_{b}") for b in self.by], *[c.alias(n) for n, c in carried.items()]).where("_several").drop("_several")
        same = F.col(SEGMENT) == F.col("_s")
        for b in self.by:
            same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
        out: dict[str, Column] = {}
        for name, v in values.items():
            here, came = F.col(f"_l_{name}"), F.col(f"_c_{name}")
            if v.kind == "lag":
                out[name] = F.when(F.col("_turn") == 1, came).otherwise(here)
            elif v.kind in ("last", "next"):
                out[name] = F.coalesce(here, came)
            else:
                out[name] = F.when(here.isNotNull() | came.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(came, F.lit(0)))
        scanned = lambda rows: rows.withColumns(local).join(F.broadcast(carry), same, "left").withColumns(out).select(*rows.columns, *values)
        whole_rows = scanned(self.rows)
        return replace(self, rows=whole_rows, divided=scanned(self.divided) if self.by else whole_rows, uncut=uncut)

    def done(self) -> DataFrame:
        if self.uncut is None or self.only_uncut:
            return self.rows.drop(SEGMENT)
        return self.rows.drop(SEGMENT).unionByName(self.uncut)


def long_keys(rows: DataFrame, by: tuple[str, ...], segments: int | None = None) -> DataFrame | None:
    """The keys with more rows than a segment (one of as many as shuffles have partitions) should have, as ``_d_`` columns; fewer than segments."""
    spark = rows.sparkSession
    n = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    keys = counts.where(F.col("_n") > max(1.0, rows.count() / n)).select(*[F.col(b).alias(f"_d_{b}") for b in by])
    found = keys.collect()
    return spark.createDataFrame(found, keys.schema) if found else None


def global_rank(rows: DataFrame, order: list[Column | str], name: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """``row_number`` over whole groups or all rows at once, without bringing a group into one task."""
    return Segments.cut(rows, by, order).with_columns({name: number()}).done()
