"""Exact percentiles of groups of any size by counting passes: no buffer of a group's values, no sort of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditflow.sources.writers import scratch

#: Ranges are cut at so many approximate quantiles; a range with at most FEW rows is settled by its values.
BORDERS, FEW = 64, 1024


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "quantiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_percentiles(rows: DataFrame, by: list[str], value: str, fractions: list[float], few: int = FEW) -> DataFrame:
    """by, then ``p0``, ``p1``, ...: interpolated percentiles of the values that are not null, as ``percentile_cont`` has them.

    A percentile lies between two order statistics.  Each wanted place of a group is looked for in a range of values that
    starts as all: the range is cut at approximate quantiles, bins between them and on them are counted map-side, running
    counts over a group's bins tell which one holds the place, and the next pass counts inside that bin alone.  A pass
    leaves about a 64th of a range, whatever its values are; a value that very many rows have gets a bin of its own.  It
    ends when a place's range has at most ``few`` rows or one value; their distinct values with counts settle it.  Groups
    without values have no row; NaN is greater than all.
    """
    v = F.col(value).cast("double")
    data = rows.select(*by, v.alias("_v")).where("_v IS NOT NULL")
    finite = data.where("NOT isnan(_v) AND abs(_v) < double('infinity')")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    sizes = _stored(
        data.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col("_v") == float("-inf")).alias("_below"),
            F.count_if(~F.isnan("_v") & (F.abs("_v") < float("inf"))).alias("_finite"),
            F.count_if(F.col("_v") == float("inf")).alias("_above"),
            F.min(F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))).alias("low"),
            F.max(F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))).alias("high"),
        )
    )
    place = F.array(*[F.lit(f) for f in fractions])
    at = lambda f: f * (F.col("_n") - 1)
    wanted = sizes.select("*", F.explode(F.flatten(F.transform(place, lambda f: F.array(F.floor(at(f)), F.ceil(at(f)))))).alias("place")).distinct()
    beyond = F.col("_below") + F.col("_finite")
    outside = wanted.where((F.col("place") < F.col("_below")) | (F.col("place") >= beyond))
    extreme = F.when(F.col("place") < F.col("_below"), F.lit(float("-inf"))).when(F.col("place") < beyond + F.col("_above"), F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    found = [outside.select(*by, "place", extreme.alias("v"))]
    # rank: the place inside the range [low, high], which holds ``size`` values.
    open_ = wanted.where((F.col("place") >= F.col("_below")) & (F.col("place") < beyond)).select(*by, "place", (F.col("place") - F.col("_below")).alias("rank"), "low", "high", F.col("_finite").alias("size"))
    while True:
        settled = open_.where("low = high")
        found.append(settled.select(*by, "place", F.col("low").alias("v")))
        open_ = _stored(open_.where("low < high"))
        if open_.isEmpty():
            break
        ready = open_.where(F.col("size") <= few)
        ranges = lambda df: df.select(*by, "low", "high").distinct()
        inside = lambda df: finite.alias("d").join(ranges(df).alias("r"), [*same("d", "r"), F.col("d._v").between(F.col("r.low"), F.col("r.high"))]).select(*[F.col(f"d.{c}") for c in by], "_v", "low", "high")
        counts = inside(ready).groupBy(*by, "low", "high", "_v").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("to", F.sum("n").over(Window.partitionBy(*by, "low", "high").orderBy("_v")))
        hit = counts.alias("c").join(ready.alias("o"), [*same("c", "o"), F.col("c.low") == F.col("o.low"), F.col("c.high") == F.col("o.high"), F.col("c.to") > F.col("o.rank"), F.col("c.to") - F.col("c.n") <= F.col("o.rank")])
        found.append(hit.select(*[F.col(f"o.{c}") for c in by], "o.place", F.col("c._v").alias("v")))
        wide = open_.where(F.col("size") > few)
        cuts = F.percentile_approx("_v", F.array(*[F.lit(i / BORDERS) for i in range(1, BORDERS)]), F.lit(16 * BORDERS))
        cuts = _stored(inside(wide).groupBy(*by, "low", "high").agg(cuts.alias("cuts")))  # a row a range
        held = inside(wide).alias("d").join(cuts.alias("q"), [*same("d", "q"), F.col("d.low") == F.col("q.low"), F.col("d.high") == F.col("q.high")]).select("d.*", "q.cuts")
        at = F.size(F.filter("cuts", lambda x: x < F.col("_v"))) * 2 + F.array_contains("cuts", F.col("_v")).cast("int")
        bins = held.withColumn("bin", at).groupBy(*by, "low", "high", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        bins = bins.withColumn("to", F.sum("n").over(Window.partitionBy(*by, "low", "high").orderBy("bin")))  # at most 2 BORDERS rows
        hit = bins.alias("c").join(wide.alias("o"), [*same("c", "o"), F.col("c.low") == F.col("o.low"), F.col("c.high") == F.col("o.high"), F.col("c.to") > F.col("o.rank"), F.col("c.to") - F.col("c.n") <= F.col("o.rank")])
        open_ = _stored(hit.select(*[F.col(f"o.{c}") for c in by], "o.place", (F.col("o.rank") - (F.col("c.to") - F.col("c.n"))).alias("rank"), F.col("c.least").alias("low"), F.col("c.most").alias("high"), F.col("c.n").alias("size")))
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    values = _stored(values.distinct())
    out = sizes.select(*by, "_n")
    for i, f in enumerate(fractions):
        for side in ("floor", "ceil"):
            own = values.select(*by, F.col("place").alias("_place"), F.col("v").alias(f"_{side}{i}"))
            hit = [*same("x", "y"), F.col("y._place") == getattr(F, side)(F.lit(f) * (F.col("x._n") - 1))]
            out = out.alias("x").join(own.alias("y"), hit).select("x.*", f"y._{side}{i}")
        low, high, part = F.col(f"_floor{i}"), F.col(f"_ceil{i}"), F.lit(f) * (F.col("_n") - 1) - F.floor(F.lit(f) * (F.col("_n") - 1))
        out = out.withColumn(f"p{i}", F.when(low == high, low).otherwise(low + (high - low) * part)).drop(f"_floor{i}", f"_ceil{i}")
    return out.drop("_n")
