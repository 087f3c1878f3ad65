"""Rule-based attribution and model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditflow.functions.columns import divide
from creditflow.settings import RULE_MODELS, Settings

#: Column prefix of each rule model in the wide comparison.
PREFIX = dict(zip(RULE_MODELS, ("first_click", "last_click", "last_non_direct", "linear", "time_decay"), strict=True))


def model_weights(paths: DataFrame, s: Settings, by: tuple[str, ...] = ("order_key",)) -> DataFrame:
    """Touchpoints with a weight per model.

    All five models come from one window over the order and one explode, so paths are read and sorted once.
    """
    order = Window.partitionBy(*by)
    n, length = F.col("touchpoint_number"), F.col("path_length")
    rows = paths.withColumns(
        {
            "_last_other": F.max(F.when(F.col("channel") != "Direct", n)).over(order),
            "_decay": F.pow(F.lit(0.5), F.col("seconds_before_conversion").cast("double") / F.lit(float(s.half_life_seconds))),
        }
    )
    rows = rows.withColumn("_decay", divide(F.col("_decay"), F.sum("_decay").over(order)))
    one = lambda test: F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))
    weights: tuple[Column, ...] = (one(n == 1), one(n == length), one(n == F.coalesce("_last_other", length)), divide(F.lit(1.0), length), F.col("_decay"))
    models = F.array(*[F.struct(F.lit(m).alias("model"), w.alias("weight")) for m, w in zip(RULE_MODELS, weights, strict=True)])
    rows = rows.withColumn("m", F.explode(models)).withColumns({"model": F.col("m.model"), "attribution_weight": F.col("m.weight")})
    return rows.drop("m", "_last_other", "_decay").where("attribution_weight > 0")


def attribution_results(paths: DataFrame, s: Settings, by: tuple[str, ...] = ("order_key",)) -> DataFrame:
    """order x model x channel."""
    w = model_weights(paths, s, by)
    return (
        w.groupBy("order_key", "user_pseudo_id", "order_ts", "order_revenue_usd", "model", "channel")
        .agg(F.sum("attribution_weight").alias("attributed_conversion"), F.sum(F.col("order_revenue_usd") * F.col("attribution_weight")).alias("attributed_revenue"), F.max("path_length").alias("path_length"))
        .withColumn("half_life_days", F.when(F.col("model") == "Time Decay", F.lit(s.half_life_seconds / 86_400)))
    )


def channel_totals(results: DataFrame) -> DataFrame:
    return results.groupBy("channel", "model").agg(F.sum("attributed_conversion").alias("attributed_conversions"), F.sum("attributed_revenue").alias("attributed_revenue"))


def model_comparison(results: DataFrame) -> DataFrame:
    """One row per channel: conversions, revenue and shares of each model, and differences from Last Click."""
    agg = []
    for model, p in PREFIX.items():
        for source, name in (("attributed_conversion", "conversions"), ("attributed_revenue", "revenue")):
            agg.append(F.sum(F.when(F.col("model") == model, F.col(source)).otherwise(F.lit(0.0))).alias(f"{p}_{name}"))
    wide = results.groupBy("channel").agg(*agg)
    totals = wide.agg(*[F.sum(c).alias(f"total_{c}") for c in wide.columns if c != "channel"])
    rows = wide.crossJoin(F.broadcast(totals))  # one row
    for c in wide.columns[1:]:
        rows = rows.withColumn(f"{c}_share", divide(F.col(c), F.col(f"total_{c}")))
    for p in ("last_non_direct", "linear", "time_decay"):
        rows = rows.withColumn(f"{p}_minus_last_click_conversions", F.col(f"{p}_conversions") - F.col("last_click_conversions"))
    return rows.drop(*totals.columns)


def rule_markov_comparison(results: DataFrame, markov: DataFrame) -> DataFrame:
    """Every channel under every model, with rank and difference from Last Click; absent pairs are 0."""
    totals = channel_totals(results).unionByName(markov.select("channel", F.lit("Markov").alias("model"), "attributed_conversions", "attributed_revenue"))
    models = F.explode(F.array(*[F.lit(m) for m in (*RULE_MODELS, "Markov")])).alias("model")
    grid = totals.select("channel").distinct().select("channel", models)
    rows = grid.join(totals, ["channel", "model"], "left").fillna(0.0, ["attributed_conversions", "attributed_revenue"])
    model = Window.partitionBy("model")
    rows = rows.withColumns(
        {
            "attribution_share": divide(F.col("attributed_conversions"), F.sum("attributed_conversions").over(model)),
            "channel_rank": F.dense_rank().over(model.orderBy(F.desc("attributed_conversions"), "channel")).cast("long"),
        }
    )
    base = Window.partitionBy("channel")
    for name in ("conversions", "revenue"):
        rows = rows.withColumn(f"last_click_attributed_{name}", F.max(F.when(F.col("model") == "Last Click", F.col(f"attributed_{name}"))).over(base))
        gap = F.col(f"attributed_{name}") - F.col(f"last_click_attributed_{name}")
        rows = rows.withColumn(f"{name}_difference_vs_last_click", gap).withColumn(f"{name}_relative_difference_vs_last_click", divide(gap, F.col(f"last_click_attributed_{name}")))
    return rows
