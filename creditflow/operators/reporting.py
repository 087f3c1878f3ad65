"""Marts for people: funnel, journeys, model comparison, and the data behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditflow.functions.columns import divide
from creditflow.operators.scan import global_rank
from creditflow.operators.sessions import eligible
from creditflow.settings import Settings

FUNNEL_EVENTS = ("view_item", "add_to_cart", "begin_checkout", "purchase")


def channel_funnel(base: DataFrame, sessions: DataFrame, s: Settings) -> DataFrame:
    """Per channel the sessions that had each event, in any order, over all eligible sessions.

    Events become flags of a session first, so no distinct counts are needed afterwards.
    """
    key = ["user_pseudo_id", "session_key"]  # a session is of one user, so tables that lie together by user are not shuffled
    flags = base.where("session_key IS NOT NULL").groupBy(*key).agg(*[F.max((F.col("event_name") == e).cast("int")).alias(e) for e in FUNNEL_EVENTS])
    rows = eligible(sessions).select(*key, "channel").join(flags, key, "left")
    out = rows.groupBy("channel").agg(F.count(F.lit(1)).alias("sessions"), *[F.coalesce(F.sum(e), F.lit(0)).alias(f"sessions_with_{e}") for e in FUNNEL_EVENTS])
    return out.withColumns({f"{e}_rate": divide(F.col(f"sessions_with_{e}"), F.col("sessions")) for e in FUNNEL_EVENTS} | {"reporting_version": F.lit(s.reporting_version)})


def order_paths(paths: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("touchpoint_number", "channel")))
    rows = paths.groupBy("order_key").agg(F.max("order_revenue_usd").alias("revenue"), F.max("path_length").alias("path_length"), F.transform(ordered, lambda x: x["channel"]).alias("p"))
    return rows.select("order_key", "revenue", "path_length", F.col("p")[0].alias("first_touch"), F.element_at("p", -1).alias("last_touch"), F.array_join("p", " > ").alias("converting_path"))


def _tagged(rows: DataFrame) -> DataFrame:
    """Sums of order paths by (summary_type, dimension_key): each order is tagged once for every summary."""
    tag = lambda t, key: F.struct(F.lit(t).alias("summary_type"), key.alias("dimension_key"))
    tags = F.array(
        tag("OVERALL", F.lit("all_attributable_conversions")),
        tag("PATH_LENGTH", F.col("path_length").cast("string")),
        tag("CONVERTING_PATH", F.col("converting_path")),
        tag("FIRST_TOUCH_CHANNEL", F.col("first_touch")),
        tag("LAST_TOUCH_CHANNEL", F.col("last_touch")),
    )
    members = rows.select("revenue", "path_length", F.explode(tags).alias("t")).groupBy("t.summary_type", "t.dimension_key")
    members = members.agg(F.count(F.lit(1)).alias("conversions"), F.sum("revenue").alias("revenue"), F.avg("path_length").alias("mean"), F.count_if(F.col("path_length") == 1).alias("single"), F.max("path_length").alias("length"))
    return members


#: Sums of revenue that agree to so many places are equal for ranks, in whatever order they were summed.
RANK_DIGITS = 6


def _order(name: str = "dimension_key") -> list:
    return [F.desc("conversions"), F.desc(F.round("revenue", RANK_DIGITS)), F.asc(name)]


def journey_summary(paths: DataFrame, s: Settings) -> DataFrame:
    """Tagged rows: overall, by path length, by path, by first and by last channel.

    Each order is tagged once for every summary and everything is summed together.  Ranks inside a summary are given over
    ranges of its order, so that very many different paths are no single task's.
    """
    rows = order_paths(paths)
    members = global_rank(_tagged(rows), _order(), "rank", ("summary_type",))
    totals = rows.agg(F.count(F.lit(1)).alias("all_conversions"), F.sum("revenue").alias("all_revenue"), F.percentile("path_length", F.lit(0.5)).alias("median"))
    kind = F.col("summary_type")
    overall, length = kind == "OVERALL", kind == "PATH_LENGTH"
    out = members.crossJoin(F.broadcast(totals))  # one row
    return out.select(
        "summary_type",
        "dimension_key",
        F.when(overall, "All attributable conversions").when(length, F.concat("dimension_key", F.lit(" touchpoint(s)"))).otherwise(F.col("dimension_key")).alias("dimension_label"),
        F.when(length, F.col("length")).otherwise(F.col("rank")).cast("long").alias("sort_order"),
        F.col("conversions").alias("attributable_conversions"),
        F.col("revenue").alias("attributable_revenue"),
        divide(F.col("conversions"), F.col("all_conversions")).alias("conversion_share"),
        divide(F.col("revenue"), F.col("all_revenue")).alias("revenue_share"),
        F.when(overall | length, F.col("mean")).alias("mean_path_length"),
        F.when(overall, F.col("median")).when(length, F.col("length").cast("double")).alias("median_path_length"),
        F.when(overall, F.col("single")).alias("single_touch_conversions"),
        F.when(overall, divide(F.col("single"), F.col("conversions"))).alias("single_touch_conversion_share"),
        F.when(overall, F.col("conversions") - F.col("single")).alias("multi_touch_conversions"),
        F.when(overall, divide(F.col("conversions") - F.col("single"), F.col("conversions"))).alias("multi_touch_conversion_share"),
        F.lit(s.reporting_version).alias("reporting_version"),
    )


def business_summary(comparison: DataFrame, scenarios: DataFrame, bootstrap: DataFrame, s: Settings) -> DataFrame:
    """The comparison with revenue shares and ranks, Markov's difference from Last Click and its stability."""
    model = Window.partitionBy("model")
    rows = comparison.withColumns({"revenue_share": divide(F.col("attributed_revenue"), F.sum("attributed_revenue").over(model)), "revenue_rank": F.row_number().over(model.orderBy(F.desc("attributed_revenue"), "channel")).cast("long")})
    channel = Window.partitionBy("channel")
    markov = lambda c: F.max(F.when(F.col("model") == "Markov", F.col(c))).over(channel)
    rows = rows.withColumns({f"markov_minus_last_click_{n}": markov(f"{n}_difference_vs_last_click") for n in ("conversions", "revenue")})
    stable = scenarios.groupBy("channel").agg(
        F.count_distinct("scenario").alias("scenarios"),
        F.min("channel_rank").alias("minimum_scenario_rank"),
        F.max("channel_rank").alias("maximum_scenario_rank"),
        divide(F.count_if(F.col("channel_rank") == 1), F.count(F.lit(1))).alias("scenario_rank_1_frequency"),
        divide(F.count_if(F.col("channel_rank") <= 3), F.count(F.lit(1))).alias("scenario_top_3_frequency"),
        F.min("attribution_share").alias("minimum_scenario_share"),
        F.max("attribution_share").alias("maximum_scenario_share"),
    )
    draws = bootstrap.select("channel", *[F.col(c).alias(f"bootstrap_{c}") for c in bootstrap.columns if c != "channel"])
    out = rows.join(F.broadcast(stable), "channel").join(F.broadcast(draws), "channel")  # a row per channel
    return out.withColumns({"is_presentation_channel": ~F.col("channel").isin("Unknown", "Other"), "reporting_version": F.lit(s.reporting_version)})


def funnel_problems(funnel: DataFrame) -> DataFrame:
    """(check, violations) of a funnel mart."""
    missing = {"channel", "sessions", *[f"{e}_rate" for e in FUNNEL_EVENTS]} - set(funnel.columns)
    if missing:
        raise ValueError(f"funnel lacks {sorted(missing)}")
    rates = [F.col(f"{e}_rate") for e in FUNNEL_EVENTS]
    bad = F.lit(False)
    for r in rates:
        bad = bad | r.isNull() | F.isnan(r) | (r < 0) | (r > 1)
    one = funnel.agg(
        (F.count(F.lit(1)) == 0).cast("long").alias("is_empty"),
        (F.count(F.lit(1)) - F.count_distinct("channel")).alias("repeated_channels"),
        F.count_if(F.col("sessions") <= 0).alias("channels_without_sessions"),
        F.count_if(bad).alias("rates_out_of_range"),
    )
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in one.columns])).alias("x")).select("x.*")


def top_paths(paths: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent converting paths: each task's first n are merged, nothing else is ordered."""
    rows = order_paths(paths).groupBy(F.col("converting_path").alias("dimension_key")).agg(F.count(F.lit(1)).alias("conversions"), F.sum("revenue").alias("revenue"))
    first = rows.orderBy(*_order()).limit(n)
    rank = F.row_number().over(Window.orderBy(*_order())).cast("long")  # of n rows
    return first.select("dimension_key", rank.alias("sort_order"), F.col("conversions").alias("attributable_conversions"), F.col("revenue").alias("attributable_revenue"))


def path_length_bins(summary: DataFrame, cap: int = 10) -> DataFrame:
    """Conversions by length, all of at least ``cap`` together."""
    rows = summary.where("summary_type = 'PATH_LENGTH'")
    label = F.when(F.col("sort_order") >= cap, f"{cap}+").otherwise(F.col("sort_order").cast("string"))
    out = rows.groupBy(F.least(F.col("sort_order"), F.lit(cap)).alias("bin_order"), label.alias("bin")).agg(F.sum("attributable_conversions").alias("conversions"))
    total = rows.agg(F.sum("attributable_conversions").alias("total"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", divide(F.col("conversions"), F.col("total"))).drop("total")


def chart_revenue_by_model(comparison: DataFrame) -> DataFrame:
    """channel and a revenue column per model."""
    from creditflow.settings import RULE_MODELS

    return comparison.groupBy("channel").pivot("model", [*RULE_MODELS, "Markov"]).agg(F.first("attributed_revenue"))


def chart_markov_difference(comparison: DataFrame) -> DataFrame:
    return comparison.where("model = 'Markov'").select("channel", "revenue_difference_vs_last_click").orderBy("revenue_difference_vs_last_click")
