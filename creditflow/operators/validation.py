"""Checks as rows, reconciliation, fingerprints."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditflow.operators.paths import ORDER
from creditflow.settings import CONVERSION, NULL, START, Settings


@dataclass(frozen=True)
class Check:
    """Rows of ``violations`` break the rule; none is expected."""

    check_id: str
    violations: DataFrame
    expected: int = 0


def run_checks(checks: list[Check]) -> DataFrame:
    """check_id, observed, expected, status: one row each, in one job."""
    rows = [c.violations.agg(F.lit(c.check_id).alias("check_id"), F.count(F.lit(1)).alias("observed"), F.lit(c.expected).cast("long").alias("expected")) for c in checks]
    return reduce(DataFrame.unionByName, rows).withColumn("status", F.when(F.col("observed") == F.col("expected"), "PASS").otherwise("FAIL"))


def require(results: DataFrame) -> None:
    failed = [r["check_id"] for r in results.where("status = 'FAIL'").collect()]
    if failed:
        raise AssertionError(f"checks failed: {failed}")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """Keys that one side lacks or whose values differ by more than each value's tolerance; two nulls agree."""
    values = list(tolerances)
    x = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    y = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    rows = x.join(y, keys, "full")
    differs = F.col("in_a").isNull() | F.col("in_b").isNull()
    for v, tolerance in tolerances.items():
        left, right = F.col(f"a_{v}"), F.col(f"b_{v}")
        differs = differs | ~F.coalesce(F.abs(left - right) <= tolerance, left.isNull() & right.isNull())
    return rows.where(differs)


def replayed_credit(paths: DataFrame, s: Settings) -> DataFrame:
    """user_pseudo_id, order_key, model, channel, attributed_conversion, attributed_revenue of the rule models, derived another way.

    Each order's touchpoints are one sorted array; every model is an expression over it.  No window, no shared code with
    ``attribution.model_weights``.
    """
    touch = F.struct("touchpoint_number", "channel", "seconds_before_conversion")
    orders = paths.groupBy(*ORDER).agg(F.array_sort(F.collect_list(touch)).alias("p"), F.max("order_revenue_usd").alias("revenue"))
    others = F.filter("p", lambda x: x["channel"] != "Direct")
    raw = F.transform("p", lambda x: F.exp(-F.log(F.lit(2.0)) * x["seconds_before_conversion"] / F.lit(float(s.half_life_seconds))))
    orders = orders.withColumns({"n": F.size("p"), "last_other": F.try_element_at(others, F.lit(-1)), "raw": raw})
    one = lambda x: F.array(F.struct(x["channel"].alias("channel"), F.lit(1.0).alias("w")))
    total = F.aggregate("raw", F.lit(0.0), lambda acc, x: acc + x)
    credit = {
        "First Click": one(F.element_at("p", 1)),
        "Last Click": one(F.element_at("p", -1)),
        "Last Non-direct Click": one(F.coalesce("last_other", F.element_at("p", -1))),
        "Linear": F.transform("p", lambda x: F.struct(x["channel"].alias("channel"), (F.lit(1.0) / F.col("n")).alias("w"))),
        "Time Decay": F.zip_with("p", "raw", lambda x, w: F.struct(x["channel"].alias("channel"), (w / total).alias("w"))),
    }
    models = F.array(*[F.struct(F.lit(m).alias("model"), c.alias("credit")) for m, c in credit.items()])
    rows = orders.select(*ORDER, "revenue", F.explode(models).alias("m")).select(*ORDER, "revenue", "m.model", F.explode("m.credit").alias("c"))
    w = F.col("c.w")
    return rows.where(w > 0).groupBy(*ORDER, "model", F.col("c.channel").alias("channel")).agg(F.sum(w).alias("attributed_conversion"), F.sum(w * F.col("revenue")).alias("attributed_revenue"))


def replayed_effects(edge_counts: DataFrame, rounds: int = 4096) -> DataFrame:
    """channel, base_probability, probability_without, removal_effect, attribution_share of one chain, derived another way.

    Chances to convert are found by walking: the share of walkers that have converted after 1, 2, 4, ... ``rounds`` steps, by
    squaring the transition matrix with the removed channel's walkers sent to Null.  No linear system is solved.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        states = sorted({*rows["src"], *rows["dst"], START, CONVERSION, NULL})
        at = {x: i for i, x in enumerate(states)}
        steps = np.zeros((len(states), len(states)))
        for src, dst, n in zip(rows["src"], rows["dst"], rows["n"], strict=True):
            steps[at[src], at[dst]] += n

        def converting(removed: str | None) -> float:
            m = steps.copy()
            if removed is not None:
                m[:, at[NULL]] += m[:, at[removed]]
                m[:, at[removed]] = 0
                m[at[removed]] = 0
            for x in (CONVERSION, NULL, *([removed] if removed else [])):
                m[at[x]] = 0
                m[at[x], at[x]] = 1
            m /= np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
            for _ in range(int(np.log2(rounds))):
                m = m @ m
            return float(m[at[START], at[CONVERSION]])

        base = converting(None)
        found = [(x, base, converting(x)) for x in states if x not in (START, CONVERSION, NULL)]
        effects = [max(0.0, 1 - rest / base) for _, _, rest in found]
        return pd.DataFrame([(*f, e, e / sum(effects)) for f, e in zip(found, effects, strict=True)], columns=["channel", "base_probability", "probability_without", "removal_effect", "attribution_share"])

    schema = "channel string, base_probability double, probability_without double, removal_effect double, attribution_share double"
    one = edge_counts.select(F.lit("chain").alias("chain"), "src", "dst", "n")  # one chain's edges: states squared at most
    return one.groupBy("chain").applyInPandas(walk, schema)


def formula_replay(paths: DataFrame, results: DataFrame, edge_counts: DataFrame, effects: DataFrame, attribution: DataFrame, s: Settings) -> DataFrame:
    """model, compared, differences, replayed conversions and revenue: all six models against a second derivation.

    Rows that one side lacks, credit that differs by more than 1e-9 and revenue by more than 1e-6 are differences.
    """
    tolerances = {"attributed_conversion": 1e-9, "attributed_revenue": 1e-6}
    replay = replayed_credit(paths, s)
    wrong = reconcile(results, replay, [*ORDER, "model", "channel"], tolerances).groupBy("model").agg(F.count(F.lit(1)).alias("differences"))
    sums = replay.groupBy("model").agg(F.count(F.lit(1)).alias("compared"), F.sum("attributed_conversion").alias("replayed_conversions"), F.sum("attributed_revenue").alias("replayed_revenue"))
    rules = results.select("model").distinct().join(sums, "model", "full").join(wrong, "model", "left")
    totals = paths.groupBy(*ORDER).agg(F.max("order_revenue_usd").alias("r")).agg(F.count(F.lit(1)).alias("orders"), F.sum("r").alias("revenue"))
    chain = replayed_effects(edge_counts).crossJoin(F.broadcast(totals))  # one row
    chain = chain.withColumns({"attributed_conversions": F.col("attribution_share") * F.col("orders"), "attributed_revenue": F.col("attribution_share") * F.col("revenue")})
    fits = {"base_probability": 1e-9, "probability_without": 1e-9, "removal_effect": 1e-9, "attribution_share": 1e-9}
    wrong = reconcile(effects, chain, ["channel"], fits).select("channel").union(reconcile(attribution, chain, ["channel"], {"attributed_conversions": 1e-6, "attributed_revenue": 1e-6}).select("channel"))
    markov = chain.agg(F.lit("Markov").alias("model"), F.count(F.lit(1)).alias("compared"), F.sum("attributed_conversions").alias("replayed_conversions"), F.sum("attributed_revenue").alias("replayed_revenue"))
    markov = markov.crossJoin(wrong.agg(F.count_distinct("channel").alias("differences")))  # one row each
    return rules.fillna(0, ["compared", "differences"]).unionByName(markov)


def core_checks(base: DataFrame, orders: DataFrame, sessions: DataFrame, strict: DataFrame, revised: DataFrame, coverage: DataFrame, results: DataFrame, journeys: DataFrame, s: Settings) -> list[Check]:
    """What must hold between the tables of a run, whatever the data."""
    order_credit = results.groupBy("order_key", "model").agg(F.sum("attributed_conversion").alias("c"), F.sum("attributed_revenue").alias("r"), F.max("order_revenue_usd").alias("o"))
    return [
        Check("orders_unique", duplicates(orders, "order_key")),
        Check("sessions_unique", duplicates(sessions, "session_key")),
        Check("sessions_cover_events", base.where("session_key IS NOT NULL").join(sessions, "session_key", "left_anti")),
        Check("session_span_ordered", sessions.where("session_start_ts > session_end_ts")),
        Check("channel_of_every_session", sessions.where("channel IS NULL")),
        Check("admin_sessions_ineligible", sessions.where("is_internal_admin_traffic AND is_attribution_eligible")),
        Check("paths_unique", duplicates(revised, "order_key", "session_key")),
        Check("strict_inside_revised", strict.join(revised, ["order_key", "session_key"], "left_anti")),
        Check("touchpoints_before_order", revised.where("touchpoint_ts > order_ts OR seconds_before_conversion < 0")),
        Check("touchpoints_numbered", revised.groupBy("order_key").agg(F.max("touchpoint_number").alias("m"), F.max("path_length").alias("l"), F.count(F.lit(1)).alias("n")).where("m <> n OR l <> n")),
        Check("no_admin_touchpoint", revised.where("channel = 'Internal/Admin'")),
        Check("coverage_of_every_order", orders.join(coverage, "order_key", "left_anti")),
        Check("conversions_sum_to_one", order_credit.where("abs(c - 1) > 1e-9")),
        Check("revenue_is_shared_out", order_credit.where("abs(r - o) > 1e-6")),
        Check("no_weight_without_path", results.join(revised, "order_key", "left_anti")),
        Check("journeys_unique", duplicates(journeys, "journey_id")),
        Check("journey_lengths", journeys.where("size(channel_path) <> session_count OR size(session_key_path) <> session_count")),
        Check("conversion_journeys_are_paths", revised.select("order_key").distinct().join(journeys.where("outcome_state = 'Conversion'"), "order_key", "left_anti")),
        Check("censored_not_included", journeys.where("journey_status = 'Right Censored' AND is_markov_included")),
        Check("no_outcome_inside_paths", journeys.where(F.exists("channel_path", lambda x: x.isin("Start", "Conversion", "Null")))),
    ]


def model_checks(matrix: DataFrame, effects: DataFrame, scenarios: DataFrame, funnel: DataFrame, revised: DataFrame, coverage: DataFrame, results: DataFrame, s: Settings) -> list[Check]:
    """What must hold of chains, scenarios, the funnel and the windows, whatever the data."""
    direct = F.col("channel") == "Direct"
    last = results.where("model = 'Last Non-direct Click'").select("order_key", direct.alias("credits_direct"))
    all_direct = revised.groupBy("order_key").agg(F.bool_and(direct).alias("all_direct"))
    ranks = scenarios.groupBy("scenario").agg(F.min("channel_rank").alias("low"), F.max("channel_rank").alias("high"), F.count_distinct("channel_rank").alias("ranks"), F.count(F.lit(1)).alias("n"), F.sum("attribution_share").alias("shares"))
    rates = [c for c in funnel.columns if c.endswith("_rate")]
    return [
        Check("matrix_rows_sum_to_one", matrix.groupBy("src").agg(F.sum("probability").alias("p")).where("abs(p - 1) > 1e-9")),
        Check("absorbing_states_stay", matrix.where("is_absorbing AND src = dst AND probability <> 1")),
        Check("effects_are_shares", effects.where("removal_effect < 0 OR removal_effect > 1")),
        Check("removal_never_helps", effects.where("probability_without > base_probability + 1e-9")),
        Check("scenario_shares_sum_to_one", ranks.where("abs(shares - 1) > 1e-9")),
        Check("scenario_ranks_are_permutations", ranks.where("low <> 1 OR high <> n OR ranks <> n")),
        Check("direct_only_as_fallback", last.join(all_direct, "order_key").where("credits_direct <> all_direct")),
        Check("touchpoints_in_lookback", revised.where(F.col("seconds_before_conversion") > s.lookback_days * 86_400)),
        Check("wider_windows_hold_more", coverage.where("all_user_session_count < session_on_or_before_order_count OR session_on_or_before_order_count < session_within_lookback_count")),
        Check("revised_covers_strict", coverage.where("conversion_touchpoint_count < strict_conversion_touchpoint_count")),
        Check("funnel_channels_unique", duplicates(funnel, "channel")),
        Check("funnel_rates_in_range", funnel.where("sessions <= 0 OR " + " OR ".join(f"{r} IS NULL OR {r} < 0 OR {r} > 1" for r in rates))),
    ]


def mart_checks(comparison: DataFrame, summary: DataFrame, metrics: DataFrame, lookback: DataFrame, revised: DataFrame) -> list[Check]:
    """What must hold between the marts and the paths that they sum, whatever the data.

    Sums over all orders are compared with a relative tolerance, as they are added up in different orders.
    """
    orders = revised.groupBy("order_key").agg(F.max("order_revenue_usd").alias("r")).agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("r"), F.lit(0.0)).alias("revenue"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col(b)))
    one = lambda df: df.crossJoin(F.broadcast(orders))  # noqa: E731  (one row)
    models = one(comparison.groupBy("model").agg(F.sum("attributed_conversions").alias("c"), F.sum("attributed_revenue").alias("m"), F.sum("attribution_share").alias("shares")))
    kinds = one(summary.groupBy("summary_type").agg(F.sum("attributable_conversions").alias("c"), F.sum("attributable_revenue").alias("m"), F.sum("conversion_share").alias("shares")))
    views = lookback.groupBy("lookback_days", "cohort_view", "model")
    views = views.agg(F.sum("attributed_conversions").alias("c"), F.sum("conversion_share").alias("shares"), F.max("attributable_order_count").alias("most"), F.min("attributable_order_count").alias("least"))
    grid = comparison.groupBy("channel").agg(F.count_distinct("model").alias("models"), F.count(F.lit(1)).alias("n"))
    return [
        Check("models_credit_all_orders", models.where(~near("c", "orders"))),
        Check("models_credit_all_revenue", models.where(~near("m", "revenue"))),
        Check("model_shares_sum_to_one", models.where("abs(shares - 1) > 1e-9")),
        Check("six_models_per_channel", grid.where("models <> 6 OR n <> 6")),
        Check("last_click_equals_itself", comparison.where("model = 'Last Click' AND (conversions_difference_vs_last_click <> 0 OR revenue_difference_vs_last_click <> 0)")),
        Check("summaries_hold_all_orders", kinds.where("c <> orders")),
        Check("summaries_hold_all_revenue", kinds.where(~near("m", "revenue"))),
        Check("summary_shares_sum_to_one", kinds.where("abs(shares - 1) > 1e-9")),
        Check("scenario_outcomes_add_up", metrics.where("conversion_journey_count + null_journey_count <> journeys OR touchpoints < journeys")),
        Check("lookbacks_credit_their_orders", views.where("most <> least OR abs(c - most) > 1e-9 * greatest(1, most)")),
        Check("lookback_shares_sum_to_one", views.where("abs(shares - 1) > 1e-9")),
    ]
