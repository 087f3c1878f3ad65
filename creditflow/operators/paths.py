"""Conversion paths, their coverage, as-of joins and journeys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditflow.functions.columns import days, hash_key, seconds, whole_seconds
from creditflow.operators.scan import Segments, following, last, total
from creditflow.operators.sessions import eligible
from creditflow.settings import CONVERSION, NULL, Settings

#: An order is of one user: with the user in front, rows that lie together by user need no shuffle.
ORDER = ("user_pseudo_id", "order_key")
STANDARD, EXCEPTION = "STANDARD_CONVERSION_CYCLE", "CURRENT_CONVERSION_SESSION_EXCEPTION"


def candidates(cycles: DataFrame, sessions: DataFrame, s: Settings) -> DataFrame:
    """Order and session pairs of a user inside the lookback.

    An equi-join on the user with a range condition: both sides are hashed by user, and a heavy user's partition
    can be split by adaptive execution.
    """
    o, t = cycles.alias("o"), sessions.alias("t")
    near = (F.col("o.user_pseudo_id") == F.col("t.user_pseudo_id")) & (F.col("t.session_start_ts") <= F.col("o.order_ts")) & (F.col("t.session_start_ts") >= F.col("o.order_ts") - days(s.lookback_days))
    standard = F.col("o.previous_order_ts").isNull() | (F.col("t.session_start_ts") > F.col("o.previous_order_ts"))
    own = F.coalesce(F.col("t.session_key") == F.col("o.conversion_session_key"), F.lit(False))
    return o.join(t, near).select("o.*", *[F.col(f"t.{c}") for c in sessions.columns if c != "user_pseudo_id" and c not in cycles.columns], standard.alias("is_standard"), own.alias("is_conversion_session"))


def path_rows(cycles: DataFrame, sessions: DataFrame, s: Settings, by: tuple[str, ...] = ("order_key",)) -> DataFrame:
    """Touchpoints of every order, numbered twice: all of them, and (``_strict_``) the standard ones among themselves.

    ``by`` may name the user before the order, an order being of one user: then the join's partitions, or those of
    tables bucketed by user, serve the numbering too.
    """
    rows = candidates(cycles, eligible(sessions), s).where("is_standard OR is_conversion_session")
    order = Window.partitionBy(*by)
    turn = order.orderBy("session_start_ts", "session_key")
    return rows.withColumns(
        {
            "touchpoint_ts": F.col("session_start_ts"),
            "touchpoint_number": F.row_number().over(turn).cast("long"),
            "path_length": F.count(F.lit(1)).over(order),
            "_strict_number": F.count_if("is_standard").over(turn.rowsBetween(Window.unboundedPreceding, 0)),
            "_strict_length": F.count_if("is_standard").over(order),
            "seconds_before_conversion": whole_seconds(F.col("session_start_ts"), F.col("order_ts")),
            "touchpoint_eligibility_rule": F.when(F.col("is_standard"), STANDARD).otherwise(EXCEPTION),
            "is_same_session_multi_order_exception": ~F.col("is_standard") & F.col("is_conversion_session"),
            "path_definition_version": F.lit(s.path_version),
        }
    ).drop("is_standard", "is_conversion_session")


def revised_paths(rows: DataFrame) -> DataFrame:
    """The paths in which the order's own session always counts."""
    return rows.drop("_strict_number", "_strict_length")


def strict_paths(rows: DataFrame) -> DataFrame:
    """The paths of standard touchpoints only; all of these are among the revised ones."""
    rows = rows.where(F.col("touchpoint_eligibility_rule") == STANDARD)
    return revised_paths(rows.withColumns({"touchpoint_number": F.col("_strict_number"), "path_length": F.col("_strict_length")}))


def conversion_paths(cycles: DataFrame, sessions: DataFrame, s: Settings, strict: bool = False, by: tuple[str, ...] = ("order_key",)) -> DataFrame:
    """Touchpoints of every order, numbered; unless ``strict`` the order's own session always counts.  ``by`` as in ``path_rows``."""
    rows = path_rows(cycles, sessions, s, by)
    return strict_paths(rows) if strict else revised_paths(rows)


def order_coverage(cycles: DataFrame, sessions: DataFrame, strict: DataFrame, revised: DataFrame, s: Settings, by_user: bool = False) -> DataFrame:
    """Per order how many of the user's sessions pass each condition, and whether a path covers it.

    Sessions of all time are counted by a running window over both; the other conditions hold inside the lookback
    only, so orders meet sessions by user and stretch of time, and a user of many years makes no more pairs.  ``by_user``,
    for tables that lie together by user and users of few rows, leaves the stretch out: then only the window is shuffled.
    """
    c, days_back = F.col, s.lookback_days
    o = cycles.select("order_key", "user_pseudo_id", "order_ts", "previous_order_ts", "conversion_session_key")
    start = c("session_start_ts")
    both = o.select("order_key", "user_pseudo_id", c("order_ts").alias("at"), F.lit(0).alias("session")).unionByName(
        sessions.where(c("user_pseudo_id").isNotNull()).select(F.lit(None).cast(o.schema["order_key"].dataType).alias("order_key"), "user_pseudo_id", start.alias("at"), F.lit(1).alias("session"))
    )
    user = Window.partitionBy("user_pseudo_id")
    so_far = F.sum(F.when(c("at").isNotNull(), c("session")).otherwise(0)).over(user.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ever = both.withColumns({"all_user_session_count": F.sum("session").over(user), "session_on_or_before_order_count": so_far}).where(c("order_key").isNotNull())
    ever = ever.select(*ORDER, "all_user_session_count", "session_on_or_before_order_count")
    stretch = lambda ts: F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-01")) / days_back)
    if by_user:
        met = o.join(sessions, "user_pseudo_id")
    else:
        near = o.withColumn("stretch", F.explode(F.array(stretch("order_ts") - 1, stretch("order_ts"))))
        met = near.join(sessions.withColumn("stretch", stretch(start)), ["user_pseudo_id", "stretch"])
    met = met.where((start <= c("order_ts")) & (start >= c("order_ts") - days(days_back)))
    standard = c("previous_order_ts").isNull() | (start > c("previous_order_ts"))
    own = c("session_key") == c("conversion_session_key")
    revised_ok = standard | own
    good = c("is_attribution_eligible") & ~c("is_internal_admin_traffic") & (c("channel") != "Internal/Admin")
    admin = c("is_internal_admin_traffic")
    recent = met.groupBy(*ORDER).agg(
        F.count(F.lit(1)).alias("session_within_lookback_count"),
        F.count_if(standard).alias("strict_pre_internal_exclusion_session_count"),
        F.count_if(standard & (F.coalesce("resolved_source_host", F.lit("")) != s.admin_hosts[0])).alias("historical_baseline_touchpoint_count"),
        F.count_if(standard & admin).alias("strict_internal_admin_session_count"),
        F.count_if(standard & good).alias("strict_attribution_eligible_session_count"),
        F.count_if(revised_ok).alias("revised_pre_internal_exclusion_session_count"),
        F.count_if(revised_ok & admin).alias("revised_internal_admin_session_count"),
        F.count_if(revised_ok & good).alias("revised_attribution_eligible_session_count"),
        F.count_if(c("previous_order_ts").isNotNull() & (start <= c("previous_order_ts")) & own).alias("current_conversion_session_exception_candidate_count"),
    )
    counted = [x for x in recent.columns if x not in ORDER]
    counts = ever.join(recent, list(ORDER), "left").fillna(0, counted)
    size = lambda paths, name: paths.groupBy(*ORDER).agg(F.count(F.lit(1)).alias(name))
    rows = (
        cycles.join(counts, list(ORDER))
        .join(size(strict, "strict_conversion_touchpoint_count"), list(ORDER), "left")
        .join(size(revised, "conversion_touchpoint_count"), list(ORDER), "left")
        .fillna(0, ["strict_conversion_touchpoint_count", "conversion_touchpoint_count"])
    )
    n, k, h = c("strict_conversion_touchpoint_count"), c("conversion_touchpoint_count"), c("historical_baseline_touchpoint_count")
    return rows.withColumns(
        {
            "path_covered_strict": n > 0,
            "path_covered_historical_baseline": h > 0,
            "path_covered_revised": k > 0,
            "path_covered_after_admin_exclusion": k > 0,
            "recovered_by_current_conversion_session_exception": (n == 0) & (k > 0),
            "historical_unmatched_recovered_by_exception": (h == 0) & (k > 0),
            "historical_covered_order_lost_after_closeout": (h > 0) & (k == 0),
            "coverage_lost_after_internal_exclusion": (c("revised_pre_internal_exclusion_session_count") > 0) & (k == 0),
            "path_definition_version": F.lit(s.path_version),
        }
    )


def unmatched_orders(coverage: DataFrame) -> DataFrame:
    """Orders without a touchpoint, and the first reason that applies."""
    c = F.col
    # Reason texts.
    reason = (
        F.when((c("revised_pre_internal_exclusion_session_count") > 0) & (c("revised_attribution_eligible_session_count") == 0), "NO_ELIGIBLE_TOUCHPOINT_AFTER_INTERNAL_EXCLUSION")
        .when(c("all_user_session_count") == 0, "NO_USER_SESSIONS")
        .when(c("session_on_or_before_order_count") == 0, "NO_SESSION_ON_OR_BEFORE_ORDER")
        .when(c("session_within_lookback_count") == 0, "NO_SESSION_WITHIN_LOOKBACK")
        .when(c("revised_pre_internal_exclusion_session_count") == 0, "NO_STANDARD_OR_CURRENT_CONVERSION_SESSION")
        .otherwise("NO_ATTRIBUTION_ELIGIBLE_TOUCHPOINT")
    )
    return coverage.where("conversion_touchpoint_count = 0").withColumn("exclusion_reason", reason)


def _merged(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, right_first: bool) -> DataFrame:
    rows = left.withColumns({"_ts": F.col(left_ts), "_right": F.lit(False), "_found": F.lit(None).cast(right.schema[right_ts].dataType)})
    found = right.select(by, F.col(right_ts).alias("_ts"), F.lit(True).alias("_right"), F.col(right_ts).alias("_found"))
    return rows.unionByName(found, allowMissingColumns=True).withColumn("_turn", F.when(F.col("_right"), 0 if right_first else 1).otherwise(1 if right_first else 0))


def asof_last(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, name: str) -> DataFrame:
    """Left rows with the greatest right time strictly before theirs: one scan over both, no pairs.

    Rows of a key are scanned in segments, so that a key with very many rows is spread over tasks.
    """
    rows = _merged(left, right, by, left_ts, right_ts, right_first=False)
    found = Segments.long_keys(rows, (by,), ["_ts", "_turn"]).with_columns({name: last("_found")})
    return found.where("NOT _right").done().drop("_ts", "_right", "_found", "_turn")


def asof_next(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, name: str) -> DataFrame:
    """Left rows with the least right time at or after theirs."""
    rows = _merged(left, right, by, left_ts, right_ts, right_first=False)
    found = Segments.long_keys(rows, (by,), ["_ts", "_turn"]).with_columns({name: following("_found")})
    return found.where("NOT _right").done().drop("_ts", "_right", "_found", "_turn")


def segmented_journeys(sessions: DataFrame, orders: DataFrame, inactivity_seconds: int) -> DataFrame:
    """Sessions cut into journeys by inactivity or an order in between, one row per journey.

    Sessions and orders go along a user's time together, in segments: each session gets the session before it, the last
    order before it and the next order from its start on in one scan, the number of its journey in a second.  Users of few
    rows are not cut: one shuffle by user serves both scans and the journeys.
    """
    rows = eligible(sessions).select("user_pseudo_id", "session_key", "session_start_ts", "session_end_ts", "channel", "mapping_version")
    rows = _merged(rows, orders, "user_pseudo_id", "session_start_ts", "order_ts", right_first=False)
    scanned = Segments.long_keys(rows, ("user_pseudo_id",), ["_ts", "_turn", "session_key"]).with_columns(
        {"_prev_start": last("session_start_ts", before=True), "_prev_end": last("session_end_ts", before=True), "_last_order": last("_found"), "_next_order": following("_found")}
    )
    fresh = F.col("_prev_start").isNull() | (F.col("session_start_ts") >= F.col("_prev_end") + seconds(inactivity_seconds)) | F.coalesce(F.col("_last_order") >= F.col("_prev_start"), F.lit(False))
    rows = scanned.where("NOT _right").with_columns({"journey_number": total(F.when(fresh, 1).otherwise(0).cast("long"))}).done()
    ordered = F.array_sort(F.collect_list(F.struct("session_start_ts", "session_key", "channel")))
    journeys = rows.groupBy("user_pseudo_id", "journey_number").agg(
        F.min("session_start_ts").alias("journey_start_ts"),
        F.max("session_end_ts").alias("last_activity_ts"),
        F.min("_next_order").alias("next_purchase_ts"),
        ordered.alias("_path"),
        F.count(F.lit(1)).alias("session_count"),
        F.max("mapping_version").alias("mapping_version"),
    )
    return journeys.withColumns(
        {
            "inactivity_expiry_ts": F.col("last_activity_ts") + seconds(inactivity_seconds),
            "channel_path": F.transform("_path", lambda x: x["channel"]),
            "session_key_path": F.transform("_path", lambda x: x["session_key"]),
        }
    ).drop("_path")


def nonconverting(journeys: DataFrame, s: Settings, inactivity_seconds: int) -> DataFrame:
    """Journeys that ended without a purchase before the boundary (Null) or whose end is not seen (Right Censored)."""
    end, expiry, bought = F.lit(s.boundary_end).cast("timestamp_ntz"), F.col("inactivity_expiry_ts"), F.col("next_purchase_ts")
    ended = (bought.isNull() | (bought > expiry)) & (expiry < end)
    censored = (expiry >= end) & (bought.isNull() | (bought >= end))
    return (
        journeys.where(ended | censored)
        .withColumn("journey_status", F.when(ended, NULL).otherwise("Right Censored"))
        .withColumns(
            {
                "journey_id": F.concat(F.lit("SESSION_JOURNEY:"), hash_key(user_pseudo_id=F.col("user_pseudo_id"), journey_number=F.col("journey_number"))),
                "outcome_state": F.when(F.col("journey_status") == NULL, NULL),
                "is_markov_included": F.col("journey_status") == NULL,
                "dataset_end_boundary": end,
                "is_left_boundary_truncated": F.col("journey_start_ts") < F.lit(s.boundary_start).cast("timestamp_ntz") + seconds(inactivity_seconds),
                "inactivity_cutoff_seconds": F.lit(inactivity_seconds).cast("long"),
                "journey_definition_version": F.lit(s.journey_version),
            }
        )
        .drop("journey_number")
    )


def converting(paths: DataFrame, s: Settings, inactivity_seconds: int) -> DataFrame:
    """One journey per order from its path."""
    ordered = F.array_sort(F.collect_list(F.struct("touchpoint_number", "session_key", "channel")))
    rows = paths.groupBy(*ORDER).agg(
        F.max("order_ts").alias("order_ts"),
        F.max("order_revenue_usd").alias("attributable_revenue_usd"),
        F.min("touchpoint_ts").alias("journey_start_ts"),
        F.max("touchpoint_ts").alias("last_activity_ts"),
        ordered.alias("_path"),
        F.count(F.lit(1)).alias("session_count"),
        F.max("mapping_version").alias("mapping_version"),
    )
    return rows.withColumns(
        {
            "journey_id": F.concat(F.lit("CONVERSION:"), F.col("order_key")),
            "inactivity_expiry_ts": F.lit(None).cast("timestamp_ntz"),
            "next_purchase_ts": F.col("order_ts"),
            "dataset_end_boundary": F.lit(s.boundary_end).cast("timestamp_ntz"),
            "channel_path": F.transform("_path", lambda x: x["channel"]),
            "session_key_path": F.transform("_path", lambda x: x["session_key"]),
            "journey_status": F.lit(CONVERSION),
            "outcome_state": F.lit(CONVERSION),
            "is_markov_included": F.lit(True),
            "is_left_boundary_truncated": F.col("journey_start_ts") < F.lit(s.boundary_start).cast("timestamp_ntz") + seconds(inactivity_seconds),
            "inactivity_cutoff_seconds": F.lit(inactivity_seconds).cast("long"),
            "journey_definition_version": F.lit(s.journey_version),
        }
    ).drop("_path")


def markov_journeys(sessions: DataFrame, orders: DataFrame, paths: DataFrame, s: Settings) -> DataFrame:
    journeys = nonconverting(segmented_journeys(sessions, orders, s.inactivity_seconds), s, s.inactivity_seconds)
    return converting(paths, s, s.inactivity_seconds).unionByName(journeys, allowMissingColumns=True)


def short_null_journeys(sessions: DataFrame, orders: DataFrame, paths: DataFrame, s: Settings) -> DataFrame:
    """Journeys under the shorter cut-off; Null ones that share a session with a conversion path are excluded."""
    rows = nonconverting(segmented_journeys(sessions, orders, s.short_inactivity_seconds), s, s.short_inactivity_seconds)
    used = paths.select("user_pseudo_id", "session_key")
    overlap = (
        rows.where(F.col("journey_status") == NULL)
        .select("user_pseudo_id", "journey_id", F.explode("session_key_path").alias("session_key"))
        .join(used, ["user_pseudo_id", "session_key"], "left_semi")
        .groupBy("user_pseudo_id", "journey_id")
        .agg(F.count_distinct("session_key").alias("overlapping_session_count"))
    )
    rows = rows.join(overlap, ["user_pseudo_id", "journey_id"], "left").fillna(0, ["overlapping_session_count"])
    null, shared = F.col("journey_status") == NULL, F.col("overlapping_session_count") > 0
    return rows.withColumns({"is_overlap_excluded": null & shared, "is_markov_included": null & ~shared})
