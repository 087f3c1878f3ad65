"""How stable allocations are: lookback and path scenarios, ranks, and a bootstrap over users."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditflow.functions.columns import compress_path, divide, omit_direct
from creditflow.operators.attribution import model_weights
from creditflow.operators.markov import Chain, edges, full_paths, normalised, removal_effects, transition_matrix
from creditflow.operators.scan import global_rank
from creditflow.settings import CONVERSION, NULL, START, Settings

BOOTSTRAP_SEED = 20_240_101


def lookback_touchpoints(paths: DataFrame, s: Settings, by: tuple[str, ...] = ("order_key",)) -> DataFrame:
    """Touchpoints inside each scenario's lookback, by cohort view and renumbered.

    The longest scenario is the baseline; the common cohort has the orders that every scenario keeps.
    """
    days = sorted(s.scenario_days)
    inside = F.filter(F.array(*[F.lit(d) for d in days]), lambda d: F.col("seconds_before_conversion") <= d.cast("long") * 86_400)
    rows = paths.withColumn("lookback_days", F.explode(inside)).drop("path_length")
    # Scenarios nest: an order is in all of them if its shortest has a touchpoint.
    rows = rows.withColumn("_common", F.min("lookback_days").over(Window.partitionBy(*by)) == days[0])
    view = F.when(F.col("lookback_days") == days[-1], "baseline").otherwise("population_impact")
    rows = rows.withColumn("cohort_view", F.explode(F.filter(F.array(view, F.when(F.col("_common"), F.lit("common_cohort"))), lambda v: v.isNotNull()))).drop("_common")
    order = Window.partitionBy("lookback_days", "cohort_view", *by)
    return rows.withColumns({"path_length": F.count(F.lit(1)).over(order), "touchpoint_number": F.row_number().over(order.orderBy("touchpoint_number", "session_key")).cast("long")})


def lookback_results(paths: DataFrame, s: Settings, by: tuple[str, ...] = ("order_key",)) -> DataFrame:
    """scenario x view x model x channel with the view's path statistics and shares."""
    rows = lookback_touchpoints(paths, s, by)
    view = ("lookback_days", "cohort_view")
    credit = model_weights(rows, s, by=(*view, *by)).groupBy(*view, "model", "channel")
    credit = credit.agg(F.sum("attribution_weight").alias("attributed_conversions"), F.sum(F.col("order_revenue_usd") * F.col("attribution_weight")).alias("attributed_revenue"))
    per_order = rows.groupBy(*view, *by).agg(F.max("order_revenue_usd").alias("revenue"), F.max("path_length").alias("length"))
    summary = per_order.groupBy(*view).agg(
        F.count(F.lit(1)).alias("attributable_order_count"),
        F.round(F.sum("revenue"), 2).alias("attributable_revenue"),
        F.avg("length").alias("average_path_length"),
        F.percentile("length", F.lit(0.5)).alias("median_path_length"),
        divide(F.count_if(F.col("length") > 1), F.count(F.lit(1))).alias("multi_touch_share"),
    )
    touched = rows.groupBy(*view, "channel").agg(F.count(F.lit(1)).alias("channel_touchpoint_count"))
    touched = touched.withColumn("channel_touchpoint_share", divide(F.col("channel_touchpoint_count"), F.sum("channel_touchpoint_count").over(Window.partitionBy(*view))))
    out = credit.join(summary, list(view)).join(touched, [*view, "channel"])
    return out.withColumns({"conversion_share": divide(F.col("attributed_conversions"), F.col("attributable_order_count")), "revenue_share": divide(F.col("attributed_revenue"), F.col("attributable_revenue"))})


def scenario_paths(journeys: DataFrame, short_null: DataFrame, paths: DataFrame, s: Settings) -> DataFrame:
    """Paths of every chain scenario: scenario, user_pseudo_id, path, revenue.

    Baseline, shorter lookbacks, the shorter inactivity cut-off, compressed paths, paths without Direct.  Each journey is
    tagged with all scenarios that it is in and exploded once; only cut paths and short journeys come from elsewhere.
    """
    ends = lambda inner: F.concat(F.array(F.lit(START)), inner, F.array(F.col("outcome_state")))
    days = sorted(s.scenario_days)[:-1]
    converted = F.col("outcome_state") == CONVERSION
    tag = lambda name, path, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("scenario"), path.alias("path")))
    tags = [tag("baseline", F.col("path")), tag("compressed", ends(compress_path(F.col("channel_path")))), tag("omit_direct", ends(omit_direct(F.col("channel_path")))), tag("short_inactivity", F.col("path"), converted)]
    tags += [tag(f"lookback_{d}d", F.col("path"), ~converted) for d in days]
    base = full_paths(journeys).select("user_pseudo_id", F.when(converted, F.col("attributable_revenue_usd")).alias("revenue"), F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("t"))
    out = base.select("t.scenario", "user_pseudo_id", "t.path", "revenue")
    nulls = short_null.where("is_markov_included").select(F.lit("short_inactivity").alias("scenario"), "user_pseudo_id", ends(F.col("channel_path")).alias("path"), F.lit(None).cast("double").alias("revenue"))
    inside = F.filter(F.array(*[F.lit(d) for d in days]), lambda d: F.col("seconds_before_conversion") <= d.cast("long") * 86_400)
    cut = paths.withColumn("days", F.explode(inside)).groupBy("user_pseudo_id", "order_key", "days").agg(F.max("order_revenue_usd").alias("revenue"), F.array_sort(F.collect_list(F.struct("touchpoint_number", "channel"))).alias("p"))
    kept = F.concat(F.array(F.lit(START)), F.transform("p", lambda x: x["channel"]), F.array(F.lit(CONVERSION)))
    cut = cut.select(F.format_string("lookback_%dd", "days").alias("scenario"), "user_pseudo_id", kept.alias("path"), "revenue")
    return out.unionByName(nulls).unionByName(cut)


def scenario_effects(scenario_edges: DataFrame) -> DataFrame:
    """Effects, shares and ranks of every scenario."""
    return removal_effects(scenario_edges, "scenario").withColumn("channel_rank", ordinal_rank("attribution_share", "scenario"))


#: Values that agree to so many places are equal for ranks, whatever way they were summed or solved.
RANK_DIGITS = 9


def ordinal_rank(value: str, *by: str):
    """1 for the greatest value, ties by channel."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round(value, RANK_DIGITS)), "channel")).cast("long")


def tied_channels(rows: DataFrame, value: str, *by: str, tolerance: float = 1e-15, name: str = "is_tied") -> DataFrame:
    """Rows whose value another channel of the group has too, within the tolerance.

    Neighbours in the order of values are the nearest, so no pairs are made.
    """
    w = Window.partitionBy(*by).orderBy(value, "channel")
    near = lambda other: F.coalesce(F.abs(other - F.col(value)) <= tolerance, F.lit(False))
    return rows.withColumn(name, near(F.lag(value).over(w)) | near(F.lead(value).over(w)))


def median_of_counts(rows: DataFrame, value: str, count: str, *by: str) -> DataFrame:
    """Exact interpolated median per group from (value, count): running counts, no buffer of values."""
    w = Window.partitionBy(*by).orderBy(value)
    rows = rows.withColumns({"_to": F.sum(count).over(w), "_all": F.sum(count).over(Window.partitionBy(*by))})
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)  # the places of the two middle ones
    at = lambda place: F.min(F.when(F.col("_to") >= place, F.col(value)))
    return rows.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("median"))


def path_metrics(paths: DataFrame) -> DataFrame:
    """Per scenario: journeys, outcomes, revenue, touchpoints, their mean and median number, share of several.

    Paths are counted by length and outcome first, so what is left is a row per length.
    """
    lengths = paths.groupBy("scenario", (F.size("path") - 2).alias("length"), (F.element_at("path", -1) == CONVERSION).alias("converted")).agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("revenue"))
    n, several = F.sum("n"), F.sum(F.when(F.col("length") > 1, F.col("n")).otherwise(0))
    rows = lengths.groupBy("scenario").agg(
        n.alias("journeys"),
        F.sum(F.when(F.col("converted"), F.col("n")).otherwise(0)).alias("conversion_journey_count"),
        F.sum(F.when(~F.col("converted"), F.col("n")).otherwise(0)).alias("null_journey_count"),
        F.sum("revenue").alias("attributable_revenue"),
        F.sum(F.col("length") * F.col("n")).alias("touchpoints"),
        divide(F.sum(F.col("length") * F.col("n")), n).alias("average_path_length"),
        divide(several, n).alias("multi_touch_share"),
    )
    counts = lengths.groupBy("scenario", "length").agg(F.sum("n").alias("n"))
    return rows.join(median_of_counts(counts, "length", "n", "scenario").withColumnRenamed("median", "median_path_length"), "scenario")


def channel_touchpoints(scenario_edges: DataFrame) -> DataFrame:
    """Touchpoints per scenario and channel, from the counted edges; also as a share of the scenario's."""
    rows = scenario_edges.where(~F.col("dst").isin(CONVERSION, NULL)).groupBy("scenario", F.col("dst").alias("channel")).agg(F.sum("n").alias("channel_touchpoint_count"))
    return rows.withColumn("channel_touchpoint_share", divide(F.col("channel_touchpoint_count"), F.sum("channel_touchpoint_count").over(Window.partitionBy("scenario"))))


def censored_journeys(journeys: DataFrame, short_null: DataFrame) -> DataFrame:
    """One row: right-censored journeys under the usual and under the short cut-off; neither is in any chain."""
    count = lambda df, name: df.agg(F.count_if(F.col("journey_status") == "Right Censored").alias(name))
    return count(journeys, "censored").crossJoin(count(short_null, "censored_short"))  # one row each


RESULT = (
    "scenario", "cohort_view", "model", "channel", "attributable_order_count", "attributable_revenue", "conversion_journey_count", "null_journey_count",
    "right_censored_journey_count", "average_path_length", "median_path_length", "multi_touch_share", "channel_touchpoint_count", "channel_touchpoint_share",
    "removal_effect", "attributed_conversions", "attributed_revenue", "conversion_share", "revenue_share", "baseline_conversion_probability",
)


def sensitivity_results(lookback: DataFrame, effects: DataFrame, metrics: DataFrame, touchpoints: DataFrame, censored: DataFrame, s: Settings) -> DataFrame:
    """Rule models by lookback and view, and chains by scenario, in one table with ranks and ties of both shares."""
    longest = max(s.scenario_days)
    none = lambda kind: F.lit(None).cast(kind)
    rules = lookback.withColumns(
        {
            "scenario": F.when(F.col("lookback_days") == longest, "baseline").otherwise(F.format_string("lookback_%dd", "lookback_days")),
            "conversion_journey_count": F.col("attributable_order_count"),
            "null_journey_count": F.lit(0).cast("long"),
            "right_censored_journey_count": F.lit(0).cast("long"),
            "removal_effect": none("double"),
            "baseline_conversion_probability": none("double"),
        }
    )
    share, short = F.col("attribution_share"), F.col("scenario") == "short_inactivity"
    chains = effects.join(metrics, "scenario").join(touchpoints, ["scenario", "channel"]).crossJoin(F.broadcast(censored))  # one row
    chains = chains.withColumns(
        {
            "cohort_view": F.lit("completed_outcomes"),
            "model": F.lit("Markov"),
            "attributable_order_count": F.col("conversion_journey_count"),
            "right_censored_journey_count": F.when(short, F.col("censored_short")).otherwise(F.col("censored")),
            "attributed_conversions": F.col("conversion_journey_count") * share,
            "attributed_revenue": F.col("attributable_revenue") * share,
            "conversion_share": share,
            "revenue_share": share,
            "baseline_conversion_probability": F.col("base_probability"),
        }
    )
    out, group = rules.select(*RESULT).unionByName(chains.select(*RESULT)), ("scenario", "cohort_view", "model")
    for name in ("conversion", "revenue"):
        out = tied_channels(out.withColumn(f"{name}_rank", ordinal_rank(f"{name}_share", *group)), f"{name}_share", *group, tolerance=10**-RANK_DIGITS, name=f"is_{name}_share_tied")
    return out.withColumn("sensitivity_version", F.lit(s.sensitivity_version))


def rank_stability(results: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Every scenario's shares and ranks against the baseline of its model: changes, ties, Spearman's rho, first three.

    Views are compared with their like: the common cohort with the baseline's, all others with the whole baseline.  Both
    sides are ranked over all channels of either; one that a side lacks has share 0 there and comes after the others.
    """
    side = lambda df, p: df.select("view", "model", "channel", *([] if p == "baseline" else ["scenario", "cohort_view"]), F.col("conversion_share").alias(f"{p}_share"))
    own_view = F.when(F.col("cohort_view") == "population_impact", "baseline").otherwise(F.col("cohort_view"))
    rows = results.withColumn("view", own_view)
    base = side(rows.where(F.col("scenario") == baseline), "baseline")
    others = side(rows.where((F.col("scenario") != baseline)), "scenario")
    pairs = others.select("scenario", "cohort_view", "view", "model").distinct()
    grid = others.select("scenario", "cohort_view", "view", "model", "channel").union(pairs.join(base, ["view", "model"]).select("scenario", "cohort_view", "view", "model", "channel")).distinct()
    out = grid.join(base, ["view", "model", "channel"], "left").join(others, ["scenario", "cohort_view", "view", "model", "channel"], "left")
    group = ("scenario", "cohort_view", "model")
    for p in ("baseline", "scenario"):
        here = F.col(f"{p}_share").isNotNull()
        last = Window.partitionBy(*group).orderBy(F.desc(here), F.desc(F.round(f"{p}_share", RANK_DIGITS)), "channel")
        out = out.withColumn(f"{p}_rank", F.row_number().over(last).cast("long")).fillna(0.0, [f"{p}_share"])
        out = tied_channels(out, f"{p}_share", *group, tolerance=10**-RANK_DIGITS, name=f"{p}_is_tied")
    w = Window.partitionBy(*group)
    shift, change = F.col("scenario_rank") - F.col("baseline_rank"), F.col("scenario_share") - F.col("baseline_share")
    n = F.count(F.lit(1)).over(w)
    rho = F.when(n < 2, F.lit(1.0)).otherwise(F.lit(1.0) - F.sum(shift * shift).over(w) * F.lit(6.0) / (n * (n * n - 1)))
    return out.withColumns(
        {
            "absolute_rank_shift": F.abs(shift),
            "absolute_percentage_point_change": F.abs(change) * 100,
            "relative_share_change": divide(change, F.col("baseline_share")),
            "spearman_rank_correlation": rho,
            "top_3_overlap": F.sum(((F.col("scenario_rank") <= 3) & (F.col("baseline_rank") <= 3)).cast("long")).over(w),
            "maximum_absolute_rank_shift": F.max(F.abs(shift)).over(w),
        }
    ).drop("view")


BOOTSTRAP_REPLICATES = 500


def scenario_assumptions(s: Settings) -> list[tuple]:
    """(scenario, label, changed assumption, lookback days, inactivity seconds, repeated channels, Direct, replicates, seed)."""
    longest, usual, short = max(s.scenario_days), s.inactivity_seconds, s.short_inactivity_seconds
    return [
        ("baseline", "Baseline", "none", longest, usual, "retained", "retained", 0, 0),
        *[(f"lookback_{d}d", f"{d}-day conversion lookback", "conversion_lookback", d, usual, "retained", "retained", 0, 0) for d in sorted(s.scenario_days)[:-1]],
        ("short_inactivity", "Shorter inactivity", "null_inactivity", longest, short, "retained", "retained", 0, 0),
        ("compressed", "Repeated channels compressed", "repeated_channel_treatment", longest, usual, "consecutive_compressed", "retained", 0, 0),
        ("omit_direct", "Direct left out of mixed paths", "direct_treatment", longest, usual, "retained", "omitted_from_mixed_paths", 0, 0),
        ("bootstrap", "Bootstrap over users", "sampling_variation", longest, usual, "retained", "retained", BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED),
    ]


ASSUMPTIONS = "scenario string, label string, changed_assumption string, lookback_days long, inactivity_seconds long, repeated_channel_treatment string, direct_treatment string, bootstrap_replicates long, bootstrap_seed long"


def fingerprint(effects: DataFrame, scenario: str = "baseline") -> DataFrame:
    """One row: a SHA-256 over a scenario's channels and shares in millionths."""
    line = F.concat_ws(":", "channel", F.round(F.col("attribution_share") * 1_000_000).cast("long").cast("string"))
    return effects.where(F.col("scenario") == scenario).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256).alias("baseline_fingerprint"))  # a row per channel


def scenario_manifest(effects: DataFrame, scenario_edges: DataFrame, metrics: DataFrame, censored: DataFrame, s: Settings) -> DataFrame:
    """Every scenario with what it assumes, the one assumption it changes, its outcomes, and checks of its chain.

    The bootstrap resamples the baseline, so it has the baseline's outcomes and checks.
    """
    rows = effects.sparkSession.createDataFrame(scenario_assumptions(s), ASSUMPTIONS)
    rows = rows.withColumn("of", F.when(F.col("scenario") == "bootstrap", "baseline").otherwise(F.col("scenario")))
    matrix = transition_matrix(scenario_edges, ("scenario",))
    stays = F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0)
    by_row = matrix.groupBy("scenario", "src").agg(
        (F.abs(F.sum("probability") - 1) > 1e-12).alias("invalid"), F.max(F.col("is_absorbing") & (F.abs(F.col("probability") - stays) > 1e-12)).alias("invalid_absorber")
    )
    checked = by_row.groupBy(F.col("scenario").alias("of")).agg(
        F.count_if("invalid").alias("invalid_transition_row_count"), F.count_if("invalid_absorber").alias("invalid_absorbing_state_count"), F.count_if(F.col("src") == "Internal/Admin").alias("internal_admin_state_count")
    )
    negative = effects.groupBy(F.col("scenario").alias("of")).agg(F.count_if("is_materially_negative").alias("materially_negative_effect_count"))
    counts = metrics.select(F.col("scenario").alias("of"), "conversion_journey_count", "null_journey_count")
    out = rows.join(counts, "of").join(checked, "of").join(negative, "of").crossJoin(F.broadcast(censored)).crossJoin(F.broadcast(fingerprint(effects)))  # one row each
    base = F.col("scenario") == "baseline"
    return out.withColumns(
        {
            "is_baseline": base,
            "changed_assumption_count": F.when(base, 0).otherwise(1).cast("long"),
            "right_censored_journey_count": F.when(F.col("scenario") == "short_inactivity", F.col("censored_short")).otherwise(F.col("censored")),
            "right_censored_in_model_count": F.lit(0).cast("long"),
            "rank_tie_break_rule": F.lit("share_desc_channel_name_asc"),
            "sensitivity_version": F.lit(s.sensitivity_version),
        }
    ).drop("of", "censored", "censored_short")


def user_edges(paths: DataFrame) -> DataFrame:
    """(user_pseudo_id, src, dst, n): what one draw of a user adds to the counts."""
    return edges(paths, ("user_pseudo_id",))


#: Users of one block: they are drawn together, in one task's arrays.
BLOCK_USERS = 1024
HASH_DIGITS = 13


def draw_hash(seed: int, *parts: Column) -> Column:
    """52 bits of an MD5 of the seed and the parts."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")


def ranked_users(paths: DataFrame) -> DataFrame:
    """user_pseudo_id, edges, place: users from 0 on in the order of their MD5, which is no order of their paths."""
    users = user_edges(paths).groupBy("user_pseudo_id").agg(F.collect_list(F.struct("src", "dst", "n")).alias("edges"))
    users = global_rank(users.withColumn("_md5", F.md5("user_pseudo_id")), ["_md5", "user_pseudo_id"], "place")
    return users.withColumn("place", F.col("place") - 1).drop("_md5")


def bootstrap(paths: DataFrame, replicates: int = BOOTSTRAP_REPLICATES, seed: int = BOOTSTRAP_SEED, block_users: int = BLOCK_USERS) -> DataFrame:
    """Replicates over user clusters, each of as many draws with replacement as there are users.

    replicate, sampled_user_draws, unique_users_selected, channel, removal_effect, attribution_share, channel_rank,
    base_probability, active_state_count, reason (of a failure).

    Draws are a multinomial in two steps.  Users have places, and blocks of places.  Each draw of a replicate hashes to a
    place, of which the block alone is counted: these counts, summed map-side, add up to the number of users.  Then every
    block draws its own count among its users by a second hash, where its users' edges are, so that neither users nor
    draws are shuffled and no list of users is needed.  All depends on seed, replicate and places alone: any partitioning
    gives the same draws.  Channels that a replicate lacks have effect 0.
    """
    spark = paths.sparkSession
    users = ranked_users(paths)
    total = users.count()
    channels = [r[0] for r in paths.select(F.explode("path").alias("c")).distinct().where(~F.col("c").isin(START, CONVERSION, NULL)).orderBy("c").collect()]  # channels are a few tens
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = spark.range(0, total, 1, tasks).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    block = (draw_hash(seed, F.col("replicate"), F.col("draw")) % F.lit(max(total, 1)) / F.lit(block_users)).cast("long")
    counts = spread.select("replicate", block.alias("block")).groupBy("block", "replicate").agg(F.count(F.lit(1)).alias("draws"))
    own = users.withColumn("block", F.floor(F.col("place") / block_users).cast("long"))

    def draw(u: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """Edge sums of a block's draws per replicate; src null: how many draws, and of how many users."""
        if u.empty or c.empty:
            return pd.DataFrame({"replicate": [], "src": [], "dst": [], "n": []})
        u, size = u.sort_values("place"), len(u)
        places, pairs, n = [], [], []
        for i, edges in enumerate(u["edges"]):
            for e in edges:
                places.append(i)
                pairs.append((e["src"], e["dst"]))
                n.append(e["n"])
        kinds = sorted(set(pairs))
        number = {k: i for i, k in enumerate(kinds)}
        code = np.array([number[p] for p in pairs])
        places, n = np.array(places), np.array(n, dtype="float64")
        out = []
        for replicate, b, draws in zip(c["replicate"], c["block"], c["draws"], strict=True):
            head = hashlib.md5(f"{seed}|{replicate}|{b}|".encode())
            times = np.zeros(size, dtype="int64")
            for k in range(draws):
                h = head.copy()
                h.update(str(k).encode())
                times[int(h.hexdigest()[:HASH_DIGITS], 16) % size] += 1
            sums = np.bincount(code, weights=n * times[places], minlength=len(kinds))
            out += [(replicate, *k, int(x)) for k, x in zip(kinds, sums.tolist(), strict=True) if x]
            out += [(replicate, None, "draws", int(times.sum())), (replicate, None, "users", int(np.count_nonzero(times)))]
        return pd.DataFrame(out, columns=["replicate", "src", "dst", "n"])

    drawn = own.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(draw, "replicate int, src string, dst string, n long")
    summed = drawn.groupBy("replicate", "src", "dst").agg(F.sum("n").alias("n")).repartition(tasks, "replicate")
    columns = ["replicate", "sampled_user_draws", "unique_users_selected", "channel", "removal_effect", "attribution_share", "channel_rank", "base_probability", "active_state_count", "reason"]

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        active = rows[rows["src"].notna()]
        counted = rows[rows["src"].isna()].set_index("dst")["n"]
        head = (*key, int(counted["draws"]), int(counted["users"]))
        try:
            found = Chain.of(active["src"].to_list(), active["dst"].to_list(), active["n"].to_list()).effects()
            effects = {c: 0.0 for c in channels} | {r[0]: r[4] for r in found}
            shares = normalised(effects)
        except (ValueError, np.linalg.LinAlgError) as why:
            return pd.DataFrame([(*head, None, None, None, None, None, None, str(why))], columns=columns)
        ranks = {c: i + 1 for i, c in enumerate(sorted(channels, key=lambda c: (-round(shares[c], RANK_DIGITS), c)))}
        return pd.DataFrame([(*head, c, effects[c], shares[c], ranks[c], found[0][1], len(found) + 3, None) for c in channels], columns=columns)

    schema = "replicate int, sampled_user_draws long, unique_users_selected long, channel string, removal_effect double, attribution_share double, channel_rank long, base_probability double, active_state_count long, reason string"
    return summed.groupBy("replicate").applyInPandas(solve, schema)


def bootstrap_summary(draws: DataFrame, effects: DataFrame) -> DataFrame:
    """Per channel of the baseline's ``effects``: its share, effect and rank, and how all three spread over the replicates."""
    good = draws.where("reason IS NULL")
    counts = draws.agg(F.count_distinct("replicate").alias("attempted_replicates"), F.count_if(F.col("reason").isNotNull()).alias("failed_replicates"))
    agg = []
    for value, name in (("attribution_share", "share"), ("removal_effect", "removal_effect")):
        at = lambda p, v=value: F.percentile(v, F.lit(p))  # noqa: E731  a value per replicate
        agg += [F.avg(value).alias(f"mean_{name}"), at(0.5).alias(f"median_{name}"), F.stddev_samp(value).alias(f"{name}_stddev"), at(0.025).alias(f"{name}_percentile_2_5"), at(0.975).alias(f"{name}_percentile_97_5")]
    rank = F.col("channel_rank")
    agg += [F.avg(rank).alias("mean_rank"), F.percentile(rank, F.lit(0.5)).alias("median_rank"), F.min(rank).alias("minimum_rank"), F.max(rank).alias("maximum_rank")]
    agg += [F.avg((rank <= k).cast("double")).alias(f"probability_top_{k}") for k in (1, 3, 5)]
    base = effects.select("channel", F.col("attribution_share").alias("baseline_share"), F.col("removal_effect").alias("baseline_removal_effect"), ordinal_rank("attribution_share").alias("baseline_rank"))
    rows = good.groupBy("channel").agg(*agg).join(F.broadcast(base), "channel")  # a row per channel
    return rows.crossJoin(F.broadcast(counts)).withColumn("successful_replicates", F.col("attempted_replicates") - F.col("failed_replicates"))
