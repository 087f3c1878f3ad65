"""Queries of the composite operators: staging, sources, paths, attribution, chains, audits, marts, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditflow.operators import attribution, audits, distinct, markov, paths, reporting, sensitivity, validation
from creditflow.operators import sessions as S
from creditflow.plans.oracle import _channel, _quoted, _resolved
from creditflow.plans.primitive import CATALOG_SQL, NAMES
from creditflow.plans.registry import of_run
from creditflow.plans.run import Run
from creditflow.operators.sessions import CHANNEL_RULES
from creditflow.settings import DEFAULT as s
from creditflow.sources import readers

# Staging and sources
of_run("event_base", lambda r: r.event_base, "event_id event_date event_ts event_timestamp event_name user_pseudo_id user_id ga_session_id ga_session_number session_key event_source event_medium page_location_host page_location_domain page_referrer_host page_referrer_domain first_user_source first_user_medium device_category operating_system browser country region city transaction_id ~purchase_revenue_in_usd", "x_base")
of_run("orders_dedup", lambda r: r.orders, "order_key user_pseudo_id transaction_id order_ts order_date conversion_session_key ~order_revenue_usd purchase_event_count duplicate_purchase_event_count distinct_revenue_value_count ~minimum_observed_revenue_usd ~maximum_observed_revenue_usd", "x_orders")
SOURCE = "session_key user_pseudo_id ga_session_id session_start_ts session_end_ts event_count purchase_event_count raw_event_tuple_event_count source_resolution_tier resolved_source resolved_medium resolved_campaign resolved_source_host resolved_source_domain is_inferred_source source_quality"
of_run("source_v1", lambda r: r.provisional_sources, SOURCE, "x_provisional")
of_run("source_v2", lambda r: r.sources, SOURCE, "x_sources")
of_run("source_values", lambda r: r.sources.groupBy("source_resolution_tier", "resolved_source", "resolved_medium", "resolved_source_host").agg(F.count("*").alias("sessions")), "source_resolution_tier resolved_source resolved_medium resolved_source_host sessions", "(SELECT source_resolution_tier, resolved_source, resolved_medium, resolved_source_host, count(*) AS sessions FROM x_sources GROUP BY ALL)")
of_run("source_quality", lambda r: r.sources.groupBy("source_quality").agg(F.count("*").alias("sessions")), "source_quality sessions", "(SELECT source_quality, count(*) AS sessions FROM x_sources GROUP BY ALL)")
of_run("internal_evidence_count", lambda r: r.sources, "session_key #internal_storefront_evidence_type_count", "(SELECT session_key, CAST(has_internal_event_source AS INT) + CAST(has_internal_page_referrer AS INT) + CAST(has_internal_first_user_source AS INT) AS internal_storefront_evidence_type_count FROM x_sources)")
of_run("admin_flag", lambda r: r.sessions, "session_key is_internal_admin_traffic is_attribution_eligible internal_admin_reason", "(SELECT *, CASE WHEN is_internal_admin_traffic THEN 'approved_admin_host:' || resolved_source_host END AS internal_admin_reason FROM x_sessions)")
of_run("channel_map_v2", lambda r: r.sessions, "session_key channel #mapping_rule_priority mapping_rule_name", "x_sessions")
of_run("session_touchpoints", lambda r: r.sessions, f"{SOURCE} is_internal_admin_traffic is_attribution_eligible channel #mapping_rule_priority mapping_rule_name", "x_sessions")
of_run("order_cycles", lambda r: r.cycles, "order_key user_pseudo_id order_ts previous_order_ts same_timestamp_order_count same_timestamp_order_sequence", "x_cycles")
PATH = "order_key session_key channel touchpoint_ts touchpoint_number path_length seconds_before_conversion touchpoint_eligibility_rule is_same_session_multi_order_exception"
of_run("paths_strict", lambda r: r.strict, PATH, "x_strict")
of_run("paths_revised", lambda r: r.revised, PATH, "x_revised")
COVER = "order_key all_user_session_count session_on_or_before_order_count session_within_lookback_count strict_pre_internal_exclusion_session_count historical_baseline_touchpoint_count strict_internal_admin_session_count strict_attribution_eligible_session_count revised_pre_internal_exclusion_session_count revised_internal_admin_session_count revised_attribution_eligible_session_count current_conversion_session_exception_candidate_count strict_conversion_touchpoint_count conversion_touchpoint_count path_covered_strict path_covered_historical_baseline path_covered_revised recovered_by_current_conversion_session_exception historical_unmatched_recovered_by_exception historical_covered_order_lost_after_closeout coverage_lost_after_internal_exclusion"
of_run("aud_order_coverage", lambda r: r.coverage, COVER, "x_coverage")
of_run(
    "orders_unmatched",
    lambda r: paths.unmatched_orders(r.coverage),
    "order_key exclusion_reason",
    """(SELECT order_key, CASE WHEN revised_pre_internal_exclusion_session_count > 0 AND revised_attribution_eligible_session_count = 0 THEN 'NO_ELIGIBLE_TOUCHPOINT_AFTER_INTERNAL_EXCLUSION' WHEN all_user_session_count = 0 THEN 'NO_USER_SESSIONS'
    WHEN session_on_or_before_order_count = 0 THEN 'NO_SESSION_ON_OR_BEFORE_ORDER' WHEN session_within_lookback_count = 0 THEN 'NO_SESSION_WITHIN_LOOKBACK' WHEN revised_pre_internal_exclusion_session_count = 0 THEN 'NO_STANDARD_OR_CURRENT_CONVERSION_SESSION'
    ELSE 'NO_ATTRIBUTION_ELIGIBLE_TOUCHPOINT' END AS exclusion_reason FROM x_coverage WHERE conversion_touchpoint_count = 0)""",
)

# Attribution
for i, (name, model) in enumerate((("attr_first_click", "First Click"), ("attr_last_click", "Last Click"), ("attr_last_nondirect", "Last Non-direct Click"), ("attr_linear", "Linear"), ("attr_time_decay", "Time Decay"))):
    of_run(
        name,
        lambda r, m=model: attribution.model_weights(r.revised, s, paths.ORDER).where(F.col("model") == m),
        "order_key session_key channel ~attribution_weight",
        f"(SELECT *, w AS attribution_weight FROM x_weights WHERE model = '{model}' AND w > 0)",
    )
of_run("attr_results", lambda r: r.results, "order_key user_pseudo_id order_ts model channel ~attributed_conversion ~attributed_revenue", "x_results")
_p = attribution.PREFIX
of_run(
    "model_comparison",
    lambda r: attribution.model_comparison(r.results),
    "channel " + " ".join(f"~{p}_{n} ~{p}_{n}_share" for p in _p.values() for n in ("conversions", "revenue")) + " ~linear_minus_last_click_conversions ~time_decay_minus_last_click_conversions ~last_non_direct_minus_last_click_conversions",
    "(SELECT *, "
    + ", ".join(f"{p}_{n} / sum({p}_{n}) OVER () AS {p}_{n}_share" for p in _p.values() for n in ("conversions", "revenue"))
    + ", linear_conversions - last_click_conversions AS linear_minus_last_click_conversions, time_decay_conversions - last_click_conversions AS time_decay_minus_last_click_conversions, last_non_direct_conversions - last_click_conversions AS last_non_direct_minus_last_click_conversions FROM (SELECT channel, "
    + ", ".join(f"sum(CASE WHEN model = '{m}' THEN {c} ELSE 0 END) AS {p}_{n}" for m, p in _p.items() for c, n in (("attributed_conversion", "conversions"), ("attributed_revenue", "revenue")))
    + " FROM x_results GROUP BY channel))",
)

# Journeys and chains
of_run("markov_journeys", lambda r: r.journeys, "journey_id user_pseudo_id order_key ~attributable_revenue_usd journey_start_ts last_activity_ts inactivity_expiry_ts next_purchase_ts @channel_path @session_key_path session_count journey_status outcome_state is_markov_included is_left_boundary_truncated", "x_journeys")
of_run("markov_edges", lambda r: markov.edges(r.markov_paths), "src dst n", "(SELECT src, dst, n FROM x_edges WHERE scenario = 'baseline')")
of_run(
    "markov_matrix",
    lambda r: markov.transition_matrix(markov.edges(r.markov_paths)),
    "src dst #n ~probability is_absorbing",
    """(WITH st AS (SELECT src AS state FROM x_edges WHERE scenario = 'baseline' UNION SELECT dst FROM x_edges WHERE scenario = 'baseline' UNION SELECT unnest(['Start', 'Conversion', 'Null']))
    SELECT a.state AS src, b.state AS dst, coalesce(n, 0) AS n, a.state IN ('Conversion', 'Null') AS is_absorbing, CASE WHEN a.state IN ('Conversion', 'Null') THEN CASE WHEN a.state = b.state THEN 1.0 ELSE 0.0 END ELSE coalesce(n / CAST(sum(n) OVER (PARTITION BY a.state) AS DOUBLE), 0) END AS probability
    FROM st a CROSS JOIN st b LEFT JOIN (SELECT src, dst, n FROM x_edges WHERE scenario = 'baseline') e ON e.src = a.state AND e.dst = b.state)""",
)
of_run(
    "markov_reachability",
    lambda r: markov.reachability(r.scenario_edges, "scenario"),
    "scenario state reaches_conversion reaches_null is_trapped",
    """(WITH RECURSIVE r AS (SELECT DISTINCT scenario, goal, goal AS state FROM x_edges, (SELECT unnest(['Conversion', 'Null']) AS goal)
      UNION SELECT e.scenario, r.goal, e.src FROM r JOIN x_edges e ON e.scenario = r.scenario AND e.dst = r.state WHERE e.n > 0),
    st AS (SELECT scenario, src AS state FROM x_edges UNION SELECT scenario, dst FROM x_edges UNION SELECT scenario, unnest(['Start', 'Conversion', 'Null']) FROM (SELECT DISTINCT scenario FROM x_edges))
    SELECT scenario, state, bool_or(coalesce(goal = 'Conversion', FALSE)) AS reaches_conversion, bool_or(coalesce(goal = 'Null', FALSE)) AS reaches_null, bool_and(goal IS NULL) AS is_trapped FROM st LEFT JOIN r USING (scenario, state) GROUP BY ALL)""",
)
of_run(
    "markov_invalid_paths",
    lambda r: markov.invalid_paths(r.markov_paths),
    "journey_id",
    "(SELECT journey_id FROM x_journeys WHERE is_markov_included AND (len(channel_path) = 0 OR list_has_any(channel_path, ['Start', 'Null', 'Conversion'])))",
)
of_run("markov_absorption", lambda r: r.effects.select("base_probability").distinct(), "~base_probability", "(SELECT x AS base_probability FROM x_chance WHERE scenario = 'baseline' AND removed = '')")
of_run("markov_remove", lambda r: r.effects, "channel ~probability_without", "(SELECT * FROM x_effects WHERE scenario = 'baseline')")
of_run(
    "markov_effects",
    lambda r: r.effects,
    "channel ~base_probability ~probability_without ~raw_removal_effect ~removal_effect is_materially_negative",
    "(SELECT *, 1 - probability_without / base_probability AS raw_removal_effect, 1 - probability_without / base_probability < -1e-12 AS is_materially_negative FROM x_effects WHERE scenario = 'baseline')",
)
of_run("markov_normalize", lambda r: r.effects, "channel ~attribution_share", "(SELECT * FROM x_effects WHERE scenario = 'baseline')")
of_run("markov_attribution", lambda r: r.markov_attribution, "channel ~attributed_conversions ~attributed_revenue", "x_markov")
COMPARE = "channel model ~attributed_conversions ~attributed_revenue ~attribution_share channel_rank ~conversions_difference_vs_last_click ~conversions_relative_difference_vs_last_click ~revenue_difference_vs_last_click ~revenue_relative_difference_vs_last_click"
of_run("rule_markov_comparison", lambda r: r.comparison, COMPARE, "x_comparison")

# Sensitivity
of_run(
    "sens_lookback",
    lambda r: r.lookback,
    "#lookback_days cohort_view model channel attributable_order_count ~attributable_revenue ~average_path_length ~median_path_length ~multi_touch_share"
    " channel_touchpoint_count ~channel_touchpoint_share ~attributed_conversions ~attributed_revenue ~conversion_share ~revenue_share",
    "x_lookback",
)
of_run(
    "sens_null14",
    lambda r: r.short_null,
    "journey_id user_pseudo_id journey_start_ts last_activity_ts inactivity_expiry_ts next_purchase_ts @channel_path session_count journey_status overlapping_session_count"
    " is_overlap_excluded is_markov_included is_left_boundary_truncated",
    "x_short",
)
of_run("sens_paths", lambda r: r.journeys.where("is_markov_included"), "journey_id user_pseudo_id outcome_state @channel_path", "(SELECT * FROM x_journeys WHERE is_markov_included)")
for name, scenario in (("sens_compress", "compressed"), ("sens_omit_direct", "omit_direct")):
    of_run(
        name,
        lambda r, x=scenario: r.scenario_paths.where(F.col("scenario") == x).groupBy("path").agg(F.count("*").alias("journeys")),
        "@path journeys",
        f"(SELECT path, count(*) AS journeys FROM x_scenario_paths WHERE scenario = '{scenario}' GROUP BY path)",
    )
of_run(
    "sens_path_metrics",
    lambda r: r.metrics.join(sensitivity.channel_touchpoints(r.scenario_edges), "scenario"),
    "scenario #journeys #conversion_journey_count #null_journey_count ~attributable_revenue #touchpoints ~average_path_length ~median_path_length ~multi_touch_share channel #channel_touchpoint_count ~channel_touchpoint_share",
    "(SELECT * FROM x_metrics JOIN x_touches USING (scenario))",
)
SENSITIVITY = (
    "scenario cohort_view model channel #attributable_order_count ~attributable_revenue #conversion_journey_count #null_journey_count #right_censored_journey_count ~average_path_length ~median_path_length"
    " ~multi_touch_share #channel_touchpoint_count ~channel_touchpoint_share ~removal_effect ~attributed_conversions ~attributed_revenue ~conversion_share ~revenue_share conversion_rank revenue_rank"
    " ~baseline_conversion_probability"
)
of_run(
    "sens_markov_rows",
    lambda r: r.sensitivity.where("model = 'Markov'"),
    f"{SENSITIVITY} is_conversion_share_tied is_revenue_share_tied sensitivity_version",
    f"(SELECT *, '{s.sensitivity_version}' AS sensitivity_version FROM x_sens WHERE model = 'Markov')",
)
of_run(
    "sens_projection",
    lambda r: r.sensitivity.orderBy("scenario", "cohort_view", "model", "conversion_rank", "channel"),
    f"{SENSITIVITY} sensitivity_version",
    f"(SELECT *, '{s.sensitivity_version}' AS sensitivity_version FROM x_sens)",
)
of_run(
    "sens_rank_groups",
    lambda r: sensitivity.tied_channels(attribution.channel_totals(r.results), "attributed_conversions", "model", tolerance=1e-9),
    "model channel ~attributed_conversions is_tied",
    """(WITH c AS (SELECT model, channel, sum(attributed_conversion) AS attributed_conversions FROM x_results GROUP BY ALL)
    SELECT *, EXISTS (SELECT 1 FROM c d WHERE d.model = c.model AND d.channel <> c.channel AND abs(d.attributed_conversions - c.attributed_conversions) <= 1e-9) AS is_tied FROM c)""",
)
of_run(
    "rank_stability",
    lambda r: sensitivity.rank_stability(r.sensitivity),
    "scenario cohort_view model channel ~baseline_share ~scenario_share #baseline_rank #scenario_rank #absolute_rank_shift ~absolute_percentage_point_change ~relative_share_change"
    " ~spearman_rank_correlation #top_3_overlap #maximum_absolute_rank_shift baseline_is_tied scenario_is_tied",
    "x_stable",
)
of_run(
    "spearman",
    lambda r: sensitivity.rank_stability(r.sensitivity).groupBy("scenario", "cohort_view", "model").agg(F.max("spearman_rank_correlation").alias("spearman"), F.count("*").alias("channels")),
    "scenario cohort_view model ~spearman channels",
    "(SELECT scenario, cohort_view, model, max(spearman_rank_correlation) AS spearman, count(*) AS channels FROM x_stable GROUP BY ALL)",
)
of_run(
    "bootstrap_user_cluster",
    lambda r: r.bootstrap_draws,
    "#replicate sampled_user_draws unique_users_selected channel ~removal_effect ~attribution_share channel_rank ~base_probability active_state_count reason",
    "x_boot",
)
of_run(
    "bootstrap_summary",
    lambda r: sensitivity.bootstrap_summary(r.bootstrap_draws, r.effects),
    "channel ~mean_share ~median_share ~share_stddev ~share_percentile_2_5 ~share_percentile_97_5 ~mean_removal_effect ~median_removal_effect ~removal_effect_stddev ~removal_effect_percentile_2_5"
    " ~removal_effect_percentile_97_5 ~baseline_share ~baseline_removal_effect #baseline_rank ~mean_rank ~median_rank minimum_rank maximum_rank ~probability_top_1 ~probability_top_3 ~probability_top_5"
    " attempted_replicates successful_replicates failed_replicates",
    "x_boot_summary",
)
of_run(
    "scenario_manifest",
    lambda r: sensitivity.scenario_manifest(r.scenarios, r.scenario_edges, r.metrics, sensitivity.censored_journeys(r.journeys, r.short_null), s),
    "scenario label changed_assumption #changed_assumption_count is_baseline lookback_days inactivity_seconds repeated_channel_treatment direct_treatment bootstrap_replicates bootstrap_seed"
    " #conversion_journey_count #null_journey_count #right_censored_journey_count #right_censored_in_model_count #internal_admin_state_count #invalid_transition_row_count #invalid_absorbing_state_count"
    " #materially_negative_effect_count rank_tie_break_rule baseline_fingerprint",
    "x_manifest",
)

# Marts
_f = reporting.FUNNEL_EVENTS
_FUNNEL = (
    "(SELECT *, "
    + ", ".join(f"sessions_with_{e} / CAST(sessions AS DOUBLE) AS {e}_rate" for e in _f)
    + " FROM (SELECT channel, count(DISTINCT t.session_key) AS sessions, "
    + ", ".join(f"count(DISTINCT CASE WHEN event_name = '{e}' THEN t.session_key END) AS sessions_with_{e}" for e in _f)
    + " FROM x_sessions t LEFT JOIN x_base b USING (session_key) WHERE is_attribution_eligible AND channel <> 'Internal/Admin' GROUP BY channel))"
)
of_run(
    "channel_funnel",
    lambda r: reporting.channel_funnel(r.event_base, r.sessions, s),
    "channel sessions " + " ".join(f"#sessions_with_{e} ~{e}_rate" for e in _f),
    _FUNNEL,
)
SUMMARY = "summary_type dimension_key dimension_label #sort_order attributable_conversions ~attributable_revenue ~conversion_share ~revenue_share ~mean_path_length ~median_path_length #single_touch_conversions #multi_touch_conversions"
of_run("journey_summary", lambda r: reporting.journey_summary(r.revised, s), SUMMARY, "x_summary")
of_run("rpt_top_paths", lambda r: reporting.top_paths(r.revised), "dimension_key #sort_order attributable_conversions ~attributable_revenue", "(SELECT * FROM x_summary WHERE summary_type = 'CONVERTING_PATH' AND sort_order <= 10)")
of_run("rpt_path_length_bins", lambda r: reporting.path_length_bins(reporting.journey_summary(r.revised, s), cap=5), "bin #bin_order #conversions ~share", "(SELECT CASE WHEN path_length >= 5 THEN '5+' ELSE CAST(path_length AS VARCHAR) END AS bin, least(path_length, 5) AS bin_order, count(*) AS conversions, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM x_order_paths GROUP BY 1, 2)")
of_run(
    "attribution_business_summary",
    lambda r: reporting.business_summary(r.comparison, r.scenarios, sensitivity.bootstrap_summary(r.bootstrap_draws, r.effects), s),
    "channel model ~attributed_conversions ~attributed_revenue ~attribution_share ~revenue_share channel_rank revenue_rank ~markov_minus_last_click_conversions ~markov_minus_last_click_revenue scenarios minimum_scenario_rank maximum_scenario_rank ~scenario_rank_1_frequency ~scenario_top_3_frequency ~minimum_scenario_share ~maximum_scenario_share ~bootstrap_mean_share is_presentation_channel",
    """(WITH m AS (SELECT *, attributed_revenue / sum(attributed_revenue) OVER w AS revenue_share, row_number() OVER (PARTITION BY model ORDER BY round(attributed_revenue, 6) DESC, channel) AS revenue_rank,
    max(CASE WHEN model = 'Markov' THEN conversions_difference_vs_last_click END) OVER c AS markov_minus_last_click_conversions, max(CASE WHEN model = 'Markov' THEN revenue_difference_vs_last_click END) OVER c AS markov_minus_last_click_revenue
    FROM x_comparison WINDOW w AS (PARTITION BY model), c AS (PARTITION BY channel)),
    s AS (SELECT channel, count(DISTINCT scenario) AS scenarios, min(channel_rank) AS minimum_scenario_rank, max(channel_rank) AS maximum_scenario_rank, count(*) FILTER (channel_rank = 1) / CAST(count(*) AS DOUBLE) AS scenario_rank_1_frequency,
    count(*) FILTER (channel_rank <= 3) / CAST(count(*) AS DOUBLE) AS scenario_top_3_frequency, min(attribution_share) AS minimum_scenario_share, max(attribution_share) AS maximum_scenario_share FROM x_ranked GROUP BY channel)
    SELECT m.*, s.* EXCLUDE (channel), b.mean_share AS bootstrap_mean_share, m.channel NOT IN ('Unknown', 'Other') AS is_presentation_channel FROM m JOIN s USING (channel) JOIN x_boot_summary b USING (channel))""",
)
of_run("rpt_charts", lambda r: reporting.chart_revenue_by_model(r.comparison).toDF("channel", *[f"{p}_revenue" for p in _p.values()], "markov_revenue"), "channel " + " ".join(f"~{p}_revenue" for p in (*_p.values(), "markov")), "(SELECT channel, " + ", ".join(f"sum(CASE WHEN model = '{m}' THEN attributed_revenue END) AS {p}_revenue" for m, p in (*_p.items(), ("Markov", "markov"))) + " FROM x_comparison GROUP BY channel)")
of_run("rpt_chart_markov_difference", lambda r: reporting.chart_markov_difference(r.comparison), "channel ~revenue_difference_vs_last_click", "(SELECT * FROM x_comparison WHERE model = 'Markov')")
of_run("rpt_validate_funnel", lambda r: reporting.funnel_problems(reporting.channel_funnel(r.event_base, r.sessions, s)).withColumnRenamed("check", "check_name"), "check_name #violations", "(VALUES ('is_empty', 0), ('repeated_channels', 0), ('channels_without_sessions', 0), ('rates_out_of_range', 0)) AS v(check_name, violations)")

# Audits
of_run(
    "aud_schema",
    lambda r: audits.schema_audit(readers.catalog_fields(r.spark, {n: readers.table(r.spark, r.sf_dir, n) for n in NAMES}), list(NAMES)),
    "field_path top_level_column data_type #shards_containing_field first_table last_table #selected_shard_count present_in_all_shards",
    f"""(SELECT field_path, field_path AS top_level_column, data_type, count(*) AS shards_containing_field, min(table_name) AS first_table, max(table_name) AS last_table,
    {len(NAMES)} AS selected_shard_count, count(*) = {len(NAMES)} AS present_in_all_shards FROM ({CATALOG_SQL}) GROUP BY field_path, data_type)""",
)
of_run(
    "aud_date_coverage",
    lambda r: audits.date_coverage(r.raw, "2023-12-30", "2024-02-02"),
    "date shard_present #events #embedded_dates validation_status",
    "(SELECT CAST(d AS DATE) AS date, n IS NOT NULL AS shard_present, coalesce(n, 0) AS events, coalesce(e, 0) AS embedded_dates, CASE WHEN n IS NULL THEN 'FAIL_MISSING_SHARD' WHEN e <> 1 THEN 'FAIL_EMBEDDED_DATE_COUNT' WHEN mm <> 0 THEN 'FAIL_SUFFIX_DATE_MISMATCH' ELSE 'PASS' END AS validation_status FROM (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS d) LEFT JOIN (SELECT shard, count(*) AS n, count(DISTINCT strftime(event_ts, '%Y%m%d')) AS e, count(*) FILTER (strftime(event_ts, '%Y%m%d') <> shard) AS mm FROM x_raw GROUP BY shard) ON shard = strftime(d, '%Y%m%d'))",
)
of_run(
    "aud_event_dist",
    lambda r: audits.event_distribution(r.raw),
    "event_name event_count distinct_users ~event_share first_event_date last_event_date validation_status",
    "(SELECT event_name, count(*) AS event_count, count(DISTINCT user_pseudo_id) AS distinct_users, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS event_share, CAST(min(event_ts) AS DATE) AS first_event_date, CAST(max(event_ts) AS DATE) AS last_event_date, 'OBSERVED' AS validation_status FROM x_raw GROUP BY event_name)",
)
of_run(
    "aud_purchase_quality",
    lambda r: audits.purchase_quality(r.event_base),
    "purchase_events missing_transaction_ids placeholder_transaction_ids events_without_finite_revenue nonpositive_revenue_events ~finite_revenue observed_placeholders candidate_orders repeated_orders #excess_events transaction_ids_of_several_users validation_status",
    """(WITH p AS (SELECT *, coalesce(lower(trim(transaction_id)) IN ('(not set)', '(not provided)', '(data deleted)', '<other>', 'unknown'), FALSE) AS bad FROM x_base WHERE event_name = 'purchase'),
    o AS (SELECT user_pseudo_id, transaction_id, count(*) AS n FROM p WHERE transaction_id IS NOT NULL AND NOT bad GROUP BY ALL), sh AS (SELECT transaction_id, count(*) AS u FROM o GROUP BY ALL)
    SELECT count(*) AS purchase_events, count(*) FILTER (transaction_id IS NULL) AS missing_transaction_ids, count(*) FILTER (bad) AS placeholder_transaction_ids, count(*) FILTER (purchase_revenue_in_usd IS NULL) AS events_without_finite_revenue, count(*) FILTER (purchase_revenue_in_usd <= 0) AS nonpositive_revenue_events,
    sum(purchase_revenue_in_usd) AS finite_revenue, coalesce(string_agg(DISTINCT CASE WHEN bad THEN lower(trim(transaction_id)) END, ' | '), '') AS observed_placeholders, (SELECT count(*) FROM o) AS candidate_orders, (SELECT count(*) FROM o WHERE n > 1) AS repeated_orders, (SELECT coalesce(sum(n - 1), 0) FROM o) AS excess_events,
    (SELECT count(*) FROM sh WHERE u > 1) AS transaction_ids_of_several_users, CASE WHEN count(*) FILTER (transaction_id IS NULL OR bad) > 0 OR (SELECT count(*) FROM o WHERE n > 1) > 0 THEN 'REVIEW' ELSE 'PASS' END AS validation_status FROM p)""",
)
of_run(
    "aud_duplicate_purchases",
    lambda r: audits.duplicate_purchases(r.event_base),
    "order_key_hash is_placeholder purchase_event_count distinct_timestamps first_ts last_ts event_span_seconds distinct_finite_revenues ~minimum_finite_revenue ~maximum_finite_revenue validation_status",
    """(SELECT *, date_sub('second', first_ts, last_ts) AS event_span_seconds, CASE WHEN distinct_finite_revenues > 1 THEN 'REVIEW_REVENUE_CONFLICT' WHEN is_placeholder THEN 'REVIEW_PLACEHOLDER_TRANSACTION_ID' WHEN distinct_timestamps > 1 THEN 'REVIEW_REPEATED_EVENT' ELSE 'REVIEW_EXACT_TIMESTAMP_DUPLICATE' END AS validation_status FROM
    (SELECT sha256(CAST(to_json(struct_pack(user_pseudo_id := user_pseudo_id, transaction_id := transaction_id)) AS VARCHAR)) AS order_key_hash, bool_or(lower(transaction_id) = '(not set)') AS is_placeholder, count(*) AS purchase_event_count, count(DISTINCT event_ts) AS distinct_timestamps, min(event_ts) AS first_ts, max(event_ts) AS last_ts,
    count(DISTINCT purchase_revenue_in_usd) AS distinct_finite_revenues, min(purchase_revenue_in_usd) AS minimum_finite_revenue, max(purchase_revenue_in_usd) AS maximum_finite_revenue FROM x_base WHERE event_name = 'purchase' AND transaction_id IS NOT NULL GROUP BY user_pseudo_id, transaction_id HAVING count(*) > 1))""",
)
_SCOPED = "(SELECT 'all_events' AS scope, * FROM x_base UNION ALL SELECT 'purchase_events', * FROM x_base WHERE event_name = 'purchase' UNION ALL SELECT 'checkout_events', * FROM x_base WHERE event_name = 'begin_checkout')"
_RAW_SCOPED = _SCOPED.replace("x_base", "x_raw")
of_run(
    "aud_identifier_quality",
    lambda r: audits.identifier_quality(r.raw),
    "scope events missing_user_ids ~missing_user_rate missing_session_parameters repeated_session_parameters noninteger_session_ids missing_session_ids ~missing_session_rate nonpositive_session_ids"
    " distinct_users distinct_session_ids distinct_sessions session_ids_of_several_users validation_status",
    f"""(SELECT *, CASE WHEN repeated_session_parameters > 0 THEN 'REVIEW_REPEATED_PARAMETER' WHEN missing_user_ids + missing_session_ids + nonpositive_session_ids > 0 THEN 'REVIEW_IDENTIFIER_QUALITY' ELSE 'PASS' END AS validation_status
    FROM (SELECT scope, count(*) AS events, count(*) FILTER (user_pseudo_id IS NULL) AS missing_user_ids, count(*) FILTER (user_pseudo_id IS NULL) / CAST(count(*) AS DOUBLE) AS missing_user_rate, 0 AS missing_session_parameters,
      count(*) FILTER (session_parameters > 1) AS repeated_session_parameters, count(*) FILTER (ga_session_id IS NULL) AS noninteger_session_ids, count(*) FILTER (ga_session_id IS NULL) AS missing_session_ids,
      count(*) FILTER (ga_session_id IS NULL) / CAST(count(*) AS DOUBLE) AS missing_session_rate, count(*) FILTER (ga_session_id <= 0) AS nonpositive_session_ids, count(DISTINCT user_pseudo_id) AS distinct_users,
      count(DISTINCT ga_session_id) AS distinct_session_ids, count(DISTINCT CASE WHEN ga_session_id IS NOT NULL THEN user_pseudo_id || '|' || ga_session_id END) AS distinct_sessions FROM {_RAW_SCOPED} GROUP BY scope)
    CROSS JOIN (SELECT count(*) FILTER (u > 1) AS session_ids_of_several_users FROM (SELECT ga_session_id, count(DISTINCT user_pseudo_id) AS u FROM x_raw WHERE ga_session_id IS NOT NULL GROUP BY 1)))""",
)
_LONG = " UNION ALL ".join(f"SELECT scope, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM {_SCOPED}" for f in audits.TRAFFIC_FIELDS)
of_run(
    "aud_traffic_availability",
    lambda r: audits.traffic_availability(r.event_base),
    "scope field events missing placeholders present ~present_rate ~missing_rate",
    f"""(SELECT *, events - missing - placeholders AS present, (events - missing - placeholders) / CAST(events AS DOUBLE) AS present_rate, missing / CAST(events AS DOUBLE) AS missing_rate FROM
    (SELECT scope, field, count(*) AS events, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (lower(value) IN ('(not set)', '(not provided)', '(data deleted)', '<other>', 'unknown')) AS placeholders FROM ({_LONG}) GROUP BY ALL))""",
)
_USERS_LONG = " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, user_pseudo_id FROM x_base" for f in audits.TRAFFIC_FIELDS)
_VALUES = f"""(WITH v AS (SELECT field, substr(regexp_replace(value, '[?#].*$', ''), 1, 500) AS value, count(*) AS events, count(DISTINCT user_pseudo_id) AS distinct_users FROM ({_USERS_LONG}) WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY events DESC, value) AS rank, events / CAST(sum(events) OVER (PARTITION BY field) AS DOUBLE) AS share FROM v) WHERE rank <= 25)"""
of_run("aud_traffic_values", lambda r: audits.traffic_values(r.event_base), "field value #events #distinct_users rank ~share", _VALUES)


def _chunks(r: Run):
    """Three chunks by date, counted apart and then combined; users of several chunks count once."""
    users = distinct.dense_ids(r.event_base, "user_pseudo_id")
    days = ("2024-01-10", "2024-01-20")
    at = F.when(F.col("event_date") < days[0], 0).when(F.col("event_date") < days[1], 1).otherwise(2)
    return audits.combine_values([audits.traffic_chunk(r.event_base.where(at == i), users) for i in range(3)])


of_run("aud_traffic_combine", _chunks, "field value #events #distinct_users rank ~share", _VALUES)
of_run(
    "aud_internal_referrers",
    lambda r: audits.internal_referrers(r.event_base, s),
    "host domain referrer_events referrer_sessions #page_events_of_host #page_events_of_domain proposed_internal",
    """(SELECT h.*, (SELECT count(*) FROM x_base b WHERE b.page_location_host = h.host) AS page_events_of_host, (SELECT count(*) FROM x_base b WHERE b.page_location_domain = h.domain) AS page_events_of_domain, (SELECT count(*) FROM x_base b WHERE b.page_location_domain = h.domain) > 0 AS proposed_internal
    FROM (SELECT page_referrer_host AS host, page_referrer_domain AS domain, count(*) AS referrer_events, count(DISTINCT session_key) AS referrer_sessions FROM x_base WHERE page_referrer_host IS NOT NULL GROUP BY ALL) h)""",
)
of_run("aud_source_coverage", lambda r: audits.source_coverage(r.sessions), "source_resolution_tier #tier_order #sessions ~session_share", "(SELECT source_resolution_tier, tier_order, coalesce(n, 0) AS sessions, coalesce(n, 0) / CAST((SELECT count(*) FROM x_sessions) AS DOUBLE) AS session_share FROM (VALUES ('event_level_source', 1), ('external_referrer', 2), ('first_user_fallback', 3), ('Direct', 4), ('Unknown', 5)) AS v(source_resolution_tier, tier_order) LEFT JOIN (SELECT source_resolution_tier, count(*) AS n FROM x_sessions GROUP BY ALL) USING (source_resolution_tier))")
of_run("aud_source_frequency", lambda r: audits.source_frequency(r.sessions), "source_resolution_tier resolved_source resolved_medium resolved_campaign sessions ~session_share", "(SELECT source_resolution_tier, resolved_source, resolved_medium, resolved_campaign, count(*) AS sessions, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS session_share FROM x_sessions GROUP BY 1, 2, 3, 4)")
of_run(
    "rules_tables",
    lambda r: audits.mapping_rules(r.spark, s).join(r.sessions.groupBy(F.col("mapping_rule_name").alias("rule_name")).agg(F.count("*").alias("sessions")), "rule_name", "left").fillna(0, ["sessions"]),
    "#priority channel rule_name #sessions",
    "(SELECT v.*, (SELECT count(*) FROM x_sessions WHERE mapping_rule_name = rule_name) AS sessions FROM (VALUES " + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in CHANNEL_RULES) + ") AS v(priority, channel, rule_name))",
)
_social = f"regexp_matches(lower(resolved_source), '{audits.PROPOSED_SOCIAL}')"
_med = lambda p: f"regexp_matches(lower(resolved_medium), '{p}')"
_PROPOSED = {
    "Direct": "source_resolution_tier = 'Direct' OR lower(resolved_source) = '(direct)' OR lower(resolved_medium) = '(none)'",
    "Paid Social": f"{_med(S.PAID_SOCIAL_MEDIUM)} OR ({_med(S.PAID_MEDIUM)} AND {_social})",
    "Paid Search": _med(S.PAID_MEDIUM),
    "Display": _med(S.DISPLAY_MEDIUM),
    "Email": _med(S.EMAIL_MEDIUM),
    "Affiliates": _med(S.AFFILIATE_MEDIUM),
    "Organic Search": _med(S.ORGANIC_MEDIUM),
    "Organic Social": f"{_med(S.SOCIAL_MEDIUM)} OR {_social}",
    "Referral": "source_resolution_tier = 'external_referrer' OR lower(resolved_medium) = 'referral'",
    "Unknown": "source_resolution_tier = 'Unknown' OR (resolved_source IS NULL AND resolved_medium IS NULL)",
    "Other": "TRUE",
}
of_run(
    "rules_proposal",
    lambda r: audits.mapping_proposal(r.sessions),
    "#priority proposed_channel approval_status #sessions #mapped_alike",
    "(WITH p AS (SELECT channel, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _PROPOSED.items()) + " END AS proposed FROM x_sessions) SELECT i AS priority, names[i] AS proposed_channel, 'PROPOSED_NOT_APPROVED' AS approval_status,"
    " (SELECT count(*) FROM p WHERE proposed = names[i]) AS sessions, (SELECT count(*) FROM p WHERE proposed = names[i] AND channel = proposed) AS mapped_alike"
    f" FROM (SELECT [{_quoted(_PROPOSED)}] AS names, unnest(range(1, {len(_PROPOSED) + 1})) AS i))",
)
of_run(
    "rules_domains",
    lambda r: audits.domain_rules(r.sessions, s),
    "name match_type decision #sessions",
    f"(SELECT name, match_type, decision, (SELECT count(*) FROM x_sessions WHERE CASE match_type WHEN 'exact_host' THEN resolved_source_host = name ELSE resolved_source_domain = name END) AS sessions FROM (VALUES ('{s.storefront}', 'registered_domain', 'INTERNAL_STOREFRONT'), "
    + ", ".join(f"('{h}', 'exact_host', 'INTERNAL_ADMIN')" for h in s.admin_hosts)
    + ") AS v(name, match_type, decision))",
)
_CHANNEL = {x: _channel(*[f"{x}.{c}" for c in _resolved[:-1]], f"coalesce(lower({x}.resolved_source_host) IN ({_quoted(s.admin_hosts)}), FALSE)", 1) for x in "ba"}
_DIFF = f"(SELECT b.session_key, b.source_resolution_tier AS before_source_resolution_tier, a.source_resolution_tier AS after_source_resolution_tier, b.resolved_source AS before_resolved_source, {_CHANNEL['b']} AS before_channel, {_CHANNEL['a']} AS after_channel, b.resolved_medium AS before_resolved_medium, a.resolved_source AS after_resolved_source, coalesce(b.has_internal_event_source, FALSE) AS is_affected_by_storefront, (b.source_resolution_tier, b.resolved_source, b.resolved_medium, b.resolved_campaign) IS DISTINCT FROM (a.source_resolution_tier, a.resolved_source, a.resolved_medium, a.resolved_campaign) AS is_changed FROM x_provisional b FULL JOIN x_sources a USING (session_key))"
of_run("aud_reprocess", lambda r: audits.reprocessing_of(r.sources, s), "session_key before_source_resolution_tier after_source_resolution_tier before_resolved_source after_resolved_source is_affected_by_storefront is_changed", _DIFF)
of_run(
    "aud_reprocess_summary",
    lambda r: audits.reprocessing_summary(audits.reprocessing_of(r.sources, s), s),
    "before_source_resolution_tier after_source_resolution_tier before_channel after_channel is_affected_by_storefront is_changed #sessions",
    f"(SELECT * EXCLUDE (session_key, before_resolved_source, before_resolved_medium, after_resolved_source), count(*) AS sessions FROM {_DIFF} GROUP BY ALL)",
)
_MAP = "channel mapping_rule_name source_resolution_tier resolved_source resolved_medium resolved_source_domain source_quality is_inferred_source is_internal_admin_traffic"
of_run("aud_channel_mapping", lambda r: audits.channel_mapping(r.sessions), f"{_MAP} sessions distinct_users", f"(SELECT {', '.join(_MAP.split())}, count(*) AS sessions, count(DISTINCT user_pseudo_id) AS distinct_users FROM x_sessions GROUP BY ALL)")
_IMPACT = " ".join(f"#{v}_touchpoints_before #{v}_orders_before ~{v}_revenue_before #{v}_orders_after ~{v}_revenue_after #{v}_orders_lost ~{v}_revenue_lost" for v in ("strict", "revised"))
_IMPACT_SQL = (
    "(WITH a AS (SELECT resolved_source_host AS admin_host, * FROM x_sessions WHERE is_internal_admin_traffic UNION ALL SELECT 'ALL_APPROVED_ADMIN_HOSTS', * FROM x_sessions WHERE is_internal_admin_traffic),"
    "n AS (SELECT admin_host, count(*) AS affected_sessions, count(DISTINCT user_pseudo_id) AS affected_users FROM a GROUP BY admin_host),"
    "c AS (SELECT resolved_source_host AS admin_host, * FROM x_candidates WHERE is_internal_admin_traffic UNION ALL SELECT 'ALL_APPROVED_ADMIN_HOSTS', * FROM x_candidates WHERE is_internal_admin_traffic),"
    "o AS (SELECT admin_host, order_key, any_value(order_revenue_usd) AS rev, count(*) FILTER (is_standard) AS strict_rows, count(*) FILTER (is_standard OR is_own) AS revised_rows FROM c GROUP BY ALL),"
    "i AS (SELECT admin_host, "
    + ", ".join(
        f"sum({v}_rows) AS {v}_touchpoints_before, count(*) FILTER ({v}_rows > 0) AS {v}_orders_before, sum(CASE WHEN {v}_rows > 0 THEN rev ELSE 0 END) AS {v}_revenue_before, count(*) FILTER ({v}_rows > 0 AND path_covered_{v}) AS {v}_orders_after, sum(CASE WHEN {v}_rows > 0 AND path_covered_{v} THEN rev ELSE 0 END) AS {v}_revenue_after"
        for v in ("strict", "revised")
    )
    + " FROM o JOIN x_coverage USING (order_key) GROUP BY admin_host) SELECT *, "
    + ", ".join(f"{v}_orders_before - {v}_orders_after AS {v}_orders_lost, {v}_revenue_before - {v}_revenue_after AS {v}_revenue_lost" for v in ("strict", "revised"))
    + " FROM n JOIN i USING (admin_host))"
)
of_run("aud_admin_impact", lambda r: audits.admin_impact(r.cycles, r.sessions, r.coverage, s), f"admin_host affected_sessions affected_users {_IMPACT}", _IMPACT_SQL)
of_run("aud_admin_candidate", lambda r: audits.admin_impact(r.cycles, r.sessions, r.coverage, s).where(F.col("admin_host") == s.admin_hosts[0]), f"admin_host affected_sessions affected_users {_IMPACT}", f"(SELECT * FROM {_IMPACT_SQL} WHERE admin_host = '{s.admin_hosts[0]}')")
of_run("aud_session_reuse", lambda r: audits.session_reuse(r.strict, r.revised), "session_key user_pseudo_id #strict_orders revised_orders standard_assignments exception_assignments unapproved_assignments mismatched_exceptions first_order_ts last_order_ts @order_keys", "x_reuse")
of_run(
    "aud_path_length",
    lambda r: audits.path_length_distribution(r.coverage),
    "path_variant path_length orders ~revenue ~order_share ~revenue_share",
    "(SELECT *, orders / CAST((SELECT count(*) FROM x_coverage) AS DOUBLE) AS order_share, revenue / (SELECT sum(order_revenue_usd) FROM x_coverage) AS revenue_share FROM (SELECT 'strict' AS path_variant, strict_conversion_touchpoint_count AS path_length, count(*) AS orders, sum(order_revenue_usd) AS revenue FROM x_coverage GROUP BY ALL UNION ALL SELECT 'revised', conversion_touchpoint_count, count(*), sum(order_revenue_usd) FROM x_coverage GROUP BY ALL))",
)
_V = {"historical": ("path_covered_historical_baseline", "historical_baseline_touchpoint_count"), "strict": ("path_covered_strict", "strict_conversion_touchpoint_count"), "revised": ("path_covered_revised", "conversion_touchpoint_count")}
of_run(
    "aud_closeout",
    lambda r: audits.closeout(r.coverage, r.revised, audits.session_reuse(r.strict, r.revised)),
    "orders ~revenue " + " ".join(f"{v}_orders ~{v}_revenue #{v}_touchpoints {v}_multi_touch_orders {v}_unmatched_orders ~{v}_order_coverage ~{v}_average_path_length" for v in _V) + " recovered_orders historical_recovered_orders historical_lost_orders orders_lost_to_exclusion exception_touchpoints exception_sessions reused_sessions #unapproved_assignments",
    "(SELECT *, "
    + ", ".join(f"orders - {v}_orders AS {v}_unmatched_orders, {v}_orders / CAST(orders AS DOUBLE) AS {v}_order_coverage, {v}_touchpoints / CAST(nullif({v}_orders, 0) AS DOUBLE) AS {v}_average_path_length" for v in _V)
    + " FROM (SELECT count(*) AS orders, sum(order_revenue_usd) AS revenue, "
    + ", ".join(f"count(*) FILTER ({c}) AS {v}_orders, sum(CASE WHEN {c} THEN order_revenue_usd ELSE 0 END) AS {v}_revenue, sum({n}) AS {v}_touchpoints, count(*) FILTER ({n} > 1) AS {v}_multi_touch_orders" for v, (c, n) in _V.items())
    + ", count(*) FILTER (recovered_by_current_conversion_session_exception) AS recovered_orders, count(*) FILTER (historical_unmatched_recovered_by_exception) AS historical_recovered_orders, count(*) FILTER (historical_covered_order_lost_after_closeout) AS historical_lost_orders, count(*) FILTER (coverage_lost_after_internal_exclusion) AS orders_lost_to_exclusion FROM x_coverage),"
    " (SELECT count(*) AS exception_touchpoints, count(DISTINCT session_key) AS exception_sessions FROM x_revised WHERE is_same_session_multi_order_exception), (SELECT count(*) AS reused_sessions, coalesce(sum(unapproved_assignments), 0) AS unapproved_assignments FROM x_reuse))",
)

# Checks
#: check_id and the SQL whose rows break it, over the tables of plans/oracle.py.
CHECKS_SQL = {
    "orders_unique": "SELECT order_key FROM x_orders GROUP BY 1 HAVING count(*) > 1",
    "sessions_unique": "SELECT session_key FROM x_sessions GROUP BY 1 HAVING count(*) > 1",
    "sessions_cover_events": "SELECT 1 FROM x_base b WHERE session_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x_sessions t WHERE t.session_key = b.session_key)",
    "session_span_ordered": "SELECT 1 FROM x_sessions WHERE session_start_ts > session_end_ts",
    "channel_of_every_session": "SELECT 1 FROM x_sessions WHERE channel IS NULL",
    "admin_sessions_ineligible": "SELECT 1 FROM x_sessions WHERE is_internal_admin_traffic AND is_attribution_eligible",
    "paths_unique": "SELECT 1 FROM x_revised GROUP BY order_key, session_key HAVING count(*) > 1",
    "strict_inside_revised": "SELECT 1 FROM x_strict ANTI JOIN x_revised USING (order_key, session_key)",
    "touchpoints_before_order": "SELECT 1 FROM x_revised WHERE touchpoint_ts > order_ts OR seconds_before_conversion < 0",
    "touchpoints_numbered": "SELECT 1 FROM x_revised GROUP BY order_key HAVING max(touchpoint_number) <> count(*) OR max(path_length) <> count(*)",
    "no_admin_touchpoint": "SELECT 1 FROM x_revised WHERE channel = 'Internal/Admin'",
    "coverage_of_every_order": "SELECT 1 FROM x_orders ANTI JOIN x_coverage USING (order_key)",
    "conversions_sum_to_one": "SELECT 1 FROM x_results GROUP BY order_key, model HAVING abs(sum(attributed_conversion) - 1) > 1e-9",
    "revenue_is_shared_out": "SELECT 1 FROM x_results GROUP BY order_key, model HAVING abs(sum(attributed_revenue) - max(order_revenue_usd)) > 1e-6",
    "no_weight_without_path": "SELECT 1 FROM x_results ANTI JOIN x_revised USING (order_key)",
    "journeys_unique": "SELECT 1 FROM x_journeys GROUP BY journey_id HAVING count(*) > 1",
    "journey_lengths": "SELECT 1 FROM x_journeys WHERE len(channel_path) <> session_count OR len(session_key_path) <> session_count",
    "conversion_journeys_are_paths": "SELECT DISTINCT order_key FROM x_revised ANTI JOIN (SELECT order_key FROM x_journeys WHERE outcome_state = 'Conversion') USING (order_key)",
    "censored_not_included": "SELECT 1 FROM x_journeys WHERE journey_status = 'Right Censored' AND is_markov_included",
    "no_outcome_inside_paths": "SELECT 1 FROM x_journeys WHERE list_has_any(channel_path, ['Start', 'Conversion', 'Null'])",
    "matrix_rows_sum_to_one": "SELECT 1 FROM x_prob WHERE scenario = 'baseline' GROUP BY src HAVING abs(sum(p) - 1) > 1e-9",
    "absorbing_states_stay": "SELECT 1 FROM x_edges WHERE scenario = 'baseline' AND src IN ('Conversion', 'Null')",
    "effects_are_shares": "SELECT 1 FROM x_effects WHERE scenario = 'baseline' AND (removal_effect < 0 OR removal_effect > 1)",
    "removal_never_helps": "SELECT 1 FROM x_effects WHERE scenario = 'baseline' AND probability_without > base_probability + 1e-9",
    "scenario_shares_sum_to_one": "SELECT 1 FROM x_ranked GROUP BY scenario HAVING abs(sum(attribution_share) - 1) > 1e-9",
    "scenario_ranks_are_permutations": "SELECT 1 FROM x_ranked GROUP BY scenario HAVING min(channel_rank) <> 1 OR max(channel_rank) <> count(*) OR count(DISTINCT channel_rank) <> count(*)",
    "direct_only_as_fallback": "SELECT 1 FROM x_results r JOIN (SELECT order_key, bool_and(channel = 'Direct') AS d FROM x_revised GROUP BY 1) USING (order_key) WHERE model = 'Last Non-direct Click' AND (r.channel = 'Direct') <> d",
    "touchpoints_in_lookback": f"SELECT 1 FROM x_revised WHERE seconds_before_conversion > {s.lookback_days * 86_400}",
    "wider_windows_hold_more": "SELECT 1 FROM x_coverage WHERE all_user_session_count < session_on_or_before_order_count OR session_on_or_before_order_count < session_within_lookback_count",
    "revised_covers_strict": "SELECT 1 FROM x_coverage WHERE conversion_touchpoint_count < strict_conversion_touchpoint_count",
    "funnel_channels_unique": f"SELECT 1 FROM {_FUNNEL} GROUP BY channel HAVING count(*) > 1",
    "funnel_rates_in_range": f"SELECT 1 FROM {_FUNNEL} WHERE sessions <= 0" + "".join(f" OR {e}_rate IS NULL OR {e}_rate < 0 OR {e}_rate > 1" for e in _f),
    "models_credit_all_orders": "SELECT model FROM x_comparison GROUP BY 1 HAVING abs(sum(attributed_conversions) - (SELECT count(*) FROM x_order_paths)) > 1e-9 * (SELECT greatest(1, count(*)) FROM x_order_paths)",
    "models_credit_all_revenue": "SELECT model FROM x_comparison GROUP BY 1 HAVING abs(sum(attributed_revenue) - (SELECT sum(revenue) FROM x_order_paths)) > 1e-9 * (SELECT greatest(1, abs(sum(revenue))) FROM x_order_paths)",
    "model_shares_sum_to_one": "SELECT model FROM x_comparison GROUP BY 1 HAVING abs(sum(attribution_share) - 1) > 1e-9",
    "six_models_per_channel": "SELECT channel FROM x_comparison GROUP BY 1 HAVING count(DISTINCT model) <> 6 OR count(*) <> 6",
    "last_click_equals_itself": "SELECT 1 FROM x_comparison WHERE model = 'Last Click' AND (conversions_difference_vs_last_click <> 0 OR revenue_difference_vs_last_click <> 0)",
    "summaries_hold_all_orders": "SELECT summary_type FROM x_summary GROUP BY 1 HAVING sum(attributable_conversions) <> (SELECT count(*) FROM x_order_paths)",
    "summaries_hold_all_revenue": "SELECT summary_type FROM x_summary GROUP BY 1 HAVING abs(sum(attributable_revenue) - (SELECT sum(revenue) FROM x_order_paths)) > 1e-9 * (SELECT greatest(1, abs(sum(revenue))) FROM x_order_paths)",
    "summary_shares_sum_to_one": "SELECT summary_type FROM x_summary GROUP BY 1 HAVING abs(sum(conversion_share) - 1) > 1e-9",
    "scenario_outcomes_add_up": "SELECT 1 FROM x_metrics WHERE conversion_journey_count + null_journey_count <> journeys OR touchpoints < journeys",
    "lookbacks_credit_their_orders": "SELECT 1 FROM x_lookback GROUP BY lookback_days, cohort_view, model HAVING max(attributable_order_count) <> min(attributable_order_count) OR abs(sum(attributed_conversions) - max(attributable_order_count)) > 1e-9 * greatest(1, max(attributable_order_count))",
    "lookback_shares_sum_to_one": "SELECT 1 FROM x_lookback GROUP BY lookback_days, cohort_view, model HAVING abs(sum(conversion_share) - 1) > 1e-9",
}


def _checks(r: Run):
    core = validation.core_checks(r.event_base, r.orders, r.sessions, r.strict, r.revised, r.coverage, r.results, r.journeys, s)
    matrix, funnel = markov.transition_matrix(markov.edges(r.markov_paths)), reporting.channel_funnel(r.event_base, r.sessions, s)
    models = validation.model_checks(matrix, r.effects, r.scenarios, funnel, r.revised, r.coverage, r.results, s)
    marts = validation.mart_checks(r.comparison, reporting.journey_summary(r.revised, s), r.metrics, r.lookback, r.revised)
    return validation.run_checks(core + models + marts)


of_run(
    "ctl_validate",
    _checks,
    "check_id #observed #expected status",
    "(SELECT *, 0 AS expected, CASE WHEN observed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS check_id, count(*) AS observed FROM ({v})" for k, v in CHECKS_SQL.items()) + "))",
)
of_run(
    "ctl_formula_replay",
    lambda r: validation.formula_replay(r.revised, r.results, r.scenario_edges.where("scenario = 'baseline'"), r.effects, r.markov_attribution, s),
    "model #compared #differences ~replayed_conversions ~replayed_revenue",
    """(SELECT model, count(*) AS compared, 0 AS differences, sum(attributed_conversion) AS replayed_conversions, sum(attributed_revenue) AS replayed_revenue FROM x_results GROUP BY model
    UNION ALL SELECT 'Markov', count(*), 0, sum(attributed_conversions), sum(attributed_revenue) FROM x_markov)""",
)
of_run("ctl_fingerprint", lambda r: readers.snapshot(r.orders), "rows fingerprint schema")
