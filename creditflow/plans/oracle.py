"""The same tables in SQL for DuckDB: a yardstick that shares nothing with the Spark plans but the parameters."""

from __future__ import annotations

import re

from creditflow.operators import sessions as S
from creditflow.operators.sensitivity import BLOCK_USERS, BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED, HASH_DIGITS, scenario_assumptions
from creditflow.settings import DEFAULT
from creditflow.sources.web_events import EVIDENCE, SESSION_GAP_SECONDS

s = DEFAULT
END = f"TIMESTAMP '{s.boundary_end}'"
BEGIN = f"TIMESTAMP '{s.boundary_start}'"


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _evidence(column: int) -> str:
    value = lambda v: "NULL" if v is None else f"'{v}'"
    return "CASE " + " ".join(f"WHEN k <= {row[0]} THEN {value(row[column])}" for row in EVIDENCE) + " END"


#: Every character of Unicode's White_Space property.
_WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]))


def text(c: str) -> str:
    return f"nullif(trim({c}, '{_WHITE}'), '')"


def _placeholder(c: str) -> str:
    return f"CASE WHEN lower({c}) NOT IN ('', '(not set)', '(not provided)', '(data deleted)', '<other>', 'unknown') THEN {c} END"


def host(c: str) -> str:
    pattern = r"^(?:(?:[a-z][a-z0-9+.-]*:)?//)?(?:[^/@?#]*@)?([^/:?#@\s]+)(?:[/:?#].*)?$"
    return f"nullif(regexp_extract(lower({c}), '{pattern}', 1), '')"


def domain(h: str) -> str:
    """The longest suffix of the host that matches a rule, an exception first, and one label more."""
    rules = s.public_suffixes
    kinds = [[r for r in rules if r[0] not in "*!"], [r[2:] for r in rules if r[0] == "*"], [r[1:] for r in rules if r[0] == "!"]]
    exact, parents, spared = (_quoted(k) or "''" for k in kinds)
    p = f"string_split({h}, '.')"
    longest = lambda test, n: f"list_max(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {test} THEN {n} ELSE 0 END))"
    any_rule = longest(f"array_to_string({p}[i:], '.') IN ({exact}) OR (i < len({p}) AND array_to_string({p}[i + 1:], '.') IN ({parents}))", f"len({p}) - i + 1")
    exception = longest(f"array_to_string({p}[i:], '.') IN ({spared})", f"len({p}) - i")
    length = f"coalesce(nullif({exception}, 0), greatest({any_rule}, 1))"
    valid = f"len({p}) > {length} AND NOT list_contains({p}, '') AND NOT regexp_matches({p}[-1], '^[0-9]+$')"
    return f"CASE WHEN {valid} THEN array_to_string({p}[len({p}) - {length}:], '.') END"


_BARE = r"^(?:[a-z0-9-]+\.)+[a-z]{2,}$"


def _source_host(c: str) -> str:
    return f"CASE WHEN regexp_matches(lower({c}), '^[a-z][a-z0-9+.-]*://') THEN {host(c)} WHEN regexp_matches(lower({c}), '{_BARE}') THEN lower({c}) END"


def _source_domain(c: str) -> str:
    bare = f"regexp_replace(lower({c}), '^[a-z][a-z0-9+.-]*://', '')"
    return f"CASE WHEN regexp_matches({bare}, '{_BARE}') THEN {domain(bare)} END"


def _direct(p: str) -> str:
    return f"(coalesce(lower({p}_source), '') = '(direct)' OR coalesce(lower({p}_medium), '') = '(none)')"


def _tuple(p: str, name: bool) -> str:
    key = "k_name := coalesce(event_name, ''), " if name else ""
    return f"struct_pack(ts := event_ts, {key}k_source := coalesce({p}_source, ''), k_medium := coalesce({p}_medium, ''), k_campaign := coalesce({p}_campaign, ''), source := {p}_source, medium := {p}_medium, campaign := {p}_campaign, source_host := {p}_source_host, source_domain := {p}_source_domain)"


def _tier(e: str, r: str, f: str, d: str) -> str:
    return f"CASE source_resolution_tier WHEN 'event_level_source' THEN {e} WHEN 'external_referrer' THEN {r} WHEN 'first_user_fallback' THEN {f} WHEN 'Direct' THEN {d} END"


def _channel(tier: str, source: str, medium: str, host: str, domain: str, admin: str, field: int) -> str:
    m, d = f"lower(coalesce({medium}, ''))", f"coalesce({domain}, '')"
    social = f"({d} IN ({_quoted(S.SOCIAL_DOMAINS)}) OR regexp_matches({d}, '{S.SOCIAL_DOMAIN_PATTERN}'))"
    is_ = lambda p: f"regexp_matches({m}, '{p}')"
    tests = [
        admin,
        f"{tier} = 'Direct' OR coalesce(lower({source}), '') = '(direct)' OR {m} = '(none)'",
        f"{is_(S.PAID_SOCIAL_MEDIUM)} OR ({is_(S.PAID_MEDIUM)} AND {social})",
        is_(S.PAID_MEDIUM),
        is_(S.DISPLAY_MEDIUM),
        is_(S.EMAIL_MEDIUM),
        is_(S.AFFILIATE_MEDIUM),
        is_(S.ORGANIC_MEDIUM),
        f"lower(coalesce({host}, '')) <> '{S.NOT_SOCIAL_HOST}' AND ({is_(S.SOCIAL_MEDIUM)} OR {social})",
        f"{tier} = 'external_referrer' OR {m} = 'referral'",
        f"{tier} = 'Unknown' OR ({source} IS NULL AND {medium} IS NULL)",
    ]
    value = lambda rule: str(rule[0]) if field == 0 else f"'{rule[field]}'"
    return "CASE " + " ".join(f"WHEN {t} THEN {value(r)}" for t, r in zip(tests, S.CHANNEL_RULES[:-1], strict=True)) + f" ELSE {value(S.CHANNEL_RULES[-1])} END"


_ELIGIBLE = "is_attribution_eligible AND NOT is_internal_admin_traffic AND channel <> 'Internal/Admin'"
_resolved = ("source_resolution_tier", "resolved_source", "resolved_medium", "resolved_source_host", "resolved_source_domain", "is_internal_admin_traffic")


def _resolution(provisional: bool) -> str:
    early = "WHEN direct_evidence_ts IS NOT NULL THEN 'Direct'" if provisional else ""
    return f"""
SELECT *, CASE WHEN resolved_source IS NULL AND resolved_medium IS NOT NULL THEN 'medium_only' WHEN is_inferred_source THEN 'inferred'
    WHEN source_resolution_tier = 'first_user_fallback' THEN 'first_user_fallback' WHEN source_resolution_tier = 'Direct' THEN 'explicit_direct'
    WHEN source_resolution_tier = 'Unknown' THEN 'missing' WHEN source_resolution_tier = 'event_level_source' THEN 'event_observed'
    ELSE 'referrer_observed' END AS source_quality
FROM (SELECT *, {_tier("event_tuple.source", "external_referrer.source_host", "first_user_tuple.source", "'(direct)'")} AS resolved_source,
    {_tier("event_tuple.medium", f"CASE WHEN external_referrer.source_host = '{s.inferred_search_host}' THEN 'organic' ELSE 'referral' END", "first_user_tuple.medium", "'(none)'")} AS resolved_medium,
    {_tier("event_tuple.campaign", "NULL", "first_user_tuple.campaign", "NULL")} AS resolved_campaign,
    {_tier("event_tuple.source_host", "external_referrer.source_host", "first_user_tuple.source_host", "NULL")} AS resolved_source_host,
    {_tier("event_tuple.source_domain", "external_referrer.source_domain", "first_user_tuple.source_domain", "NULL")} AS resolved_source_domain,
    source_resolution_tier = 'external_referrer' AND external_referrer.source_host = '{s.inferred_search_host}' AS is_inferred_source
  FROM (SELECT *, CASE WHEN event_tuple IS NOT NULL THEN 'event_level_source' {early} WHEN external_referrer IS NOT NULL THEN 'external_referrer'
      WHEN first_user_tuple IS NOT NULL THEN 'first_user_fallback' WHEN direct_evidence_ts IS NOT NULL THEN 'Direct' ELSE 'Unknown' END AS source_resolution_tier FROM x_evidence))"""


def _paths(strict: bool) -> str:
    keep = "is_standard" if strict else "(is_standard OR is_own)"
    return f"""
SELECT *, session_start_ts AS touchpoint_ts, row_number() OVER (PARTITION BY order_key ORDER BY session_start_ts, session_key) AS touchpoint_number,
  count(*) OVER (PARTITION BY order_key) AS path_length, date_sub('second', session_start_ts, order_ts) AS seconds_before_conversion,
  CASE WHEN is_standard THEN 'STANDARD_CONVERSION_CYCLE' ELSE 'CURRENT_CONVERSION_SESSION_EXCEPTION' END AS touchpoint_eligibility_rule,
  NOT is_standard AND is_own AS is_same_session_multi_order_exception
FROM x_candidates WHERE {keep} AND {_ELIGIBLE}"""


def _journeys(seconds: int) -> str:
    return f"""
SELECT user_pseudo_id, journey_number, min(session_start_ts) AS journey_start_ts, max(session_end_ts) AS last_activity_ts,
  max(session_end_ts) + INTERVAL '{seconds} seconds' AS inactivity_expiry_ts, list(channel ORDER BY session_start_ts, session_key) AS channel_path,
  list(session_key ORDER BY session_start_ts, session_key) AS session_key_path, count(*) AS session_count,
  (SELECT min(o.order_ts) FROM x_orders o WHERE o.user_pseudo_id = a.user_pseudo_id AND o.order_ts >= min(a.session_start_ts)) AS next_purchase_ts
FROM (SELECT *, CAST(sum(CASE WHEN prev_start IS NULL OR session_start_ts >= prev_end + INTERVAL '{seconds} seconds' OR last_order >= prev_start THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_pseudo_id ORDER BY session_start_ts, session_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS journey_number FROM x_sequence) a
GROUP BY user_pseudo_id, journey_number"""


def _open(source: str, seconds: int) -> str:
    ended = f"((next_purchase_ts IS NULL OR next_purchase_ts > inactivity_expiry_ts) AND inactivity_expiry_ts < {END})"
    return f"""
SELECT 'SESSION_JOURNEY:' || sha256(CAST(to_json(struct_pack(user_pseudo_id := user_pseudo_id, journey_number := journey_number)) AS VARCHAR)) AS journey_id, *,
  CASE WHEN {ended} THEN 'Null' ELSE 'Right Censored' END AS journey_status, CASE WHEN {ended} THEN 'Null' END AS outcome_state, {ended} AS is_markov_included,
  journey_start_ts < {BEGIN} + INTERVAL '{seconds} seconds' AS is_left_boundary_truncated
FROM {source} WHERE {ended} OR (inactivity_expiry_ts >= {END} AND (next_purchase_ts IS NULL OR next_purchase_ts >= {END}))"""


def _draw(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"CAST('0x' || substr(md5('{BOOTSTRAP_SEED}|' || {text}), 1, {HASH_DIGITS}) AS BIGINT)"


def _probabilities(edges: str) -> str:
    return f"SELECT *, n / CAST(sum(n) OVER (PARTITION BY scenario, src) AS DOUBLE) AS p FROM {edges} WHERE n > 0"


def _chance(prob: str) -> str:
    """(I - Q) x = r by iteration: x is the chance to convert within i steps, for the whole chain ('') and without each channel.

    A state without a way to convert falls out; its chance is 0.
    """
    return f"""
WITH RECURSIVE t AS (SELECT 0 AS i, c.scenario, c.removed, v.state, 0.0::DOUBLE AS x FROM (SELECT DISTINCT scenario, src AS removed FROM {prob} WHERE src <> 'Start' UNION SELECT DISTINCT scenario, '' FROM {prob}) c JOIN (SELECT DISTINCT scenario, src AS state FROM {prob}) v USING (scenario)
  UNION ALL
  SELECT t.i + 1, t.scenario, t.removed, e.src, sum(CASE WHEN e.dst = 'Conversion' THEN e.p WHEN e.dst = t.state THEN e.p * t.x ELSE 0.0 END)
  FROM t JOIN {prob} e ON e.scenario = t.scenario AND (e.dst = t.state OR (e.dst = 'Conversion' AND t.state = 'Start')) WHERE t.i < 120 AND e.src <> t.removed AND e.dst <> t.removed GROUP BY ALL)
SELECT scenario, removed, x FROM t WHERE i = 120 AND state = 'Start'"""


def _struct(row: tuple) -> str:
    names = "scenario label changed_assumption lookback_days inactivity_seconds repeated_channel_treatment direct_treatment bootstrap_replicates bootstrap_seed"
    return "{" + ", ".join(f"'{n}': '{v}'" if isinstance(v, str) else f"'{n}': CAST({v} AS BIGINT)" for n, v in zip(names.split(), row, strict=True)) + "}"


_days = sorted(s.scenario_days)
_LOOKBACK = f"""
WITH e AS (SELECT d AS lookback_days, r.* FROM x_revised r, (SELECT unnest({list(_days)}) AS d) WHERE seconds_before_conversion <= d * 86400),
k AS (SELECT order_key FROM e GROUP BY order_key HAVING count(DISTINCT lookback_days) = {len(_days)}),
v AS (SELECT *, CASE WHEN lookback_days = {_days[-1]} THEN 'baseline' ELSE 'population_impact' END AS cohort_view FROM e UNION ALL SELECT *, 'common_cohort' FROM e WHERE order_key IN (SELECT order_key FROM k)),
n AS (SELECT * EXCLUDE (touchpoint_number, path_length), row_number() OVER (PARTITION BY lookback_days, cohort_view, order_key ORDER BY touchpoint_number, session_key) AS tn,
  count(*) OVER (PARTITION BY lookback_days, cohort_view, order_key) AS pl FROM v),
p AS (SELECT *, max(CASE WHEN channel <> 'Direct' THEN tn END) OVER o AS lnd, pow(0.5, seconds_before_conversion / 604800.0::DOUBLE) AS dw FROM n WINDOW o AS (PARTITION BY lookback_days, cohort_view, order_key)),
q AS (SELECT *, dw / sum(dw) OVER (PARTITION BY lookback_days, cohort_view, order_key) AS td FROM p),
m AS (SELECT lookback_days, cohort_view, channel, order_revenue_usd, unnest([{{'m': 'First Click', 'w': CASE WHEN tn = 1 THEN 1.0::DOUBLE ELSE 0 END}}, {{'m': 'Last Click', 'w': CASE WHEN tn = pl THEN 1.0::DOUBLE ELSE 0 END}},
  {{'m': 'Last Non-direct Click', 'w': CASE WHEN tn = coalesce(lnd, pl) THEN 1.0::DOUBLE ELSE 0 END}}, {{'m': 'Linear', 'w': 1.0::DOUBLE / pl}}, {{'m': 'Time Decay', 'w': td}}]) AS x FROM q),
a AS (SELECT lookback_days, cohort_view, x.m AS model, channel, sum(x.w) AS attributed_conversions, sum(order_revenue_usd * x.w) AS attributed_revenue FROM m WHERE x.w > 0 GROUP BY ALL),
op AS (SELECT lookback_days, cohort_view, order_key, any_value(order_revenue_usd) AS rev, any_value(pl) AS pl FROM n GROUP BY ALL),
ps AS (SELECT lookback_days, cohort_view, count(*) AS attributable_order_count, round(sum(rev), 2) AS attributable_revenue, avg(pl) AS average_path_length, median(pl) AS median_path_length,
  count(*) FILTER (pl > 1) / CAST(count(*) AS DOUBLE) AS multi_touch_share FROM op GROUP BY ALL),
ct AS (SELECT lookback_days, cohort_view, channel, count(*) AS channel_touchpoint_count FROM n GROUP BY ALL),
cs AS (SELECT *, channel_touchpoint_count / CAST(sum(channel_touchpoint_count) OVER (PARTITION BY lookback_days, cohort_view) AS DOUBLE) AS channel_touchpoint_share FROM ct)
SELECT *, attributed_conversions / attributable_order_count AS conversion_share, attributed_revenue / attributable_revenue AS revenue_share FROM a JOIN ps USING (lookback_days, cohort_view) JOIN cs USING (lookback_days, cohort_view, channel)"""

CTES: dict[str, str] = {
    "x_raw0": f"""
SELECT event_id, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
FROM (SELECT *, CASE WHEN date_sub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > {SESSION_GAP_SECONDS} THEN 1 ELSE 0 END AS gap FROM events)""",
    "x_raw1": f"""
SELECT event_id, ts AS event_ts, strftime(ts, '%Y%m%d') AS shard, CASE WHEN user_id % 4 = 0 THEN 'login-' || user_id END AS user_id, session + 1 AS ga_session_number,
  CASE WHEN event_id % 61 = 0 THEN 2 ELSE 1 END AS session_parameters,
  CASE event_type WHEN 'view' THEN 'view_item' WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'begin_checkout' WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'page_view' END AS event_name,
  'u' || user_id AS user_pseudo_id, CASE WHEN event_id % 67 <> 0 THEN session END AS ga_session_id, {text(_evidence(1))} AS event_source, {text(_evidence(2))} AS event_medium, CAST(NULL AS VARCHAR) AS event_campaign,
  'https://shop.store.example/p/' || k AS page_location,
  CASE WHEN k BETWEEN 81 AND 84 THEN 'https://www.google.com/search?q=a' WHEN k BETWEEN 85 AND 88 THEN 'https://blog.example.org/post' END AS page_referrer,
  CASE user_id % 5 WHEN 0 THEN 'google' WHEN 1 THEN '(direct)' END AS first_user_source, CASE user_id % 5 WHEN 0 THEN 'organic' WHEN 1 THEN '(none)' END AS first_user_medium,
  CAST(NULL AS VARCHAR) AS first_user_campaign,
  CASE user_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device_category, CASE WHEN user_id % 3 = 0 THEN 'Web' WHEN user_id % 7 <> 0 THEN 'Android' END AS operating_system,
  CASE WHEN user_id % 2 = 0 THEN 'Chrome' ELSE 'Safari' END AS browser, CASE WHEN user_id % 11 <> 0 THEN 'country-' || user_id % 4 END AS country, 'region-' || user_id % 8 AS region,
  CASE WHEN user_id % 13 = 0 THEN '(not set)' ELSE 'city-' || user_id % 16 END AS city,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 97 = 0 THEN '(not set)' WHEN event_id % 89 <> 0 THEN 't' || event_id END END AS transaction_id,
  CASE WHEN event_type = 'purchase' THEN value END AS purchase_revenue_in_usd
FROM x_raw0""",
    "x_raw": "SELECT * FROM x_raw1 UNION ALL SELECT * REPLACE (event_ts + INTERVAL 1 SECOND AS event_ts) FROM x_raw1 WHERE event_name = 'purchase' AND event_id % 50 = 0",
    "x_base": f"""
SELECT *, CAST(event_ts AS DATE) AS event_date, epoch_us(event_ts) AS event_timestamp,
  CASE WHEN ga_session_id IS NOT NULL THEN sha256(CAST(to_json(struct_pack(user_pseudo_id := user_pseudo_id, ga_session_id := ga_session_id)) AS VARCHAR)) END AS session_key,
  {domain("page_location_host")} AS page_location_domain, {domain("page_referrer_host")} AS page_referrer_domain
FROM (SELECT *, {host("page_location")} AS page_location_host, {host("page_referrer")} AS page_referrer_host FROM x_raw)""",
    "x_orders": """
SELECT user_pseudo_id, transaction_id, min(event_ts) AS order_ts, CAST(min(event_ts) AS DATE) AS order_date, (min(struct_pack(t := event_ts, k := session_key)) FILTER (session_key IS NOT NULL)).k AS conversion_session_key,
  max(purchase_revenue_in_usd) AS order_revenue_usd, count(*) AS purchase_event_count, count(*) - 1 AS duplicate_purchase_event_count,
  count(DISTINCT purchase_revenue_in_usd) AS distinct_revenue_value_count, min(purchase_revenue_in_usd) AS minimum_observed_revenue_usd, max(purchase_revenue_in_usd) AS maximum_observed_revenue_usd,
  sha256(CAST(to_json(struct_pack(user_pseudo_id := user_pseudo_id, transaction_id := transaction_id)) AS VARCHAR)) AS order_key
FROM x_base WHERE event_name = 'purchase' AND trim(transaction_id) <> '' AND lower(trim(transaction_id)) <> '(not set)' GROUP BY user_pseudo_id, transaction_id""",
    "x_cycles": """
SELECT *, lag(order_ts) OVER (PARTITION BY user_pseudo_id ORDER BY order_ts, order_key) AS previous_order_ts, count(*) OVER (PARTITION BY user_pseudo_id, order_ts) AS same_timestamp_order_count,
  row_number() OVER (PARTITION BY user_pseudo_id, order_ts ORDER BY order_key) AS same_timestamp_order_sequence FROM x_orders""",
    "x_clean": f"""
SELECT *, {_source_host("event_source")} AS event_source_host, {_source_domain("event_source")} AS event_source_domain, {_source_host("first_user_source")} AS first_user_source_host, {_source_domain("first_user_source")} AS first_user_source_domain
FROM (SELECT * REPLACE ({", ".join(f"{_placeholder(c)} AS {c}" for c in ("event_source", "event_medium", "event_campaign", "first_user_source", "first_user_medium", "first_user_campaign"))}) FROM x_base)""",
    "x_evidence": f"""
SELECT user_pseudo_id, ga_session_id, session_key, min(event_ts) AS session_start_ts, max(event_ts) AS session_end_ts, count(*) AS event_count, count(*) FILTER (event_name = 'purchase') AS purchase_event_count,
  count(*) FILTER (coalesce(event_source, event_medium, event_campaign) IS NOT NULL) AS raw_event_tuple_event_count,
  min({_tuple("event", True)}) FILTER (coalesce(event_source, event_medium, event_campaign) IS NOT NULL AND NOT {_direct("event")} AND coalesce(event_source_domain, '') <> '{s.storefront}') AS event_tuple,
  min(struct_pack(ts := event_ts, source_host := page_referrer_host, k := coalesce(page_referrer, ''), referrer := page_referrer, source_domain := page_referrer_domain))
    FILTER (page_referrer_host IS NOT NULL AND coalesce(page_referrer_domain, '') <> '{s.storefront}') AS external_referrer,
  min({_tuple("first_user", False)}) FILTER (coalesce(first_user_source, first_user_medium, first_user_campaign) IS NOT NULL AND NOT {_direct("first_user")} AND coalesce(first_user_source_domain, '') <> '{s.storefront}') AS first_user_tuple,
  min(event_ts) FILTER ({_direct("event")} OR {_direct("first_user")}) AS direct_evidence_ts,
  bool_or(event_source_domain = '{s.storefront}') AS has_internal_event_source, bool_or(page_referrer_domain = '{s.storefront}') AS has_internal_page_referrer, bool_or(first_user_source_domain = '{s.storefront}') AS has_internal_first_user_source
FROM x_clean WHERE session_key IS NOT NULL GROUP BY user_pseudo_id, ga_session_id, session_key""",
    "x_sources": _resolution(False),
    "x_provisional": _resolution(True),
    "x_sessions": f"""
SELECT *, {_channel(*_resolved, 1)} AS channel, {_channel(*_resolved, 0)} AS mapping_rule_priority, {_channel(*_resolved, 2)} AS mapping_rule_name
FROM (SELECT *, coalesce(resolved_source_host, '') IN ({_quoted(s.admin_hosts)}) AS is_internal_admin_traffic, coalesce(resolved_source_host, '') NOT IN ({_quoted(s.admin_hosts)}) AS is_attribution_eligible FROM x_sources)""",
    "x_candidates": f"""
SELECT o.*, t.* EXCLUDE (user_pseudo_id), o.previous_order_ts IS NULL OR t.session_start_ts > o.previous_order_ts AS is_standard, coalesce(t.session_key = o.conversion_session_key, FALSE) AS is_own
FROM x_cycles o JOIN x_sessions t ON o.user_pseudo_id = t.user_pseudo_id AND t.session_start_ts <= o.order_ts AND t.session_start_ts >= o.order_ts - INTERVAL '{s.lookback_days} days'""",
    "x_strict": _paths(True),
    "x_revised": _paths(False),
    "x_coverage": f"""
WITH j AS (SELECT o.order_key, o.previous_order_ts, o.conversion_session_key, t.*, t.session_start_ts <= o.order_ts AS b, t.session_start_ts <= o.order_ts AND t.session_start_ts >= o.order_ts - INTERVAL '{s.lookback_days} days' AS r,
    o.previous_order_ts IS NULL OR t.session_start_ts > o.previous_order_ts AS st, t.session_key = o.conversion_session_key AS own, {_ELIGIBLE} AS good
  FROM x_cycles o LEFT JOIN x_sessions t USING (user_pseudo_id)),
c AS (SELECT order_key, count(session_key) AS all_user_session_count, count(*) FILTER (b) AS session_on_or_before_order_count, count(*) FILTER (r) AS session_within_lookback_count,
    count(*) FILTER (r AND st) AS strict_pre_internal_exclusion_session_count, count(*) FILTER (r AND st AND coalesce(resolved_source_host, '') <> '{s.admin_hosts[0]}') AS historical_baseline_touchpoint_count,
    count(*) FILTER (r AND st AND is_internal_admin_traffic) AS strict_internal_admin_session_count, count(*) FILTER (r AND st AND good) AS strict_attribution_eligible_session_count,
    count(*) FILTER (r AND (st OR own)) AS revised_pre_internal_exclusion_session_count, count(*) FILTER (r AND (st OR own) AND is_internal_admin_traffic) AS revised_internal_admin_session_count,
    count(*) FILTER (r AND (st OR own) AND good) AS revised_attribution_eligible_session_count,
    count(*) FILTER (r AND own AND session_start_ts <= previous_order_ts) AS current_conversion_session_exception_candidate_count FROM j GROUP BY order_key),
n AS (SELECT order_key, count(*) AS n FROM x_strict GROUP BY order_key), k AS (SELECT order_key, count(*) AS k FROM x_revised GROUP BY order_key)
SELECT o.*, c.* EXCLUDE (order_key), coalesce(n, 0) AS strict_conversion_touchpoint_count, coalesce(k, 0) AS conversion_touchpoint_count, coalesce(n, 0) > 0 AS path_covered_strict,
  historical_baseline_touchpoint_count > 0 AS path_covered_historical_baseline, coalesce(k, 0) > 0 AS path_covered_revised, coalesce(n, 0) = 0 AND coalesce(k, 0) > 0 AS recovered_by_current_conversion_session_exception,
  historical_baseline_touchpoint_count = 0 AND coalesce(k, 0) > 0 AS historical_unmatched_recovered_by_exception, historical_baseline_touchpoint_count > 0 AND coalesce(k, 0) = 0 AS historical_covered_order_lost_after_closeout,
  revised_pre_internal_exclusion_session_count > 0 AND coalesce(k, 0) = 0 AS coverage_lost_after_internal_exclusion
FROM x_cycles o JOIN c USING (order_key) LEFT JOIN n USING (order_key) LEFT JOIN k USING (order_key)""",
    "x_weights": f"""
WITH p AS (SELECT *, max(CASE WHEN channel <> 'Direct' THEN touchpoint_number END) OVER (PARTITION BY order_key) AS lnd, pow(0.5, CAST(seconds_before_conversion AS DOUBLE) / {s.half_life_seconds}.0) AS d FROM x_revised),
q AS (SELECT *, d / sum(d) OVER (PARTITION BY order_key) AS dw FROM p)
SELECT *, 'First Click' AS model, CASE WHEN touchpoint_number = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS w FROM q UNION ALL
SELECT *, 'Last Click', CASE WHEN touchpoint_number = path_length THEN 1.0::DOUBLE ELSE 0.0 END FROM q UNION ALL
SELECT *, 'Last Non-direct Click', CASE WHEN touchpoint_number = coalesce(lnd, path_length) THEN 1.0::DOUBLE ELSE 0.0 END FROM q UNION ALL
SELECT *, 'Linear', 1.0::DOUBLE / path_length FROM q UNION ALL
SELECT *, 'Time Decay', dw FROM q""",
    "x_results": "SELECT order_key, user_pseudo_id, order_ts, order_revenue_usd, model, channel, sum(w) AS attributed_conversion, sum(order_revenue_usd * w) AS attributed_revenue FROM x_weights WHERE w > 0 GROUP BY ALL",
    "x_sequence": f"""
SELECT user_pseudo_id, session_key, session_start_ts, session_end_ts, channel, lag(session_start_ts) OVER w AS prev_start, lag(session_end_ts) OVER w AS prev_end,
  (SELECT max(o.order_ts) FROM x_orders o WHERE o.user_pseudo_id = t.user_pseudo_id AND o.order_ts < t.session_start_ts) AS last_order
FROM x_sessions t WHERE {_ELIGIBLE} WINDOW w AS (PARTITION BY user_pseudo_id ORDER BY session_start_ts, session_key)""",
    "x_segments": _journeys(s.inactivity_seconds),
    "x_short_segments": _journeys(s.short_inactivity_seconds),
    "x_open": _open("x_segments", s.inactivity_seconds),
    "x_journeys": f"""
SELECT 'CONVERSION:' || order_key AS journey_id, any_value(user_pseudo_id) AS user_pseudo_id, order_key, any_value(order_revenue_usd) AS attributable_revenue_usd, min(touchpoint_ts) AS journey_start_ts, max(touchpoint_ts) AS last_activity_ts,
  CAST(NULL AS TIMESTAMP) AS inactivity_expiry_ts, any_value(order_ts) AS next_purchase_ts, list(channel ORDER BY touchpoint_number) AS channel_path, list(session_key ORDER BY touchpoint_number) AS session_key_path,
  count(*) AS session_count, 'Conversion' AS journey_status, 'Conversion' AS outcome_state, TRUE AS is_markov_included, min(touchpoint_ts) < {BEGIN} + INTERVAL '{s.inactivity_seconds} seconds' AS is_left_boundary_truncated
FROM x_revised GROUP BY order_key UNION ALL
SELECT journey_id, user_pseudo_id, NULL, NULL, journey_start_ts, last_activity_ts, inactivity_expiry_ts, next_purchase_ts, channel_path, session_key_path, session_count, journey_status, outcome_state, is_markov_included, is_left_boundary_truncated FROM x_open""",
    "x_short": f"""
WITH o AS ({_open("x_short_segments", s.short_inactivity_seconds)}),
u AS (SELECT journey_id, count(DISTINCT k) AS n FROM (SELECT journey_id, unnest(session_key_path) AS k FROM o WHERE journey_status = 'Null') WHERE k IN (SELECT session_key FROM x_revised) GROUP BY journey_id)
SELECT o.* EXCLUDE (is_markov_included), coalesce(n, 0) AS overlapping_session_count, journey_status = 'Null' AND coalesce(n, 0) > 0 AS is_overlap_excluded, journey_status = 'Null' AND coalesce(n, 0) = 0 AS is_markov_included FROM o LEFT JOIN u USING (journey_id)""",
    "x_paths": """
SELECT 'baseline' AS scenario, user_pseudo_id, ['Start'] || channel_path || [outcome_state] AS path, channel_path, outcome_state, attributable_revenue_usd AS revenue FROM x_journeys WHERE is_markov_included""",
    "x_scenario_paths": "\n".join(
        [
            "SELECT scenario, user_pseudo_id, path, revenue FROM x_paths UNION ALL",
            "SELECT 'compressed', user_pseudo_id, ['Start'] || list_transform(list_filter(list_zip(channel_path, [NULL] || channel_path[:-2]), lambda x: x[1] IS DISTINCT FROM x[2]), lambda x: x[1]) || [outcome_state], revenue FROM x_paths UNION ALL",
            "SELECT 'omit_direct', user_pseudo_id, ['Start'] || CASE WHEN len(list_filter(channel_path, lambda x: x <> 'Direct')) > 0 THEN list_filter(channel_path, lambda x: x <> 'Direct') ELSE channel_path END || [outcome_state], revenue FROM x_paths UNION ALL",
            "SELECT 'short_inactivity', user_pseudo_id, path, revenue FROM x_paths WHERE outcome_state = 'Conversion' UNION ALL",
            "SELECT 'short_inactivity', user_pseudo_id, ['Start'] || channel_path || ['Null'], NULL FROM x_short WHERE is_markov_included",
            *[
                f"""UNION ALL SELECT 'lookback_{d}d', any_value(user_pseudo_id), ['Start'] || list(channel ORDER BY touchpoint_number) || ['Conversion'], any_value(order_revenue_usd)
                FROM x_revised WHERE seconds_before_conversion <= {d * 86400} GROUP BY order_key
                UNION ALL SELECT 'lookback_{d}d', user_pseudo_id, path, NULL FROM x_paths WHERE outcome_state = 'Null'"""
                for d in sorted(s.scenario_days)[:-1]
            ],
        ]
    ),
    "x_edges": "SELECT scenario, path[i] AS src, path[i + 1] AS dst, count(*) AS n FROM (SELECT scenario, path, unnest(range(1, len(path))) AS i FROM x_scenario_paths) GROUP BY ALL",
    "x_prob": _probabilities("x_edges"),
    "x_chance": _chance("x_prob"),
    "x_effects": """
SELECT *, removal_effect / sum(removal_effect) OVER (PARTITION BY scenario) AS attribution_share
FROM (SELECT b.scenario, r.removed AS channel, b.x AS base_probability, r.x AS probability_without, greatest(1 - r.x / b.x, 0) AS removal_effect FROM x_chance b JOIN x_chance r ON b.scenario = r.scenario AND b.removed = '' AND r.removed <> '')""",
    "x_ranked": "SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY round(attribution_share, 9) DESC, channel) AS channel_rank FROM x_effects",
    "x_markov": "SELECT channel, c * attribution_share AS attributed_conversions, r * attribution_share AS attributed_revenue FROM x_effects, (SELECT count(*) AS c, sum(attributable_revenue_usd) AS r FROM x_journeys WHERE outcome_state = 'Conversion') WHERE scenario = 'baseline'",
    "x_comparison": """
WITH t AS (SELECT channel, model, sum(attributed_conversion) AS c, sum(attributed_revenue) AS r FROM x_results GROUP BY ALL UNION ALL SELECT channel, 'Markov', attributed_conversions, attributed_revenue FROM x_markov),
g AS (SELECT channel, model, coalesce(c, 0) AS attributed_conversions, coalesce(r, 0) AS attributed_revenue FROM (SELECT DISTINCT channel FROM t) CROSS JOIN (SELECT unnest(['First Click', 'Last Click', 'Last Non-direct Click', 'Linear', 'Time Decay', 'Markov']) AS model) LEFT JOIN t USING (channel, model)),
m AS (SELECT *, attributed_conversions / sum(attributed_conversions) OVER (PARTITION BY model) AS attribution_share, dense_rank() OVER (PARTITION BY model ORDER BY round(attributed_conversions, 6) DESC, channel) AS channel_rank FROM g)
SELECT m.*, m.attributed_conversions - b.attributed_conversions AS conversions_difference_vs_last_click, (m.attributed_conversions - b.attributed_conversions) / nullif(b.attributed_conversions, 0) AS conversions_relative_difference_vs_last_click,
  m.attributed_revenue - b.attributed_revenue AS revenue_difference_vs_last_click, (m.attributed_revenue - b.attributed_revenue) / nullif(b.attributed_revenue, 0) AS revenue_relative_difference_vs_last_click
FROM m JOIN m b ON m.channel = b.channel AND b.model = 'Last Click'""",
    # The bootstrap: as many draws as users, first to a block of users, then to a user of the block.
    "x_user_edges": "SELECT user_pseudo_id, path[i] AS src, path[i + 1] AS dst, count(*) AS n FROM (SELECT user_pseudo_id, path, unnest(range(1, len(path))) AS i FROM x_paths) GROUP BY ALL",
    "x_boot_users": "SELECT user_pseudo_id, row_number() OVER (ORDER BY md5(user_pseudo_id), user_pseudo_id) - 1 AS place FROM (SELECT DISTINCT user_pseudo_id FROM x_user_edges)",
    "x_boot_times": f"""
WITH n AS (SELECT count(*) AS n FROM x_boot_users),
d AS (SELECT scenario, {_draw("scenario", "draw")} % n // {BLOCK_USERS} AS block FROM (SELECT unnest(range(n)) AS draw, n FROM n) CROSS JOIN (SELECT unnest(range({BOOTSTRAP_REPLICATES})) AS scenario)),
c AS (SELECT scenario, block, unnest(range(draws)) AS draw FROM (SELECT scenario, block, count(*) AS draws FROM d GROUP BY ALL)),
z AS (SELECT place // {BLOCK_USERS} AS block, count(*) AS size FROM x_boot_users GROUP BY 1)
SELECT scenario, block * {BLOCK_USERS} + {_draw("scenario", "block", "draw")} % size AS place, count(*) AS weight FROM c JOIN z USING (block) GROUP BY ALL""",
    "x_boot_size": "SELECT scenario, CAST(sum(weight) AS BIGINT) AS sampled_user_draws, count(*) AS unique_users_selected FROM x_boot_times GROUP BY scenario",
    "x_boot_edges": "SELECT scenario, src, dst, CAST(sum(n * weight) AS BIGINT) AS n FROM x_boot_times JOIN x_boot_users USING (place) JOIN x_user_edges USING (user_pseudo_id) GROUP BY ALL",
    "x_boot_prob": _probabilities("x_boot_edges"),
    "x_boot_chance": _chance("x_boot_prob"),
    "x_boot": """
WITH c AS (SELECT scenario, channel FROM x_boot_size CROSS JOIN (SELECT DISTINCT channel FROM x_effects WHERE scenario = 'baseline')),
live AS (SELECT DISTINCT scenario, src AS channel, TRUE AS is_live FROM x_boot_prob),
b AS (SELECT z.*, coalesce(x, 0) AS x, (SELECT count(*) FROM live l WHERE l.scenario = z.scenario) + 2 AS states FROM x_boot_size z LEFT JOIN (SELECT scenario, x FROM x_boot_chance WHERE removed = '') USING (scenario)),
f AS (SELECT c.scenario, c.channel, b.x AS base, b.sampled_user_draws, b.unique_users_selected, b.states, CASE WHEN is_live AND b.x > 1e-12 THEN greatest(1 - coalesce(r.x, 0) / b.x, 0) ELSE 0 END AS effect
  FROM c JOIN b USING (scenario) LEFT JOIN live USING (scenario, channel) LEFT JOIN x_boot_chance r ON r.scenario = c.scenario AND r.removed = c.channel),
g AS (SELECT *, CASE WHEN base <= 1e-12 THEN 'the chain never converts' WHEN sum(effect) OVER s <= 1e-12 THEN 'no effect to share' END AS reason, effect / nullif(sum(effect) OVER s, 0) AS share FROM f WINDOW s AS (PARTITION BY scenario))
SELECT scenario AS replicate, sampled_user_draws, unique_users_selected, channel, effect AS removal_effect, share AS attribution_share,
  row_number() OVER (PARTITION BY scenario ORDER BY round(share, 9) DESC, channel) AS channel_rank, base AS base_probability, states AS active_state_count, reason FROM g WHERE reason IS NULL
UNION ALL SELECT DISTINCT scenario, sampled_user_draws, unique_users_selected, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM g WHERE reason IS NOT NULL""",
    "x_boot_summary": """
SELECT * FROM (SELECT channel, """
    + ", ".join(
        f"avg({v}) AS mean_{n}, quantile_cont({v}, 0.5) AS median_{n}, stddev_samp({v}) AS {n}_stddev, quantile_cont({v}, 0.025) AS {n}_percentile_2_5, quantile_cont({v}, 0.975) AS {n}_percentile_97_5"
        for v, n in (("attribution_share", "share"), ("removal_effect", "removal_effect"))
    )
    + """, avg(channel_rank) AS mean_rank, quantile_cont(channel_rank, 0.5) AS median_rank, min(channel_rank) AS minimum_rank, max(channel_rank) AS maximum_rank, avg(CAST(channel_rank <= 1 AS INT)) AS probability_top_1,
  avg(CAST(channel_rank <= 3 AS INT)) AS probability_top_3, avg(CAST(channel_rank <= 5 AS INT)) AS probability_top_5 FROM x_boot WHERE reason IS NULL GROUP BY channel)
JOIN (SELECT channel, attribution_share AS baseline_share, removal_effect AS baseline_removal_effect, channel_rank AS baseline_rank FROM x_ranked WHERE scenario = 'baseline') USING (channel),
  (SELECT count(DISTINCT replicate) AS attempted_replicates, count(DISTINCT replicate) - count(*) FILTER (reason IS NOT NULL) AS successful_replicates, count(*) FILTER (reason IS NOT NULL) AS failed_replicates FROM x_boot)""",
    # Sensitivity results, ranks against the baseline, and the manifest.
    "x_lookback": _LOOKBACK,
    "x_metrics": """
SELECT scenario, count(*) AS journeys, count(*) FILTER (path[-1] = 'Conversion') AS conversion_journey_count, count(*) FILTER (path[-1] = 'Null') AS null_journey_count, sum(revenue) AS attributable_revenue,
  CAST(sum(len(path) - 2) AS BIGINT) AS touchpoints, avg(len(path) - 2) AS average_path_length, median(len(path) - 2) AS median_path_length, count(*) FILTER (len(path) > 3) / CAST(count(*) AS DOUBLE) AS multi_touch_share
FROM x_scenario_paths GROUP BY scenario""",
    "x_touches": """
SELECT *, channel_touchpoint_count / CAST(sum(channel_touchpoint_count) OVER (PARTITION BY scenario) AS DOUBLE) AS channel_touchpoint_share
FROM (SELECT scenario, channel, count(*) AS channel_touchpoint_count FROM (SELECT scenario, unnest(path[2:-2]) AS channel FROM x_scenario_paths) GROUP BY ALL)""",
    "x_censored": "SELECT (SELECT count(*) FROM x_journeys WHERE journey_status = 'Right Censored') AS censored, (SELECT count(*) FROM x_short WHERE journey_status = 'Right Censored') AS censored_short",
    "x_sens_rows": f"""
SELECT CASE WHEN lookback_days = {max(s.scenario_days)} THEN 'baseline' ELSE 'lookback_' || lookback_days || 'd' END AS scenario, cohort_view, model, channel, attributable_order_count, attributable_revenue,
  attributable_order_count AS conversion_journey_count, 0 AS null_journey_count, 0 AS right_censored_journey_count, average_path_length, median_path_length, multi_touch_share, channel_touchpoint_count, channel_touchpoint_share,
  CAST(NULL AS DOUBLE) AS removal_effect, attributed_conversions, attributed_revenue, conversion_share, revenue_share, CAST(NULL AS DOUBLE) AS baseline_conversion_probability FROM x_lookback
UNION ALL
SELECT scenario, 'completed_outcomes', 'Markov', channel, conversion_journey_count, attributable_revenue, conversion_journey_count, null_journey_count, CASE WHEN scenario = 'short_inactivity' THEN censored_short ELSE censored END,
  average_path_length, median_path_length, multi_touch_share, channel_touchpoint_count, channel_touchpoint_share, removal_effect, conversion_journey_count * attribution_share, attributable_revenue * attribution_share,
  attribution_share, attribution_share, base_probability FROM x_effects JOIN x_metrics USING (scenario) JOIN x_touches USING (scenario, channel), x_censored""",
    "x_sens": """
SELECT *, """
    + ", ".join(
        f"""row_number() OVER (PARTITION BY scenario, cohort_view, model ORDER BY round({n}_share, 9) DESC, channel) AS {n}_rank,
  EXISTS (SELECT 1 FROM x_sens_rows o WHERE o.scenario = r.scenario AND o.cohort_view = r.cohort_view AND o.model = r.model AND o.channel <> r.channel AND abs(o.{n}_share - r.{n}_share) <= 1e-9) AS is_{n}_share_tied"""
        for n in ("conversion", "revenue")
    )
    + " FROM x_sens_rows r",
    "x_stable": """
WITH b AS (SELECT cohort_view AS view, model, channel, conversion_share AS share FROM x_sens_rows WHERE scenario = 'baseline'),
o AS (SELECT scenario, cohort_view, CASE WHEN cohort_view = 'population_impact' THEN 'baseline' ELSE cohort_view END AS view, model, channel, conversion_share AS share FROM x_sens_rows WHERE scenario <> 'baseline'),
p AS (SELECT DISTINCT scenario, cohort_view, view, model FROM o),
g AS (SELECT p.*, c.channel FROM p JOIN (SELECT view, model, channel FROM b UNION SELECT view, model, channel FROM o) c USING (view, model)
      WHERE EXISTS (SELECT 1 FROM b WHERE b.view = p.view AND b.model = p.model AND b.channel = c.channel) OR EXISTS (SELECT 1 FROM o WHERE o.scenario = p.scenario AND o.cohort_view = p.cohort_view AND o.model = p.model AND o.channel = c.channel)),
v AS (SELECT g.*, b.share AS b, o.share AS s FROM g LEFT JOIN b ON b.view = g.view AND b.model = g.model AND b.channel = g.channel LEFT JOIN o ON o.scenario = g.scenario AND o.cohort_view = g.cohort_view AND o.model = g.model AND o.channel = g.channel),
r AS (SELECT scenario, cohort_view, model, channel, coalesce(b, 0) AS baseline_share, coalesce(s, 0) AS scenario_share, row_number() OVER (PARTITION BY scenario, cohort_view, model ORDER BY b IS NULL, round(b, 9) DESC, channel) AS baseline_rank,
      row_number() OVER (PARTITION BY scenario, cohort_view, model ORDER BY s IS NULL, round(s, 9) DESC, channel) AS scenario_rank FROM v)
SELECT *, abs(scenario_rank - baseline_rank) AS absolute_rank_shift, abs(scenario_share - baseline_share) * 100 AS absolute_percentage_point_change, (scenario_share - baseline_share) / nullif(baseline_share, 0) AS relative_share_change,
  CASE WHEN count(*) OVER w < 2 THEN 1.0 ELSE 1.0 - 6.0 * sum((scenario_rank - baseline_rank) * (scenario_rank - baseline_rank)) OVER w / CAST(count(*) OVER w * (count(*) OVER w * count(*) OVER w - 1) AS DOUBLE) END AS spearman_rank_correlation,
  sum(CASE WHEN scenario_rank <= 3 AND baseline_rank <= 3 THEN 1 ELSE 0 END) OVER w AS top_3_overlap, max(abs(scenario_rank - baseline_rank)) OVER w AS maximum_absolute_rank_shift,
  EXISTS (SELECT 1 FROM r q WHERE q.scenario = r.scenario AND q.cohort_view = r.cohort_view AND q.model = r.model AND q.channel <> r.channel AND abs(q.baseline_share - r.baseline_share) <= 1e-9) AS baseline_is_tied,
  EXISTS (SELECT 1 FROM r q WHERE q.scenario = r.scenario AND q.cohort_view = r.cohort_view AND q.model = r.model AND q.channel <> r.channel AND abs(q.scenario_share - r.scenario_share) <= 1e-9) AS scenario_is_tied
FROM r WINDOW w AS (PARTITION BY scenario, cohort_view, model)""",
    "x_manifest": f"""
SELECT a.*, m.conversion_journey_count, m.null_journey_count, CASE WHEN a.scenario = 'short_inactivity' THEN censored_short ELSE censored END AS right_censored_journey_count, 0 AS right_censored_in_model_count,
  a.scenario = 'baseline' AS is_baseline, CASE WHEN a.scenario = 'baseline' THEN 0 ELSE 1 END AS changed_assumption_count,
  (SELECT count(*) FROM x_edges e WHERE e.scenario = m.scenario AND 'Internal/Admin' IN (src, dst)) AS internal_admin_state_count,
  (SELECT count(*) FROM (SELECT src FROM x_prob e WHERE e.scenario = m.scenario GROUP BY src HAVING abs(sum(p) - 1) > 1e-12)) AS invalid_transition_row_count,
  (SELECT count(*) FROM x_edges e WHERE e.scenario = m.scenario AND src IN ('Conversion', 'Null')) AS invalid_absorbing_state_count,
  (SELECT count(*) FROM x_effects e WHERE e.scenario = m.scenario AND removal_effect < -1e-12) AS materially_negative_effect_count,
  'share_desc_channel_name_asc' AS rank_tie_break_rule,
  (SELECT sha256(string_agg(channel || ':' || CAST(round(attribution_share * 1000000) AS BIGINT), '|' ORDER BY channel || ':' || CAST(round(attribution_share * 1000000) AS BIGINT))) FROM x_effects WHERE scenario = 'baseline') AS baseline_fingerprint
FROM (SELECT unnest([{", ".join(_struct(r) for r in scenario_assumptions(s))}], recursive := true)) a
JOIN x_metrics m ON m.scenario = CASE WHEN a.scenario = 'bootstrap' THEN 'baseline' ELSE a.scenario END, x_censored""",
    "x_order_paths": "SELECT order_key, any_value(order_revenue_usd) AS revenue, any_value(path_length) AS path_length, arg_min(channel, touchpoint_number) AS first_touch, arg_max(channel, touchpoint_number) AS last_touch, string_agg(channel, ' > ' ORDER BY touchpoint_number) AS converting_path FROM x_revised GROUP BY order_key",
    "x_summary": """
WITH t AS (SELECT *, unnest([{'t': 'OVERALL', 'k': 'all_attributable_conversions'}, {'t': 'PATH_LENGTH', 'k': CAST(path_length AS VARCHAR)}, {'t': 'CONVERTING_PATH', 'k': converting_path}, {'t': 'FIRST_TOUCH_CHANNEL', 'k': first_touch}, {'t': 'LAST_TOUCH_CHANNEL', 'k': last_touch}]) AS m FROM x_order_paths),
g AS (SELECT m.t AS summary_type, m.k AS dimension_key, count(*) AS c, sum(revenue) AS r, avg(path_length) AS mean, count(*) FILTER (path_length = 1) AS single, max(path_length) AS l FROM t GROUP BY ALL),
a AS (SELECT count(*) AS ac, sum(revenue) AS ar, median(path_length) AS med FROM x_order_paths)
SELECT summary_type, dimension_key, CASE summary_type WHEN 'OVERALL' THEN 'All attributable conversions' WHEN 'PATH_LENGTH' THEN dimension_key || ' touchpoint(s)' ELSE dimension_key END AS dimension_label,
  CASE WHEN summary_type = 'PATH_LENGTH' THEN l ELSE row_number() OVER (PARTITION BY summary_type ORDER BY c DESC, r DESC, dimension_key) END AS sort_order, c AS attributable_conversions, r AS attributable_revenue,
  c / CAST(ac AS DOUBLE) AS conversion_share, r / ar AS revenue_share, CASE WHEN summary_type IN ('OVERALL', 'PATH_LENGTH') THEN mean END AS mean_path_length, CASE summary_type WHEN 'OVERALL' THEN med WHEN 'PATH_LENGTH' THEN l END AS median_path_length,
  CASE WHEN summary_type = 'OVERALL' THEN single END AS single_touch_conversions, CASE WHEN summary_type = 'OVERALL' THEN c - single END AS multi_touch_conversions FROM g, a""",
    "x_reuse": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY order_ts, order_key) AS turn FROM x_revised)
SELECT session_key, any_value(user_pseudo_id) AS user_pseudo_id, count(DISTINCT order_key) AS revised_orders, count(*) FILTER (NOT is_same_session_multi_order_exception) AS standard_assignments, count(*) FILTER (is_same_session_multi_order_exception) AS exception_assignments,
  count(*) FILTER (turn > 1 AND NOT is_same_session_multi_order_exception) AS unapproved_assignments, count(*) FILTER (is_same_session_multi_order_exception AND session_key <> conversion_session_key) AS mismatched_exceptions,
  min(order_ts) AS first_order_ts, max(order_ts) AS last_order_ts, list(order_key ORDER BY order_ts, order_key) AS order_keys, (SELECT count(DISTINCT s.order_key) FROM x_strict s WHERE s.session_key = r.session_key) AS strict_orders FROM r GROUP BY session_key HAVING count(DISTINCT order_key) > 1""",
}


def sql(select: str) -> str:
    """``select`` behind the tables that it needs, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\bx_\w+", text)) & CTES.keys() - needed:
            needed.add(name)
            visit(CTES[name])

    visit(select)
    tables = [f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in CTES if n in needed]
    return ("WITH " + ",\n".join(tables) + "\n" if tables else "") + select
