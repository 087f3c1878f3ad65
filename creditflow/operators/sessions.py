"""Where a session came from, and its channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditflow.functions.columns import placeholder_null, source_domain, source_host
from creditflow.settings import Settings

# Registered domains of social networks.
SOCIAL_DOMAINS = ("facebook.com", "instagram.com", "twitter.com", "t.co", "linkedin.com", "tiktok.com", "youtube.com")
# Patterns of media, by channel.
PAID_SOCIAL_MEDIUM = r"^(paid[_ -]?social|social[_ -]?paid)$"
PAID_MEDIUM = r"^(cpc|ppc|paidsearch|paid search|sem)$"
DISPLAY_MEDIUM = r"^(display|banner|cpm|programmatic)$"
EMAIL_MEDIUM = r"^(email|e-mail|e_mail)$"
AFFILIATE_MEDIUM = r"^affiliate(s)?$"
ORGANIC_MEDIUM = r"^organic$"
SOCIAL_MEDIUM = r"^(social|social-network|social-media|sm)$"
SOCIAL_DOMAIN_PATTERN = r"^pinterest\.[a-z.]+$"
NOT_SOCIAL_HOST = "creatoracademy.youtube.com"
#: Priority, channel and rule, in the order in which rules are tried.
CHANNEL_RULES = (
    (0, "Internal/Admin", "internal_admin_exact_host"),
    (1, "Direct", "direct_explicit"),
    (2, "Paid Social", "paid_social"),
    (3, "Paid Search", "paid_search"),
    (4, "Display", "display"),
    (5, "Email", "email"),
    (6, "Affiliates", "affiliates"),
    (7, "Organic Search", "organic_search"),
    (8, "Organic Social", "organic_social"),
    (9, "Referral", "referral"),
    (10, "Unknown", "unknown"),
    (11, "Other", "other"),
)
#: Columns of ``session_evidence``, which resolved sessions keep, so that they can be resolved anew.
EVIDENCE = (
    "user_pseudo_id", "ga_session_id", "session_key", "session_start_ts", "session_end_ts", "event_count", "purchase_event_count", "raw_event_tuple_event_count", "event_tuple",
    "external_referrer", "first_user_tuple", "direct_evidence_ts", "has_internal_event_source", "has_internal_page_referrer", "has_internal_first_user_source",
)
TIERS = ("event_level_source", "external_referrer", "first_user_fallback", "Direct", "Unknown")


def clean_events(base: DataFrame, s: Settings) -> DataFrame:
    """Events of known sessions with placeholders nulled and hosts of sources derived."""
    rows = base.where("session_key IS NOT NULL")
    names = [f"{a}_{b}" for a in ("event", "first_user") for b in ("source", "medium", "campaign")]
    rows = rows.withColumns({n: placeholder_null(F.col(n)) for n in names})
    hosts = {f"{a}_source_host": source_host(F.col(f"{a}_source")) for a in ("event", "first_user")}
    domains = {f"{a}_source_domain": source_domain(F.col(f"{a}_source"), s.public_suffixes) for a in ("event", "first_user")}
    return rows.withColumns(hosts | domains)


def _any(prefix: str) -> Column:
    return F.coalesce(*[F.col(f"{prefix}_{x}") for x in ("source", "medium", "campaign")]).isNotNull()


def _is_direct(prefix: str) -> Column:
    return (F.coalesce(F.lower(f"{prefix}_source"), F.lit("")) == "(direct)") | (F.coalesce(F.lower(f"{prefix}_medium"), F.lit("")) == "(none)")


def _tuple(prefix: str, *keys: Column) -> Column:
    """Order keys first (nulls as blanks), then the values: the least struct is the earliest evidence."""
    parts = [F.coalesce(F.col(f"{prefix}_{x}"), F.lit("")).alias(f"k_{x}") for x in ("source", "medium", "campaign")]
    values = [F.col(f"{prefix}_{x}").alias(x) for x in ("source", "medium", "campaign", "source_host", "source_domain")]
    return F.struct(F.col("event_ts").alias("ts"), *keys, *parts, *values)


def session_evidence(base: DataFrame, s: Settings) -> DataFrame:
    """Per session its span, counts and the earliest evidence of each kind."""
    e = clean_events(base, s)
    outside = lambda c: F.coalesce(F.col(c), F.lit("")) != s.storefront
    event_ok = _any("event") & ~_is_direct("event") & outside("event_source_domain")
    referrer_ok = F.col("page_referrer_host").isNotNull() & outside("page_referrer_domain")
    first_ok = _any("first_user") & ~_is_direct("first_user") & outside("first_user_source_domain")
    direct = _is_direct("event") | _is_direct("first_user")
    referrer = F.struct(F.col("event_ts").alias("ts"), F.col("page_referrer_host").alias("source_host"), F.coalesce("page_referrer", F.lit("")).alias("k"), F.col("page_referrer").alias("referrer"), F.col("page_referrer_domain").alias("source_domain"))
    return e.groupBy("user_pseudo_id", "ga_session_id", "session_key").agg(
        F.min("event_ts").alias("session_start_ts"),
        F.max("event_ts").alias("session_end_ts"),
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("event_name") == "purchase").alias("purchase_event_count"),
        F.count_if(_any("event")).alias("raw_event_tuple_event_count"),
        F.min(F.when(event_ok, _tuple("event", F.coalesce("event_name", F.lit("")).alias("k_name")))).alias("event_tuple"),
        F.min(F.when(referrer_ok, referrer)).alias("external_referrer"),
        F.min(F.when(first_ok, _tuple("first_user"))).alias("first_user_tuple"),
        F.min(F.when(direct, F.col("event_ts"))).alias("direct_evidence_ts"),
        F.bool_or(F.col("event_source_domain") == s.storefront).alias("has_internal_event_source"),
        F.bool_or(F.col("page_referrer_domain") == s.storefront).alias("has_internal_page_referrer"),
        F.bool_or(F.col("first_user_source_domain") == s.storefront).alias("has_internal_first_user_source"),
    )


def resolve_sources(evidence: DataFrame, s: Settings, provisional: bool = False) -> DataFrame:
    """The first tier with evidence wins.  ``provisional`` lets explicit direct evidence win before a referrer."""
    c = F.col
    e, r, f = c("event_tuple"), c("external_referrer"), c("first_user_tuple")
    tier = F.when(e.isNotNull(), TIERS[0])
    if provisional:
        tier = tier.when(c("direct_evidence_ts").isNotNull(), TIERS[3])
    tier = tier.when(r.isNotNull(), TIERS[1]).when(f.isNotNull(), TIERS[2]).when(c("direct_evidence_ts").isNotNull(), TIERS[3]).otherwise(TIERS[4])
    t = c("source_resolution_tier")
    by = lambda event, referrer, first, direct=None: F.when(t == TIERS[0], event).when(t == TIERS[1], referrer).when(t == TIERS[2], first).when(t == TIERS[3], F.lit(direct).cast("string"))
    inferred = (t == TIERS[1]) & (r["source_host"] == s.inferred_search_host)
    none = F.lit(None).cast("string")
    rows = evidence.withColumn("source_resolution_tier", tier).withColumns(
        {
            "resolved_source": by(e["source"], r["source_host"], f["source"], "(direct)"),
            "resolved_medium": by(e["medium"], F.when(r["source_host"] == s.inferred_search_host, "organic").otherwise("referral"), f["medium"], "(none)"),
            "resolved_campaign": by(e["campaign"], none, f["campaign"]),
            "resolved_source_host": by(e["source_host"], r["source_host"], f["source_host"]),
            "resolved_source_domain": by(e["source_domain"], r["source_domain"], f["source_domain"]),
            "is_inferred_source": F.coalesce(inferred, F.lit(False)),
        }
    )
    quality = (
        F.when(c("resolved_source").isNull() & c("resolved_medium").isNotNull(), "medium_only")
        .when(c("is_inferred_source"), "inferred")
        .when(t == TIERS[2], "first_user_fallback")
        .when(t == TIERS[3], "explicit_direct")
        .when(t == TIERS[4], "missing")
        .when(t == TIERS[0], "event_observed")
        .when(t == TIERS[1], "referrer_observed")
    )
    internal = [c(x).cast("long") for x in ("has_internal_event_source", "has_internal_page_referrer", "has_internal_first_user_source")]
    return rows.withColumns(
        {
            "session_date": F.to_date("session_start_ts"),
            "source_missing_flag": c("resolved_source").isNull(),
            "source_quality": quality,
            "inference_rule": F.when(c("is_inferred_source"), "google_referrer_to_organic_search"),
            "external_page_referrer": r["referrer"],
            "external_referrer_domain": r["source_domain"],
            "internal_storefront_evidence_type_count": internal[0] + internal[1] + internal[2],
            "resolution_version": F.lit(s.resolution_version),
        }
    )


def channel(is_admin: Column, tier: Column, source: Column, medium: Column, host: Column, domain: Column) -> Column:
    """struct<priority, channel, rule_name>: the first rule that holds."""
    m, h, d = F.lower(F.coalesce(medium, F.lit(""))), F.lower(F.coalesce(host, F.lit(""))), F.coalesce(domain, F.lit(""))
    social = d.isin(*SOCIAL_DOMAINS) | d.rlike(SOCIAL_DOMAIN_PATTERN)
    tests = (
        is_admin,
        (tier == TIERS[3]) | (F.coalesce(F.lower(source), F.lit("")) == "(direct)") | (m == "(none)"),
        m.rlike(PAID_SOCIAL_MEDIUM) | (m.rlike(PAID_MEDIUM) & social),
        m.rlike(PAID_MEDIUM),
        m.rlike(DISPLAY_MEDIUM),
        m.rlike(EMAIL_MEDIUM),
        m.rlike(AFFILIATE_MEDIUM),
        m.rlike(ORGANIC_MEDIUM),
        (h != NOT_SOCIAL_HOST) & (m.rlike(SOCIAL_MEDIUM) | social),
        (tier == TIERS[1]) | (m == "referral"),
        (tier == TIERS[4]) | (source.isNull() & medium.isNull()),
        F.lit(True),
    )
    out = None
    for test, (priority, name, rule) in zip(tests, CHANNEL_RULES, strict=True):
        row = F.struct(F.lit(priority).cast("long").alias("priority"), F.lit(name).alias("channel"), F.lit(rule).alias("rule_name"))
        out = F.when(test, row) if out is None else out.when(test, row)
    return out


def touchpoints(resolved: DataFrame, s: Settings) -> DataFrame:
    """One row per session with its eligibility and channel."""
    host = F.coalesce("resolved_source_host", F.lit(""))
    admin = host.isin(*s.admin_hosts)
    rows = resolved.withColumns(
        {
            "is_internal_admin_traffic": admin,
            "internal_admin_reason": F.when(F.lower(host).isin(*s.admin_hosts), F.concat(F.lit("approved_admin_host:"), F.lower(host))),
            "is_internal_admin_candidate": F.lit(False),
            "is_marketing_eligible": ~admin,
            "is_attribution_eligible": ~admin,
        }
    )
    m = channel(F.col("is_internal_admin_traffic"), *[F.col(x) for x in ("source_resolution_tier", "resolved_source", "resolved_medium", "resolved_source_host", "resolved_source_domain")])
    rows = rows.withColumn("m", m).withColumns({"channel": F.col("m.channel"), "mapping_rule_priority": F.col("m.priority"), "mapping_rule_name": F.col("m.rule_name"), "mapping_version": F.lit(s.mapping_version)})
    return rows.drop("m", "event_tuple", "external_referrer", "first_user_tuple")


def eligible(sessions: DataFrame) -> DataFrame:
    return sessions.where("is_attribution_eligible AND NOT is_internal_admin_traffic AND channel != 'Internal/Admin'")
