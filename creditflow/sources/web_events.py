"""The driver's ``events`` table as raw web-analytics events with nested parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditflow.operators.scan import Segments, lag, total

#: Last bucket of k, source, medium; the ranges follow each other from 0.
EVIDENCE = (
    (17, "google", "organic"),
    (25, "google", "cpc"),
    (30, "facebook.com", "paid_social"),
    (35, "facebook.com", "referral"),
    (38, "newsletter", "email"),
    (40, "newsletter\t", "\u00a0email\n"),
    (45, "Partners", "affiliate"),
    (50, "dsp", "display"),
    (58, "sites.example.org", "referral"),
    (63, None, "referral"),
    (69, "(direct)", "(none)"),
    (74, "shop.store.example", "referral"),
    (77, "admin.example.net", "referral"),
    (80, "<Other>", "(not set)"),
    (88, None, None),
    (89, "\u3000misc ", "weird"),
    (91, "misc", "weird"),
    (99, None, None),
)
SESSION_GAP_SECONDS = 6 * 3600


def _by_bucket(k: Column, at: int) -> Column:
    out = F.when(k < 0, F.lit(None).cast("string"))
    for row in EVIDENCE:
        out = out.when(k <= row[0], F.lit(row[at]).cast("string"))
    return out


def web_events(events: DataFrame) -> DataFrame:
    """One row per event, sessions numbered along each user's time, and a second purchase one second later for every fiftieth, to exercise de-duplication."""
    k = F.get_json_object("props", "$.k").cast("int")
    gap = F.timestamp_diff("SECOND", F.col("before"), F.col("ts")) > SESSION_GAP_SECONDS
    name = F.create_map(*[F.lit(x) for x in ("view", "view_item", "click", "add_to_cart", "signup", "begin_checkout", "purchase", "purchase", "error", "page_view")])
    referrer = F.when(k.between(81, 84), "https://www.google.com/search?q=a").when(k.between(85, 88), "https://blog.example.org/post")
    bought = F.when(F.col("event_id") % 97 == 0, "(not set)").when(F.col("event_id") % 89 != 0, F.concat(F.lit("t"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "\t\u2003").otherwise("")))
    is_purchase = F.col("event_type") == "purchase"
    param = lambda key, s=None, i=None: F.struct(
        F.lit(key).alias("key"),
        F.struct((F.lit(None).cast("string") if s is None else s).alias("string_value"), (F.lit(None).cast("long") if i is None else i).alias("int_value")).alias("value"),
    )
    rows = events.select("event_id", "user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_pseudo_id"), "ts", "event_type", "value", k.alias("k"))
    timed = Segments.long_keys(rows, ("user_pseudo_id",), ["ts", "event_id"]).with_columns({"before": lag("ts")})
    rows = timed.with_columns({"session": total(F.when(gap, 1).otherwise(0).cast("long"))}).done()
    k = F.col("k")
    referrer = F.when(k.between(81, 84), "https://www.google.com/search?q=a").when(k.between(85, 88), "https://blog.example.org/post")
    params = F.filter(
        F.array(
            F.when(F.col("event_id") % 67 == 0, param("ga_session_id", F.concat(F.lit("s"), F.col("session").cast("string")))).otherwise(param("ga_session_id", i=F.col("session"))),
            F.when(F.col("event_id") % 61 == 0, param("ga_session_id", i=F.col("session") + 1)),
            param("ga_session_number", i=F.col("session") + 1),
            param("page_location", F.concat(F.lit("https://shop.store.example/p/"), k.cast("string"))),
            F.when(_by_bucket(k, 1).isNotNull(), param("source", _by_bucket(k, 1))),
            F.when(_by_bucket(k, 2).isNotNull(), param("medium", _by_bucket(k, 2))),
            F.when(referrer.isNotNull(), param("page_referrer", referrer)),
        ),
        lambda p: p.isNotNull(),
    )
    return rows.select(
        "event_id",
        F.date_format("ts", "yyyyMMdd").alias("event_date"),
        F.explode(F.when(is_purchase & (F.col("event_id") % 50 == 0), F.array("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))).otherwise(F.array("ts"))).alias("event_ts"),
        name[F.col("event_type")].alias("event_name"),
        "user_pseudo_id",
        F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("login-"), F.col("user_id").cast("string"))).alias("user_id"),
        params.alias("event_params"),
        F.struct(
            F.when(F.col("user_id") % 5 == 0, "google").when(F.col("user_id") % 5 == 1, "(direct)").alias("source"),
            F.when(F.col("user_id") % 5 == 0, "organic").when(F.col("user_id") % 5 == 1, "(none)").alias("medium"),
            F.lit(None).cast("string").alias("name"),
        ).alias("traffic_source"),
        F.struct(
            F.when(F.col("user_id") % 3 == 0, "desktop").when(F.col("user_id") % 3 == 1, "mobile").otherwise("tablet").alias("category"),
            F.when(F.col("user_id") % 3 == 0, "Web").when(F.col("user_id") % 7 != 0, "Android").alias("operating_system"),
            F.struct(F.when(F.col("user_id") % 2 == 0, "Chrome").otherwise("Safari").alias("browser")).alias("web_info"),
        ).alias("device"),
        F.struct(
            F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("country-"), (F.col("user_id") % 4).cast("string"))).alias("country"),
            F.concat(F.lit("region-"), (F.col("user_id") % 8).cast("string")).alias("region"),
            F.when(F.col("user_id") % 13 == 0, "(not set)").otherwise(F.concat(F.lit("city-"), (F.col("user_id") % 16).cast("string"))).alias("city"),
        ).alias("geo"),
        F.struct(F.when(is_purchase, bought).alias("transaction_id"), F.when(is_purchase, F.col("value")).alias("purchase_revenue"), F.when(is_purchase, F.col("value")).alias("purchase_revenue_in_usd")).alias("ecommerce"),
    )
