"""From raw events to flat events, orders and their cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditflow.functions.columns import get_param, hash_key, reg_domain, text, trim, url_host
from creditflow.operators.scan import Segments, lag
from creditflow.settings import Settings


def event_base(raw: DataFrame, s: Settings) -> DataFrame:
    """Flat events; a session key only where user and session id are known."""
    p = F.col("event_params")
    page, referrer = text(get_param(p, "page_location", "string_value")), text(get_param(p, "page_referrer", "string_value"))
    session = get_param(p, "ga_session_id", "int_value")
    flat = raw.select(
        "event_id",
        F.to_date("event_ts").alias("event_date"),
        "event_ts",
        F.unix_micros(F.col("event_ts").cast("timestamp")).alias("event_timestamp"),
        "event_name",
        "user_pseudo_id",
        "user_id",
        session.alias("ga_session_id"),
        get_param(p, "ga_session_number", "int_value").alias("ga_session_number"),
        text(get_param(p, "source", "string_value")).alias("event_source"),
        text(get_param(p, "medium", "string_value")).alias("event_medium"),
        text(get_param(p, "campaign", "string_value")).alias("event_campaign"),
        page.alias("page_location"),
        referrer.alias("page_referrer"),
        text(F.col("traffic_source.source")).alias("first_user_source"),
        text(F.col("traffic_source.medium")).alias("first_user_medium"),
        text(F.col("traffic_source.name")).alias("first_user_campaign"),
        F.col("device.category").alias("device_category"),
        F.col("device.operating_system").alias("operating_system"),
        F.col("device.web_info.browser").alias("browser"),
        F.col("geo.country").alias("country"),
        F.col("geo.region").alias("region"),
        F.col("geo.city").alias("city"),
        text(F.col("ecommerce.transaction_id")).alias("transaction_id"),
        F.col("ecommerce.purchase_revenue").alias("purchase_revenue"),
        F.col("ecommerce.purchase_revenue_in_usd").alias("purchase_revenue_in_usd"),
    )
    known = F.col("user_pseudo_id").isNotNull() & F.col("ga_session_id").isNotNull()
    return (
        flat.withColumn("session_key", F.when(known, hash_key(user_pseudo_id=F.col("user_pseudo_id"), ga_session_id=F.col("ga_session_id"))))
        .withColumn("page_location_host", url_host(F.col("page_location")))
        .withColumn("page_referrer_host", url_host(F.col("page_referrer")))
        .withColumn("page_location_domain", reg_domain(F.col("page_location_host"), s.public_suffixes))
        .withColumn("page_referrer_domain", reg_domain(F.col("page_referrer_host"), s.public_suffixes))
    )


def orders(base: DataFrame) -> DataFrame:
    """One row per user and trimmed transaction id."""
    tid = trim(F.col("transaction_id"))
    valid = base.where((F.col("event_name") == "purchase") & F.col("user_pseudo_id").isNotNull() & (tid != "") & (F.lower(tid) != "(not set)"))
    revenue = F.col("purchase_revenue_in_usd")
    first = F.min(F.when(F.col("session_key").isNotNull(), F.struct("event_ts", "session_key")))
    return (
        valid.withColumn("transaction_id", tid)
        .groupBy("user_pseudo_id", "transaction_id")
        .agg(
            F.min("event_ts").alias("order_ts"),
            first["session_key"].alias("conversion_session_key"),
            F.max(revenue).alias("order_revenue_usd"),
            F.count(F.lit(1)).alias("purchase_event_count"),
            (F.count(F.lit(1)) - 1).alias("duplicate_purchase_event_count"),
            F.count_distinct(revenue).alias("distinct_revenue_value_count"),
            F.min(revenue).alias("minimum_observed_revenue_usd"),
            F.max(revenue).alias("maximum_observed_revenue_usd"),
        )
        .withColumn("order_key", hash_key(user_pseudo_id=F.col("user_pseudo_id"), transaction_id=F.col("transaction_id")))
        .withColumn("order_date", F.to_date("order_ts"))
    )


def order_cycles(orders: DataFrame) -> DataFrame:
    """Orders with the user's order before, and their place among those of the same time; users of very many are scanned in segments."""
    rows = Segments.long_keys(orders, ("user_pseudo_id",), ["order_ts", "order_key"]).with_columns({"previous_order_ts": lag("order_ts")}).done()
    same = Window.partitionBy("user_pseudo_id", "order_ts")
    return rows.withColumns({"same_timestamp_order_count": F.count(F.lit(1)).over(same), "same_timestamp_order_sequence": F.row_number().over(same.orderBy("order_key")).cast("long")})
