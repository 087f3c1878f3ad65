"""Queries of storage (shards, buckets, sinks, manifest) and of functions whose special cases are laid over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditflow.functions import columns as C
from creditflow.operators import distinct, domains, quantiles
from creditflow.operators.sessions import EMAIL_MEDIUM
from creditflow.plans import manifest
from creditflow.plans.primitive import NAMES
from creditflow.plans.registry import of_run, of_tables
from creditflow.plans.run import Run
from creditflow.settings import DEFAULT, Settings
from creditflow.sources import buckets, readers, shards, writers
from creditflow.sources.readers import table as t

c = F.col


def _pick(values: tuple, by: str, kind: str) -> Column:
    """The value at ``by`` modulo their number."""
    return F.array(*[F.lit(v).cast(kind) for v in values])[(c(by) % len(values)).cast("int")]


def _sql_pick(values: tuple, by: str, kind: str) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN {by} % {len(values)} = {i} THEN CAST({quoted(v)} AS {kind})" for i, v in enumerate(values)) + " END"


# Shards: the events as a date-partitioned table.
def _shards(s: SparkSession, d: str) -> DataFrame:
    path = writers.scratch(s, "shards")
    shards.write_shards(t(s, d, "events").select("event_id", "ts", "event_type"), path, "ts")
    return shards.open_shards(s, path)


def _order_days(s: SparkSession, d: str) -> DataFrame:
    """The days of January 2024 on which more than a thirtieth of its purchases were made: known at run time only."""
    bought = t(s, d, "events").where("event_type = 'purchase' AND ts >= '2024-01-01' AND ts < '2024-02-01'")
    days = bought.groupBy(F.date_format("ts", "yyyyMMdd").alias("event_date")).agg(F.count("*").alias("n"))
    return days.crossJoin(F.broadcast(bought.agg(F.count("*").alias("all")))).where(c("n") * 30 > c("all")).select("event_date")  # one row


of_tables(
    "src_shard_scan",
    lambda s, d: shards.between(_shards(s, d), "20240105", "20240110").groupBy("event_date").agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("types")),
    """SELECT strftime(ts, '%Y%m%d') AS event_date, count(*) AS events, count(DISTINCT event_type) AS types FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1""",
)
of_tables(
    "src_shard_scan_dynamic",
    lambda s, d: shards.of_days(_shards(s, d), _order_days(s, d)).groupBy("event_date").agg(F.count("*").alias("events")),
    """WITH b AS (SELECT strftime(ts, '%Y%m%d') AS event_date FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'),
    w AS (SELECT event_date FROM b GROUP BY 1 HAVING count(*) * 30 > (SELECT count(*) FROM b))
    SELECT strftime(ts, '%Y%m%d') AS event_date, count(*) AS events FROM events WHERE strftime(ts, '%Y%m%d') IN (SELECT event_date FROM w) GROUP BY 1""",
)
of_tables(
    "src_literal_rows",
    lambda s, d: readers.literal(s, [("view", 1), ("click", 2), ("refund", 3)], "event_type string, weight int").join(t(s, d, "events"), "event_type", "left").groupBy("event_type", "weight").agg(F.count("event_id").alias("events")),
    "SELECT v.event_type, v.weight, count(event_id) AS events FROM (VALUES ('view', 1), ('click', 2), ('refund', 3)) AS v(event_type, weight) LEFT JOIN events USING (event_type) GROUP BY 1, 2",
)


def _spine(s: SparkSession, d: str) -> DataFrame:
    """Every day from the first event's month to the last event's, with its events."""
    days = t(s, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("events"))
    first, last = days.agg(F.trunc(F.min("date"), "month"), F.last_day(F.max("date"))).first()
    return readers.date_spine(s, str(first), str(last)).join(days, "date", "left").fillna(0, ["events"])


of_tables(
    "src_date_spine",
    _spine,
    """WITH r AS (SELECT date_trunc('month', min(ts)) AS a, last_day(CAST(max(ts) AS DATE)) AS z FROM events)
    SELECT x.date, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = x.date) AS events FROM (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM r) x""",
)


# Sinks
def _saved_rows(s: SparkSession, d: str) -> DataFrame:
    """A table of a few rows kept on the driver, as results of a model are, stored under an explicit schema."""
    found = t(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg(F.when(c("o_orderstatus") == "F", c("o_totalprice"))).alias("finished")).collect()  # a row per priority
    path = writers.scratch(s, "rows")
    writers.save_rows(s, [tuple(r) for r in found], "o_orderpriority string, n long, finished double", path)
    return s.read.parquet(path).select("o_orderpriority", "n", F.round("finished", 6).alias("finished"))


of_tables(
    "snk_rows_schema",
    _saved_rows,
    "SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 6) AS finished FROM orders GROUP BY 1",
)


def _baseline(s: SparkSession, d: str) -> DataFrame:
    """A baseline snapshot written as JSON and read back; whether its records give the digest that was written beside them."""
    path = writers.scratch(s, "baseline")
    total = writers.save_baseline({n: t(s, d, n) for n in NAMES}, path, DEFAULT.reporting_version)
    records = writers.read_baseline(s, path)
    same = writers.baseline_digest(records) == total == writers.get_text(s, f"{path}/_BASELINE")
    return records.select("table_name", "rows", "version", (F.length("fingerprint") > 1).alias("has_fingerprint"), F.lit(same).alias("digest_fits"))


of_tables(
    "snk_metadata_json",
    _baseline,
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows, '{DEFAULT.reporting_version}' AS version, TRUE AS has_fingerprint, TRUE AS digest_fits FROM {n}" for n in NAMES),
)


def _bucketed(s: SparkSession, d: str) -> DataFrame:
    """Orders and customers stored in buckets of the customer: the join and the sums by customer need no shuffle."""
    orders = buckets.scratch_bucketed(t(s, d, "orders").select(c("o_custkey").alias("custkey"), "o_totalprice"), "orders", ["custkey"], 8)
    customers = buckets.scratch_bucketed(t(s, d, "customer").select(c("c_custkey").alias("custkey"), "c_mktsegment"), "customers", ["custkey"], 8)
    return customers.join(orders, "custkey").groupBy("custkey", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price"))


of_tables(
    "snk_table_bucketed",
    _bucketed,
    "SELECT c_custkey AS custkey, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2",
)
of_run(
    "paths_revised_bucketed",
    lambda r: r.stored_by_user(8).revised,
    "order_key session_key channel touchpoint_ts touchpoint_number path_length seconds_before_conversion touchpoint_eligibility_rule is_same_session_multi_order_exception",
    "x_revised",
)


# Manifest of a stored run
def _preflight(r: Run) -> DataFrame:
    """A run stored table by table, and what a later one would find: the same, and with another half-life."""
    folder = writers.scratch(r.spark, "run")
    r.materialise(folder, "create")
    again = Run(r.spark, r.sf_dir, r.s)
    changed = Run(r.spark, r.sf_dir, Settings(half_life_seconds=r.s.half_life_seconds * 2)).preflight(folder)
    rows = [(i, n, ", ".join(manifest.STEPS[n][0]), r.spark.read.parquet(f"{folder}/{n}").count(), state, changed[n]) for i, (n, state) in enumerate(again.preflight(folder).items())]
    return r.spark.createDataFrame(rows, "position long, table_name string, upstream string, rows long, state string, state_with_other_half_life string")


_STORED = {
    "event_base": "x_base", "orders": "x_orders", "sessions": "x_sessions", "strict": "x_strict", "revised": "x_revised", "coverage": "x_coverage", "results": "x_results",
    "journeys": "x_journeys", "effects": "(SELECT 1 FROM x_effects WHERE scenario = 'baseline')", "markov_attribution": "x_markov", "comparison": "x_comparison",
}
of_run(
    "ctl_preflight",
    _preflight,
    "#position table_name upstream #rows state state_with_other_half_life",
    "("
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS table_name, '{', '.join(manifest.STEPS[n][0])}' AS upstream, count(*) AS rows, 'complete' AS state,"
        f" '{'stale' if n in ('results', 'comparison') else 'complete'}' AS state_with_other_half_life FROM {source}"
        for i, (n, source) in enumerate(_STORED.items())
    )
    + ")",
)

# Filters, joins, percentiles and distinct counts
MEDIA = ("email", "e-mail", "mail", "E_MAIL", "email ", None)
of_tables(
    "flt_regex_medium",
    lambda s, d: t(s, d, "events").withColumn("medium", _pick(MEDIA, "event_id", "string")).where(F.lower("medium").rlike(EMAIL_MEDIUM)).groupBy("medium").agg(F.count("*").alias("events")),
    f"SELECT medium, count(*) AS events FROM (SELECT {_sql_pick(MEDIA, 'event_id', 'VARCHAR')} AS medium FROM events) WHERE medium IN ('email', 'e-mail', 'E_MAIL') GROUP BY 1",
)
of_tables(
    "join_anti_effect",
    lambda s, d: t(s, d, "events").where("event_type = 'click'").withColumn("day", F.to_date("ts")).join(t(s, d, "events").where("event_type = 'view'").select("user_id", F.to_date("ts").alias("day")), ["user_id", "day"], "left_anti").select("event_id", "user_id", "day"),
    """SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events e WHERE event_type = 'click'
    AND NOT EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND CAST(v.ts AS DATE) = CAST(e.ts AS DATE))""",
)
of_tables(
    "agg_percentile_cont",
    lambda s, d: quantiles.exact_percentiles(t(s, d, "part"), ["p_brand"], "p_retailprice", [0.5, 0.975]).select("p_brand", F.round("p0", 6).alias("median"), F.round("p1", 6).alias("high")),
    "SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.975), 6) AS high FROM part GROUP BY 1",
)
of_tables(
    "win_percentile",
    lambda s, d: t(s, d, "supplier").join(quantiles.exact_percentiles(t(s, d, "supplier"), ["s_nationkey"], "s_acctbal", [0.5]), "s_nationkey").select("s_suppkey", F.round("p0", 6).alias("median")),
    "SELECT s_suppkey, round(quantile_cont(s_acctbal, 0.5) OVER (PARTITION BY s_nationkey), 6) AS median FROM supplier",
)


def _distinct_by_month(s: SparkSession, d: str) -> DataFrame:
    """Users and buyers per event type: each month counted apart, the months merged."""
    events = t(s, d, "events")
    rows = events.join(distinct.dense_ids(events, "user_id"), "user_id").withColumn("month", F.date_trunc("month", "ts"))
    months = [m["month"] for m in rows.select("month").distinct().collect()]  # a row per month
    chunks = [distinct.bitmaps(rows.where(c("month") == F.lit(m)), ["event_type"], "dense_id") for m in months]
    return distinct.counted(distinct.merged(chunks, ["event_type"]), ["event_type"], "users", "events")


of_tables("agg_count_distinct_merged", _distinct_by_month, "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS events FROM events GROUP BY 1")

# Functions with their special cases
PADS = ("", " ", "\t", "\n ", "　  ")
NAMED = ("google", "(Not Set)", "<Other>", "", None, "a b", "UNKNOWN")


def _padded() -> Column:
    return F.concat(_pick(PADS, "event_id", "string"), _pick(NAMED, "event_id", "string"), _pick(PADS[::-1], "event_id", "string"))


of_tables(
    "str_trim_nullif",
    lambda s, d: t(s, d, "events").select("event_id", C.text(_padded()).alias("y")),
    f"SELECT event_id, {_sql_pick(tuple(x or None for x in NAMED), 'event_id', 'VARCHAR')} AS y FROM events",
)
of_tables(
    "str_placeholder_null",
    lambda s, d: t(s, d, "events").select("event_id", C.placeholder_null(_padded()).alias("y")),
    f"SELECT event_id, {_sql_pick(('google', None, None, None, None, 'a b', None), 'event_id', 'VARCHAR')} AS y FROM events",
)
BAD_DAYS = ("20240230", "x", "2024-01-01", None)
of_tables(
    "dt_parse_date",
    lambda s, d: t(s, d, "events").select("event_id", F.try_to_date(F.when(c("event_id") % 5 == 0, _pick(BAD_DAYS, "event_id", "string")).otherwise(F.date_format("ts", "yyyyMMdd")), "yyyyMMdd").alias("d")),
    "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) END AS d FROM events",
)
NUMBERS = ("1.5", "NaN", "Infinity", "-Infinity", None)
of_tables(
    "math_isnan_isinf",
    lambda s, d: t(s, d, "events").select("event_id", C.finite(F.when(c("event_id") % 7 == 0, c("value")).otherwise(_pick(NUMBERS, "event_id", "double"))).alias("y")),
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN value WHEN event_id % 5 = 0 THEN 1.5 END AS y FROM events",
)
#: Hosts and their registered domains, behind a label of their own.
HOSTS = {
    "b.com.cn": "b.com.cn",
    "com.cn": None,
    "me.github.io": "me.github.io",
    "github.io": None,
    "192.168.1.1": None,
    "Shop.co.uk": "shop.co.uk",
    "shop.example": "shop.example",
    "b.c.ck": "b.c.ck",
    "x.www.ck": "www.ck",
    "a..com": None,
}


def _domains(s: SparkSession, d: str) -> DataFrame:
    host = F.concat(F.lit("p"), c("page_id").cast("string"), F.lit("."), _pick(tuple(HOSTS), "page_id", "string"))
    url = F.concat(_pick(("http://", "https://u@", "//"), "page_id", "string"), host, _pick(("/x", ":80/?q=a.b", "#f", ""), "page_id", "string"))
    hosts = t(s, d, "pages").select("page_id", C.url_host(url).alias("host"))
    return domains.registered_domains(hosts, domains.rules_table(s, DEFAULT.public_suffixes)).select("page_id", "domain")


_LABELLED = tuple(f"{{p}}.{h.lower()}" if v is None and h not in ("192.168.1.1", "a..com") else v for h, v in HOSTS.items())
of_tables(
    "url_reg_domain_rules",
    _domains,
    f"SELECT page_id, replace({_sql_pick(_LABELLED, 'page_id', 'VARCHAR')}, '{{p}}', 'p' || page_id) AS domain FROM pages",
)
SOURCES = ("facebook.com", "www.shop.co.uk", "plain", "https://News.Example/a?b", "newsletter", None)
of_tables(
    "sub_macro",
    lambda s, d: t(s, d, "events").withColumn("x", _pick(SOURCES, "event_id", "string")).groupBy("x", C.source_host(c("x")).alias("host"), C.source_domain(c("x"), DEFAULT.public_suffixes).alias("domain")).agg(F.count("*").alias("events")),
    f"""SELECT x, CASE x WHEN 'https://News.Example/a?b' THEN 'news.example' WHEN 'facebook.com' THEN x WHEN 'www.shop.co.uk' THEN x END AS host,
    CASE x WHEN 'facebook.com' THEN x WHEN 'www.shop.co.uk' THEN 'shop.co.uk' END AS domain, count(*) AS events FROM (SELECT {_sql_pick(SOURCES, 'event_id', 'VARCHAR')} AS x FROM events) GROUP BY 1""",
)
