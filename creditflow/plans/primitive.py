"""One query for each primitive operator, over the driver's tables, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditflow.functions import columns as C
from creditflow.operators.paths import asof_last, asof_next
from creditflow.operators.scan import Segments, global_rank, lag, total
from creditflow.operators.sensitivity import ordinal_rank, tied_channels
from creditflow.plans import oracle
from creditflow.plans.registry import of_tables
from creditflow.settings import DEFAULT
from creditflow.sources import readers, writers
from creditflow.sources.readers import table as t

c = F.col
SUFFIXES = DEFAULT.public_suffixes


def _events(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events")


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", C.url_host(c("url")).alias("host"))


def _nation_paths(spark: SparkSession, d: str) -> DataFrame:
    """Per customer the statuses of the orders in time, as an array."""
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))).alias("p"))
    return o.select("o_custkey", F.transform("p", lambda x: x["o_orderpriority"]).alias("path"))


_PATHS = "(SELECT o_custkey, list(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS path FROM orders GROUP BY o_custkey)"
_HOST = oracle.host("url")

# Sources
of_tables("src_table", lambda s, d: t(s, d, "nation").select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation")

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_LISTED = ", ".join(f"'{n}'" for n in NAMES)
CATALOG_SQL = f"""SELECT table_name, column_name AS field_path, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' ELSE lower(data_type) END AS data_type
    FROM information_schema.columns WHERE table_name IN ({_LISTED})"""
of_tables("src_catalog_fields", lambda s, d: readers.catalog_fields(s, {n: t(s, d, n) for n in NAMES}), CATALOG_SQL)
of_tables(
    "src_table_exists",
    lambda s, d: readers.literal(s, [(n, readers.exists(s, f"{d}/{n}.parquet")) for n in (*NAMES, "no_such_table")], "table_name string, present boolean"),
    f"""SELECT n AS table_name, EXISTS (SELECT 1 FROM information_schema.tables WHERE table_name = n) AS present
    FROM (SELECT unnest([{_LISTED}, 'no_such_table']) AS n)""",
)
of_tables(
    "src_connection_probe",
    lambda s, d: readers.literal(s, [(n, readers.probe(s, f"{d}/{n}.parquet")) for n in ("events", "no_such_table")], "table_name string, ok boolean"),
    "SELECT n AS table_name, EXISTS (SELECT 1 FROM information_schema.tables WHERE table_name = n) AS ok FROM (SELECT unnest(['events', 'no_such_table']) AS n)",
)


# Sinks, each read back
def _chunked_ingest(s: SparkSession, d: str) -> DataFrame:
    path, events = writers.scratch(s, "ingest"), _events(s, d)
    writers.save_chunks([events.where("ts < '2024-01-11'"), events.where("ts >= '2024-01-11' AND ts < '2024-01-21'"), events.where("ts >= '2024-01-21'")], path)
    return s.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


def _saved_table(s: SparkSession, d: str) -> DataFrame:
    path, nation = writers.scratch(s, "table"), t(s, d, "nation")
    writers.save(nation.where("n_regionkey = 0"), path)  # replaced by the next
    writers.save(nation.where("n_regionkey <= 2"), path, "overwrite", cluster=["n_regionkey", "n_nationkey"])
    writers.save(nation.where("n_regionkey > 2"), path, "append", cluster=["n_regionkey", "n_nationkey"])
    return s.read.parquet(path)


def _csv_out(s: SparkSession, d: str) -> DataFrame:
    path = writers.scratch(s, "csv")
    rows = t(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.struct("o_custkey", "o_orderstatus").alias("who"), F.when(c("o_orderpriority") != "5-LOW", c("o_orderpriority")).alias("priority"))
    writers.save_csv(rows, path, ["o_orderkey"])
    return readers.read_csv(s, path)


def _csv_in(s: SparkSession, d: str) -> DataFrame:
    path = writers.scratch(s, "csv")
    writers.save_csv(t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, ["c_custkey"])
    return readers.read_csv(s, path)


of_tables("src_chunked_ingest", _chunked_ingest, "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
of_tables("snk_table", _saved_table, "SELECT * FROM nation")
of_tables(
    "snk_csv",
    _csv_out,
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
    '{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS who, nullif(o_orderpriority, '5-LOW') AS priority FROM orders""",
)
of_tables("src_csv", _csv_in, "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")

# Projections, filters, predicates
of_tables("prj_columns", lambda s, d: t(s, d, "region").select(c("r_regionkey").alias("key"), c("r_name").alias("name")), "SELECT r_regionkey AS key, r_name AS name FROM region")
of_tables("prj_star_alias", lambda s, d: t(s, d, "region").withColumns({"upper_name": F.upper("r_name"), "is_first": c("r_regionkey") == 0}), "SELECT region.*, upper(r_name) AS upper_name, r_regionkey = 0 AS is_first FROM region")
of_tables("flt_conj", lambda s, d: t(s, d, "orders").where((c("o_orderstatus") != "F") & c("o_totalprice").isNotNull() & (F.lower(F.trim("o_orderpriority")) == "1-urgent")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice IS NOT NULL AND lower(trim(o_orderpriority)) = '1-urgent'")
of_tables("flt_in", lambda s, d: t(s, d, "customer").where(c("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.coalesce("c_name", F.lit("")).isin("", "x")).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND coalesce(c_name, '') NOT IN ('', 'x')")
of_tables("flt_in_array", lambda s, d: _nation_paths(s, d).where(F.array_contains("path", "1-URGENT")).select("o_custkey"), f"SELECT o_custkey FROM {_PATHS} WHERE list_contains(path, '1-URGENT')")
of_tables("flt_having", lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders")).where("orders > 10"), "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(*) > 10")
of_tables("flt_eligibility", lambda s, d: t(s, d, "customer").where((c("c_acctbal") > 0) & ~(c("c_nationkey") == 3) & (c("c_mktsegment") != "HOUSEHOLD")).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT c_nationkey = 3 AND c_mktsegment <> 'HOUSEHOLD'")
of_tables("flt_regex", lambda s, d: t(s, d, "part").where(F.lower("p_type").rlike(r"^(small|large)\b")).select("p_partkey"), r"SELECT p_partkey FROM part WHERE regexp_matches(lower(p_type), '^(small|large)\b')")
of_tables("prd_bool_col", lambda s, d: t(s, d, "supplier").select("s_suppkey", ((c("s_nationkey") == 1) | ((c("s_acctbal") > 0) & (c("s_nationkey") > 10))).alias("flag")), "SELECT s_suppkey, s_nationkey = 1 OR s_acctbal > 0 AND s_nationkey > 10 AS flag FROM supplier")

# Joins
of_tables("join_inner_using", lambda s, d: t(s, d, "nation").join(t(s, d, "region"), c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
of_tables("join_left", lambda s, d: t(s, d, "customer").join(t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders")), "SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
of_tables(
    "join_full_outer",
    lambda s, d: t(s, d, "orders")
    .groupBy(c("o_orderdate").alias("k"))
    .agg(F.count("*").alias("a"))
    .join(t(s, d, L).groupBy(c("l_shipdate").alias("k")).agg(F.count("*").alias("b")), "k", "full"),
    """SELECT coalesce(x.k, y.k) AS k, a, b FROM (SELECT o_orderdate AS k, count(*) AS a FROM orders GROUP BY 1) x
    FULL JOIN (SELECT l_shipdate AS k, count(*) AS b FROM lineitem GROUP BY 1) y ON x.k = y.k""",
)
of_tables("join_cross", lambda s, d: t(s, d, "region").crossJoin(F.broadcast(t(s, d, "nation").agg(F.count("*").alias("nations")))).select("r_name", "nations"), "SELECT r_name, nations FROM region CROSS JOIN (SELECT count(*) AS nations FROM nation)")
of_tables(
    "join_range_equi",
    lambda s, d: _events(s, d).where("event_type = 'purchase'").alias("p").join(_events(s, d).where("event_type = 'view'").alias("v"), (c("p.user_id") == c("v.user_id")) & (c("v.ts") <= c("p.ts")) & (c("v.ts") >= c("p.ts") - F.expr("INTERVAL 6 HOURS"))).groupBy(c("p.event_id").alias("event_id")).agg(F.count("*").alias("views")),
    "SELECT p.event_id, count(*) AS views FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 6 HOURS WHERE p.event_type = 'purchase' AND v.event_type = 'view' GROUP BY 1",
)
of_tables("join_theta_small", lambda s, d: t(s, d, "part").crossJoin(F.broadcast(readers.literal(s, [(10,), (25,), (50,)], "most int"))).where("p_size <= most").groupBy("most").agg(F.count("*").alias("parts")), "SELECT most, count(*) AS parts FROM part JOIN (VALUES (10), (25), (50)) AS v(most) ON p_size <= most GROUP BY most")
of_tables("join_asof_last", lambda s, d: asof_last(_events(s, d).where("event_type = 'view'").select("event_id", "user_id", "ts"), _events(s, d).where("event_type = 'purchase'").select("user_id", c("ts").alias("bought")), "user_id", "ts", "bought", "last_purchase").select("event_id", "last_purchase"), "SELECT event_id, (SELECT max(p.ts) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts < v.ts) AS last_purchase FROM events v WHERE event_type = 'view'")
of_tables("join_asof_next", lambda s, d: asof_next(_events(s, d).where("event_type = 'view'").select("event_id", "user_id", "ts"), _events(s, d).where("event_type = 'purchase'").select("user_id", c("ts").alias("bought")), "user_id", "ts", "bought", "next_purchase").select("event_id", "next_purchase"), "SELECT event_id, (SELECT min(p.ts) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts >= v.ts) AS next_purchase FROM events v WHERE event_type = 'view'")
of_tables("join_semi_membership", lambda s, d: _nation_paths(s, d).select("o_custkey", F.explode(F.array_distinct("path")).alias("p")).join(t(s, d, "orders").where("o_totalprice > 300000").select(c("o_orderpriority").alias("p")).distinct(), "p", "left_semi").groupBy("o_custkey").agg(F.count_distinct("p").alias("n")), f"SELECT o_custkey, count(DISTINCT p) AS n FROM (SELECT o_custkey, unnest(path) AS p FROM {_PATHS}) WHERE p IN (SELECT o_orderpriority FROM orders WHERE o_totalprice > 300000) GROUP BY 1")
of_tables("join_self_baseline", lambda s, d: t(s, d, "nation").withColumn("base", F.max(F.when(c("n_nationkey") < 5, c("n_nationkey"))).over(Window.partitionBy("n_regionkey"))).select("n_nationkey", (c("n_nationkey") - c("base")).alias("gap")), "SELECT n_nationkey, n_nationkey - (SELECT max(b.n_nationkey) FROM nation b WHERE b.n_regionkey = n.n_regionkey AND b.n_nationkey < 5) AS gap FROM nation n")

# Aggregates
L = "lineitem"
of_tables("agg_count", lambda s, d: t(s, d, L).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("l_tax").alias("m")), "SELECT l_returnflag, count(*) AS n, count(l_tax) AS m FROM lineitem GROUP BY 1")
of_tables("agg_count_distinct", lambda s, d: t(s, d, L).groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct(F.when(c("l_quantity") > 25, c("l_partkey"))).alias("large_parts")), "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_partkey END) AS large_parts FROM lineitem GROUP BY 1")
of_tables("agg_countif", lambda s, d: t(s, d, L).groupBy("l_linestatus").agg(F.count_if(c("l_discount") > 0.05).alias("n")), "SELECT l_linestatus, count(*) FILTER (l_discount > 0.05) AS n FROM lineitem GROUP BY 1")
of_tables("agg_sum_conditional", lambda s, d: t(s, d, L).groupBy("l_linestatus").agg(F.round(F.sum(F.when(c("l_quantity") > 45, c("l_tax")).otherwise(0.0)), 4).alias("high"), F.round(F.sum(F.when(c("l_quantity") > 90, c("l_tax"))), 4).alias("none")), "SELECT l_linestatus, round(sum(CASE WHEN l_quantity > 45 THEN l_tax ELSE 0 END), 4) AS high, sum(CASE WHEN l_quantity > 90 THEN l_tax END) AS none FROM lineitem GROUP BY 1")
of_tables("agg_min_max_avg", lambda s, d: t(s, d, L).groupBy("l_returnflag").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.round(F.avg("l_linenumber"), 6).alias("mean")), "SELECT l_returnflag, min(l_shipdate) AS first, max(l_shipdate) AS last, round(avg(l_linenumber), 6) AS mean FROM lineitem GROUP BY 1")
of_tables("agg_any_value", lambda s, d: t(s, d, "nation").join(t(s, d, "region"), c("n_regionkey") == c("r_regionkey")).groupBy("n_regionkey").agg(F.max("r_name").alias("name")), "SELECT n_regionkey, any_value(r_name) AS name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
of_tables("agg_logical_or", lambda s, d: t(s, d, "orders").groupBy("o_orderpriority").agg(F.bool_or(c("o_totalprice") > 450000).alias("has_large"), F.bool_or(F.when(c("o_totalprice") < 0, True)).alias("none")), "SELECT o_orderpriority, bool_or(o_totalprice > 450000) AS has_large, bool_or(CASE WHEN o_totalprice < 0 THEN TRUE END) AS none FROM orders GROUP BY 1")
of_tables("agg_array_ordered", lambda s, d: _nation_paths(s, d).select("o_custkey", F.array_join("path", ">").alias("path")), f"SELECT o_custkey, array_to_string(path, '>') AS path FROM {_PATHS}")
of_tables("agg_first_by", lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.min(F.when(c("o_orderstatus") == "O", F.struct("o_orderdate", "o_orderkey")))["o_orderkey"].alias("first_open")), "SELECT o_custkey, (min(struct_pack(d := o_orderdate, k := o_orderkey)) FILTER (o_orderstatus = 'O')).k AS first_open FROM orders GROUP BY 1")
of_tables("agg_last_by", lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("last")), "SELECT o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS last FROM orders GROUP BY 1")
of_tables("agg_string_ordered", lambda s, d: t(s, d, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ' > ') WITHIN GROUP (ORDER BY n_nationkey)").alias("names")), "SELECT n_regionkey, string_agg(n_name, ' > ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
of_tables("agg_string_distinct", lambda s, d: t(s, d, "customer").groupBy("c_nationkey").agg(F.expr("listagg(DISTINCT c_mktsegment, ' | ') WITHIN GROUP (ORDER BY c_mktsegment)").alias("segments")), "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
of_tables("agg_group_multi", lambda s, d: t(s, d, L).groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n")), "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
of_tables("agg_global", lambda s, d: t(s, d, L).where("l_quantity > 1000").agg(F.count("*").alias("n"), F.sum("l_tax").alias("tax")), "SELECT count(*) AS n, sum(l_tax) AS tax FROM lineitem WHERE l_quantity > 1000")
of_tables("agg_two_level", lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("customers")), "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY n")
of_tables("agg_scalar_consts_grouped", lambda s, d: t(s, d, "customer").crossJoin(F.broadcast(t(s, d, "customer").agg(F.count("*").alias("total")))).groupBy("c_mktsegment", "total").agg(F.count("*").alias("n")), "SELECT c_mktsegment, (SELECT count(*) FROM customer) AS total, count(*) AS n FROM customer GROUP BY 1")
of_tables("agg_distinct_rows", lambda s, d: t(s, d, L).select("l_returnflag", "l_linestatus").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
of_tables("agg_stats_np", lambda s, d: t(s, d, "part").groupBy("p_brand").agg(*[F.round(x, 6).alias(n) for n, x in (("mean", F.avg("p_size")), ("sd", F.stddev_samp("p_size")), ("low", F.percentile("p_size", F.lit(0.025))), ("high", F.percentile("p_size", F.lit(0.975))), ("few", F.avg((c("p_size") <= 3).cast("double"))))]), "SELECT p_brand, round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS sd, round(quantile_cont(p_size, 0.025), 6) AS low, round(quantile_cont(p_size, 0.975), 6) AS high, round(avg(CASE WHEN p_size <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS few FROM part GROUP BY 1")
of_tables("agg_counter", lambda s, d: _nation_paths(s, d).select(F.explode(C.adjacent_pairs(c("path"))).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("n")), f"SELECT path[i] AS src, path[i + 1] AS dst, count(*) AS n FROM (SELECT path, unnest(range(1, len(path))) AS i FROM {_PATHS}) GROUP BY ALL")

# Windows
W = lambda: Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
of_tables(
    "win_lag",
    lambda s, d: Segments.cut(t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ("o_custkey",), ["o_orderdate", "o_orderkey"]).with_columns({"before": lag("o_orderdate")}).done().select("o_orderkey", "before"),
    "SELECT o_orderkey, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders",
)
of_tables(
    "win_row_number",
    lambda s, d: global_rank(t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "n", ("o_custkey",)).select("o_orderkey", "n"),
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders",
)
of_tables("win_dense_rank", lambda s, d: t(s, d, "part").select("p_partkey", F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))).cast("long").alias("r")), "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part")
of_tables("win_count_partition", lambda s, d: t(s, d, "supplier").select("s_suppkey", F.count("*").over(Window.partitionBy("s_nationkey")).alias("n")), "SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier")
of_tables(
    "win_sum_running",
    lambda s, d: Segments.cut(_events(s, d).select("event_id", "user_id", "ts", "event_type"), ("user_id",), ["ts", "event_id"])
    .with_columns({"purchases": total((c("event_type") == "purchase").cast("long"))})
    .done()
    .select("event_id", "purchases"),
    "SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS purchases FROM events",
)
of_tables("win_sum_partition", lambda s, d: t(s, d, "supplier").select("s_suppkey", F.round(c("s_acctbal") / F.sum("s_acctbal").over(Window.partitionBy("s_nationkey")), 6).alias("share")), "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS share FROM supplier")
of_tables("win_max_conditional", lambda s, d: t(s, d, "orders").select("o_orderkey", F.max(F.when(c("o_orderstatus") != "F", c("o_totalprice"))).over(Window.partitionBy("o_custkey")).alias("m")), "SELECT o_orderkey, max(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END) OVER (PARTITION BY o_custkey) AS m FROM orders")
of_tables("win_sum_global", lambda s, d: t(s, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).crossJoin(F.broadcast(t(s, d, "customer").agg(F.count("*").alias("all")))).select("c_mktsegment", F.round(c("n") / c("all"), 9).alias("share")), "SELECT c_mktsegment, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM customer GROUP BY 1")

# Sorts, limits, ranks
of_tables("srt_multi", lambda s, d: t(s, d, "nation").orderBy("n_regionkey", F.desc("n_name")).select("n_name"), "SELECT n_name FROM nation ORDER BY n_regionkey, n_name DESC")
of_tables("srt_case", lambda s, d: t(s, d, "region").orderBy(F.when(c("r_name") == "EUROPE", 0).otherwise(1), "r_name").select("r_name"), "SELECT r_name FROM region ORDER BY CASE WHEN r_name = 'EUROPE' THEN 0 ELSE 1 END, r_name")
of_tables("lmt_one", lambda s, d: t(s, d, "region").orderBy("r_regionkey").limit(1).select("r_regionkey"), "SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT 1")
of_tables("topk_global", lambda s, d: t(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
of_tables("topk_per_group", lambda s, d: t(s, d, "part").withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long")).where("rank <= 3").select("p_brand", "rank", "p_partkey"), "SELECT * FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, p_partkey FROM part) WHERE rank <= 3")
_ch = lambda s, d: t(s, d, "customer").groupBy(c("c_mktsegment").alias("channel")).agg(F.count("*").alias("v"))
of_tables("rank_ordinal", lambda s, d: _ch(s, d).withColumn("rank", ordinal_rank("v")), "SELECT c_mktsegment AS channel, count(*) AS v, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS rank FROM customer GROUP BY 1")
of_tables("rank_ties", lambda s, d: tied_channels(t(s, d, "nation").groupBy(c("n_regionkey").cast("string").alias("channel")).agg(F.count("*").alias("v")), "v"), "WITH x AS (SELECT CAST(n_regionkey AS VARCHAR) AS channel, count(*) AS v FROM nation GROUP BY 1) SELECT *, EXISTS (SELECT 1 FROM x y WHERE y.channel <> x.channel AND y.v = x.v) AS is_tied FROM x")

# Sets
of_tables("set_union_all", lambda s, d: t(s, d, "nation").select(c("n_name").alias("name")).unionAll(t(s, d, "region").select("r_name")), "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
of_tables("set_union_distinct", lambda s, d: t(s, d, "customer").select(c("c_nationkey").alias("k")).union(t(s, d, "supplier").select("s_nationkey")).distinct(), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")

# Arrays and structs
_params = lambda s, d: _events(s, d).select("event_id", F.array(F.struct(F.lit("k").alias("key"), F.struct(F.lit(None).cast("string").alias("string_value"), F.get_json_object("props", "$.k").cast("long").alias("int_value")).alias("value")), F.struct(F.lit("type").alias("key"), F.struct(c("event_type").alias("string_value"), F.lit(None).cast("long").alias("int_value")).alias("value"))).alias("p"))
of_tables("arr_param_lookup", lambda s, d: _params(s, d).select("event_id", C.get_param(c("p"), "k", "int_value").alias("k"), C.get_param(c("p"), "absent", "int_value").alias("none")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS none FROM events")
of_tables("arr_count_key", lambda s, d: _params(s, d).select("event_id", C.count_params(c("p"), "k").alias("n")), "SELECT event_id, 1 AS n FROM events")
of_tables("arr_unnest_cross", lambda s, d: _nation_paths(s, d).select("o_custkey", F.explode("path").alias("p")).groupBy("p").agg(F.count("*").alias("n")), f"SELECT p, count(*) AS n FROM (SELECT unnest(path) AS p FROM {_PATHS}) GROUP BY p")
of_tables("arr_unpivot_structs", lambda s, d: t(s, d, "region").select("r_regionkey", F.explode(F.array(F.struct(F.lit("name").alias("field"), c("r_name").alias("value")), F.struct(F.lit("key").alias("field"), c("r_regionkey").cast("string").alias("value")))).alias("x")).select("r_regionkey", "x.field", "x.value"), "SELECT r_regionkey, 'name' AS field, r_name AS value FROM region UNION ALL SELECT r_regionkey, 'key', CAST(r_regionkey AS VARCHAR) FROM region")
of_tables("arr_exists", lambda s, d: _nation_paths(s, d).select("o_custkey", F.exists("path", lambda x: x == "5-LOW").alias("low"), F.size(F.filter("path", lambda x: x == "5-LOW")).cast("long").alias("n")), f"SELECT o_custkey, list_contains(path, '5-LOW') AS low, len(list_filter(path, lambda x: x = '5-LOW')) AS n FROM {_PATHS}")
of_tables("arr_length", lambda s, d: _nation_paths(s, d).select("o_custkey", F.size("path").cast("long").alias("n")), f"SELECT o_custkey, len(path) AS n FROM {_PATHS}")
of_tables("arr_adjacent_pairs", lambda s, d: _nation_paths(s, d).select("o_custkey", F.explode(C.adjacent_pairs(c("path"))).alias("e")).select("o_custkey", "e.src", "e.dst"), f"SELECT o_custkey, path[i] AS src, path[i + 1] AS dst FROM (SELECT o_custkey, path, unnest(range(1, len(path))) AS i FROM {_PATHS})")
of_tables("arr_compress", lambda s, d: _nation_paths(s, d).select("o_custkey", F.array_join(C.compress_path(c("path")), ">").alias("path")), f"SELECT o_custkey, array_to_string(list_transform(list_filter(list_zip(path, [NULL] || path[:-2]), lambda x: x[1] IS DISTINCT FROM x[2]), lambda x: x[1]), '>') AS path FROM {_PATHS}")
of_tables("arr_omit_direct", lambda s, d: _nation_paths(s, d).select("o_custkey", F.transform("path", lambda x: F.when(x == "5-LOW", "Direct").otherwise(x)).alias("path")).select("o_custkey", F.array_join(C.omit_direct(c("path")), ">").alias("path")), f"SELECT o_custkey, array_to_string(CASE WHEN len(list_filter(path, lambda x: x <> 'Direct')) > 0 THEN list_filter(path, lambda x: x <> 'Direct') ELSE path END, '>') AS path FROM (SELECT o_custkey, list_transform(path, lambda x: CASE WHEN x = '5-LOW' THEN 'Direct' ELSE x END) AS path FROM {_PATHS})")
of_tables("struct_get", lambda s, d: t(s, d, "region").select("r_regionkey", F.when(c("r_regionkey") > 1, F.struct("r_name")).alias("x")).select("r_regionkey", c("x.r_name").alias("name")), "SELECT r_regionkey, CASE WHEN r_regionkey > 1 THEN r_name END AS name FROM region")

# Scalars
of_tables("str_lower_concat_substr", lambda s, d: t(s, d, "nation").select(F.lower("n_name").alias("a"), F.concat("n_name", F.lit(None).cast("string")).alias("b"), F.substring("n_name", 1, 3).alias("c")), "SELECT lower(n_name) AS a, n_name || CAST(NULL AS VARCHAR) AS b, substr(n_name, 1, 3) AS c FROM nation")
of_tables("str_regexp", lambda s, d: t(s, d, "pages").select("page_id", c("url").rlike("[?#]").alias("has"), F.regexp_replace("url", r"[?#].*$", "").alias("bare")), "SELECT page_id, regexp_matches(url, '[?#]') AS has, regexp_replace(url, '[?#].*$', '') AS bare FROM pages")
of_tables("url_host", _hosts, f"SELECT page_id, {_HOST} AS host FROM pages")
of_tables("url_reg_domain", lambda s, d: _hosts(s, d).select("page_id", C.reg_domain(c("host"), SUFFIXES).alias("domain")), f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, {oracle.domain('host')} AS domain FROM h")
of_tables("hash_sha256_key", lambda s, d: t(s, d, "nation").select("n_nationkey", C.hash_key(name=c("n_name"), key=c("n_nationkey"), none=F.lit(None).cast("string")).alias("h")), "SELECT n_nationkey, sha256(CAST(to_json(struct_pack(name := n_name, key := n_nationkey, none := CAST(NULL AS VARCHAR))) AS VARCHAR)) AS h FROM nation")
of_tables("json_struct_compare", lambda s, d: t(s, d, "nation").select("n_nationkey", (~F.struct("n_regionkey", F.lit(None).cast("int").alias("z")).eqNullSafe(F.struct(F.lit(1).alias("n_regionkey"), F.lit(None).cast("int").alias("z")))).alias("differs")), "SELECT n_nationkey, n_regionkey <> 1 AS differs FROM nation")
of_tables("dt_format_date", lambda s, d: _events(s, d).select("event_id", F.date_format("ts", "yyyyMMdd").alias("d")), "SELECT event_id, strftime(ts, '%Y%m%d') AS d FROM events")
of_tables("dt_micros", lambda s, d: _events(s, d).select("event_id", F.unix_micros(F.timestamp_micros(c("event_id") * 1000003)).alias("m")), "SELECT event_id, epoch_us(make_timestamp(event_id * 1000003)) AS m FROM events")
of_tables("dt_date", lambda s, d: _events(s, d).select("event_id", F.to_date("ts").alias("d")), "SELECT event_id, CAST(ts AS DATE) AS d FROM events")
of_tables("dt_add_sub", lambda s, d: _events(s, d).select("event_id", (c("ts") + C.days(30)).alias("later"), (c("ts") - C.days(7)).alias("earlier")), "SELECT event_id, ts + INTERVAL 30 DAY AS later, ts - INTERVAL 7 DAY AS earlier FROM events")
of_tables("dt_diff_seconds", lambda s, d: _events(s, d).select("event_id", C.whole_seconds(F.lit("2024-01-01 00:00:00.5").cast("timestamp_ntz"), c("ts")).alias("n")), "SELECT event_id, date_sub('second', TIMESTAMP '2024-01-01 00:00:00.5', ts) AS n FROM events")
of_tables("math_safe_divide", lambda s, d: t(s, d, "nation").select("n_nationkey", C.divide(c("n_nationkey"), c("n_regionkey")).alias("q")), "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) / nullif(n_regionkey, 0) AS q FROM nation")
of_tables("math_pow_abs_round_greatest", lambda s, d: t(s, d, "supplier").select("s_suppkey", F.round(F.pow(F.lit(0.5), c("s_suppkey") / 10), 6).alias("p"), F.abs("s_acctbal").alias("a"), F.round("s_acctbal", 1).alias("r"), F.greatest(c("s_acctbal"), F.lit(0.0)).alias("g")), "SELECT s_suppkey, round(pow(0.5, s_suppkey / 10.0), 6) AS p, abs(s_acctbal) AS a, round(s_acctbal, 1) AS r, greatest(s_acctbal, 0.0) AS g FROM supplier")
of_tables("cond_case_if_coalesce", lambda s, d: t(s, d, "orders").select("o_orderkey", F.when(c("o_totalprice") > 200000, "high").when(c("o_totalprice") > 100000, "middle").otherwise("low").alias("band"), F.coalesce(F.nullif(c("o_orderstatus"), F.lit("P")), F.lit("-")).alias("status")), "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'P'), '-') AS status FROM orders")
of_tables("cast_null_typed", lambda s, d: t(s, d, "region").select("r_regionkey", F.lit(None).cast("timestamp_ntz").alias("ts"), (c("r_regionkey") > 1).cast("long").alias("b"), c("r_regionkey").cast("string").alias("txt")), "SELECT r_regionkey, CAST(NULL AS TIMESTAMP) AS ts, CAST(r_regionkey > 1 AS BIGINT) AS b, CAST(r_regionkey AS VARCHAR) AS txt FROM region")

# Subqueries
of_tables("sub_cte", lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v")).where("v > 1000000").agg(F.count("*").alias("n")), "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1), b AS (SELECT * FROM a WHERE v > 1000000) SELECT count(*) AS n FROM b")
of_tables("sub_scalar_uncorrelated", lambda s, d: t(s, d, "region").agg(F.count("*").alias("regions")).crossJoin(t(s, d, "nation").agg(F.count("*").alias("nations"))), "SELECT (SELECT count(*) FROM region) AS regions, (SELECT count(*) FROM nation) AS nations")
of_tables("sub_scalar_correlated_nonequi", lambda s, d: asof_last(t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), t(s, d, "orders").select("o_custkey", c("o_orderdate").alias("before")), "o_custkey", "o_orderdate", "before", "last").select("o_orderkey", "last"), "SELECT o_orderkey, (SELECT max(p.o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate) AS last FROM orders o")
of_tables("sub_array_correlated", lambda s, d: _nation_paths(s, d).where(~F.exists("path", lambda x: x == "1-URGENT") & (F.size("path") > 2)).select("o_custkey"), f"SELECT o_custkey FROM {_PATHS} WHERE NOT list_contains(path, '1-URGENT') AND len(path) > 2")
