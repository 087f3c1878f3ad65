"""Tables that lie together by user are shuffled once; users of very many rows are cut instead, with the same results."""

import __spark_entry__  # noqa: F401  (fills the registry)
import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from creditflow.operators import audits, paths
from creditflow.operators.scan import Segments, following, lag, last, long_keys, number, total
from creditflow.plans import registry
from creditflow.plans.run import Run
from creditflow.settings import DEFAULT

QUERIES = ("paths_strict", "paths_revised", "aud_order_coverage", "attr_last_click", "aud_session_reuse", "aud_admin_impact", "aud_reprocess", "channel_funnel", "sens_compress", "ctl_formula_replay")


@pytest.fixture(scope="module")
def hot(sf, tmp_path_factory):
    """One user has 40 % of all events."""
    folder = tmp_path_factory.mktemp("hot")
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 5 < 2 THEN 3 ELSE user_id END AS user_id) FROM '{sf}/events.parquet') TO '{folder}/events.parquet'")
    return str(folder)


def rows_of(rows):
    return sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_user_is_cut_with_the_same_results(spark, hot):
    assert not Run.shared(spark, hot).by_user
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{hot}/events.parquet'")
    for name in QUERIES:
        got = registry.QUERIES[name](spark, hot)
        columns = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
        assert rows_of(got.select(*columns).collect()) == rows_of(want), name
    Run.shared(spark, hot).release()


def test_what_goes_along_users_is_not_shuffled_again(spark, sf):
    r = Run.shared(spark, sf)
    assert r.by_user
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("sources", "orders", "cycles", "path_rows", "results"):
            getattr(r, name)
            assert " Exchange" not in plan_of(object.__getattribute__(r, name)), name
        for df in (registry.QUERIES["attr_last_click"](spark, sf), audits.reprocessing_of(r.sources, DEFAULT)):
            assert " Exchange" not in plan_of(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_long_keys_are_cut_and_others_are_windows(spark):
    rows = spark.range(600).select("id", F.when(F.col("id") < 300, "hot").when(F.col("id") % 50 > 0, F.concat(F.lit("k"), F.col("id") % 37)).alias("key"), (F.col("id") * 7 % 101).alias("at"), F.when(F.col("id") % 3 > 0, F.col("id") % 11).alias("v"))
    w = Window.partitionBy("key").orderBy("at", "id")
    here, onwards = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    values = {"a": lag("v"), "b": last("v"), "c": last("v", before=True), "d": following("v"), "e": total("v"), "f": number()}
    want = rows.withColumns({"a": F.lag("v").over(w), "b": F.last("v", True).over(here), "c": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "d": F.first("v", True).over(onwards), "e": F.sum("v").over(here), "f": F.row_number().over(w).cast("long")})
    assert [x[0] for x in long_keys(rows, ("key",), 8).collect()] == ["hot"]
    assert rows_of(Segments.long_keys(rows, ("key",), ["at", "id"], 8).with_columns(values).done().select(want.columns).collect()) == rows_of(want.collect())
    light = rows.where("key <> 'hot' OR key IS NULL")
    got = Segments.long_keys(light, ("key",), ["at", "id"], 4).with_columns({"f": number()}).where("v > 1").with_columns({"g": total("v")}).done()
    assert plan_of(got).count(" Exchange") == 1
    want = light.withColumn("f", F.row_number().over(w).cast("long")).where("v > 1").withColumn("g", F.sum("v").over(here))
    assert rows_of(got.collect()) == rows_of(want.collect())


def test_strict_paths_are_numbered_among_themselves(spark, sf):
    r = Run.shared(spark, sf)
    w = Window.partitionBy("order_key")
    strict = paths.strict_paths(r.path_rows)
    again = strict.withColumns({"touchpoint_number": F.row_number().over(w.orderBy("session_start_ts", "session_key")).cast("long"), "path_length": F.count(F.lit(1)).over(w)})
    assert rows_of(strict.collect()) == rows_of(again.select(strict.columns).collect()) and strict.count() < r.revised.count()


def test_coverage_by_user_and_by_stretch_of_time(spark, sf):
    r = Run.shared(spark, sf)
    one, other = (paths.order_coverage(r.cycles, r.sessions, r.strict, r.revised, DEFAULT, x) for x in (True, False))
    assert rows_of(one.collect()) == rows_of(other.select(one.columns).collect())


def test_both_resolutions_of_a_row_equal_the_join_of_both(spark, sf):
    r = Run.shared(spark, sf)
    got = audits.reprocessing_of(r.sources, DEFAULT)
    want = audits.reprocessing(r.provisional_sources, r.sources, DEFAULT)
    assert set(got.columns) == set(want.columns) and rows_of(got.select(want.columns).collect()) == rows_of(want.collect())
