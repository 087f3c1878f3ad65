"""Shards, buckets and the manifest: what is read, what is shuffled and what is built again, from plans and stored files."""

import shutil
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from creditflow.operators import paths
from creditflow.plans import manifest
from creditflow.plans.run import Run
from creditflow.settings import DEFAULT
from creditflow.sources import buckets, readers, shards, writers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plain(spark):
    """Plans as they are, without adaptive execution and small broadcasts."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shards") / "t")
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), "x") for i in range(24 * 30)]
    shards.write_shards(spark.createDataFrame(rows, "id long, ts timestamp_ntz, v string"), path, "ts")
    return path


def files_read(df):
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numFiles").value()


def test_static_partition_pruning(plain, days):
    plain.conf.set("spark.sql.adaptive.enabled", "false")
    some = shards.between(shards.open_shards(plain, days), "20240105", "20240110").select("id")
    assert "PartitionFilters: [isnotnull(event_date" in plan_of(some) and some.count() == 6 * 24
    assert files_read(some) == 6 and files_read(shards.open_shards(plain, days).select("id")) == 30


def test_dynamic_partition_pruning(plain, days):
    plain.conf.set("spark.sql.adaptive.enabled", "false")
    plain.createDataFrame([("20240103", "sale"), ("20240120", "sale"), ("20240121", "none")], "event_date string, kind string").write.mode("overwrite").parquet(f"{days}-wanted")
    some = shards.of_days(shards.open_shards(plain, days).select("id", "event_date"), plain.read.parquet(f"{days}-wanted").where("kind = 'sale'"))
    assert "dynamicpruning" in plan_of(some) and some.count() == 48
    assert files_read(some) == 2


def test_days_are_replaced_and_missing_ones_found(spark, tmp_path):
    path, make = f"{tmp_path}/t", lambda rows: spark.createDataFrame(rows, "ts timestamp_ntz, v long")
    shards.write_shards(make([(datetime(2024, 1, 1), 1), (datetime(2024, 1, 2), 2)]), path, "ts")
    shards.write_shards(make([(datetime(2024, 1, 2, 5), 3)]), path, "ts", "overwrite")
    assert sorted(r["v"] for r in shards.open_shards(spark, path).collect()) == [1, 3]
    spine = readers.date_spine(spark, "2024-01-01", "2024-01-03").select(F.date_format("date", "yyyyMMdd").alias("event_date"))
    assert [r[0] for r in shards.missing_days(shards.open_shards(spark, path), spine).collect()] == ["20240103"]


def test_bucketed_tables_meet_without_a_shuffle(plain, sf):
    """Paths from tables bucketed by user: no exchange between their scans and the numbered paths, and the same rows."""
    plain.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plain.conf.set("spark.sql.adaptive.enabled", "false")
    run = Run.shared(plain, sf)
    stored = run.stored_by_user(4)
    plan = plan_of(stored.revised)
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Window" in plan and plan.count("Bucketed: true") == 2
    assert "Exchange" in plan_of(paths.conversion_paths(run.cycles, run.sessions, DEFAULT))
    columns = run.revised.columns
    assert stored.revised.select(columns).exceptAll(run.revised).count() == run.revised.exceptAll(stored.revised.select(columns)).count() == 0
    name = "bucketed_test_table"
    buckets.save_bucketed(run.orders.select("user_pseudo_id", "order_ts"), name, ["user_pseudo_id"], 4)
    with pytest.raises(Exception, match="(?i)exists"):
        buckets.save_bucketed(run.orders.select("user_pseudo_id", "order_ts"), name, ["user_pseudo_id"], 4)
    buckets.drop(plain, name)


def test_materialise_resumes_only_what_is_still_true(spark, sf, tmp_path):
    folder = str(tmp_path / "run")
    tables = list(Run.TABLES)
    first = Run(spark, sf)
    assert first.materialise(folder, "create") == tables
    again = Run(spark, sf)
    assert again.materialise(folder) == [] and again.results.count() > 0
    with pytest.raises(RuntimeError, match="already there"):
        Run(spark, sf).materialise(folder, "create")
    # Other settings: only what depends on them is stale, and resuming over stale tables is refused.
    other = Run(spark, sf, replace(DEFAULT, half_life_seconds=86_400))
    assert [n for n, x in other.preflight(folder).items() if x != manifest.COMPLETE] == ["results", "comparison"]
    with pytest.raises(RuntimeError, match="no exact prefix"):
        other.materialise(folder)
    assert other.materialise(folder, "rebuild") == ["results", "comparison"]
    assert set(other.preflight(folder).values()) == {manifest.COMPLETE} and Run(spark, sf).preflight(folder)["results"] == manifest.STALE
    # A hole in the prefix, and a table that was cut off before its key.
    assert Run(spark, sf).materialise(folder, "rebuild") == ["results", "comparison"]
    shutil.rmtree(f"{folder}/coverage")
    with pytest.raises(RuntimeError, match="coverage is missing"):
        Run(spark, sf).materialise(folder)
    for name in tables[tables.index("results") :]:
        shutil.rmtree(f"{folder}/{name}")
    assert Run(spark, sf).materialise(folder) == tables[tables.index("coverage") :]
    (tmp_path / "run" / "comparison" / manifest.KEY_FILE).unlink()
    assert Run(spark, sf).preflight(folder)["comparison"] == manifest.STALE


def test_another_input_makes_all_stale(spark, sf, tmp_path):
    events = f"{tmp_path}/in/events.parquet"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(events)
    run = Run(spark, f"{tmp_path}/in")
    before = run.keys()
    assert Run(spark, f"{tmp_path}/in").keys() == before
    spark.read.parquet(f"{sf}/events.parquet").limit(1).write.mode("append").parquet(events)
    after = run.keys()
    assert all(before[n] != after[n] for n in before)
    raw = spark.createDataFrame([(1, "a")], "event_id long, event_name string")
    assert Run(spark, sf, raw=raw).keys() == Run(spark, sf, raw=raw.select("*")).keys() != Run(spark, sf, raw=raw.union(raw)).keys()


def test_small_files_and_baseline(spark, tmp_path):
    path = f"{tmp_path}/x.txt"
    assert writers.get_text(spark, path) is None and not writers.path_exists(spark, path)
    writers.put_text(spark, path, "é one")
    writers.put_text(spark, path, "é two")
    assert writers.get_text(spark, path) == "é two" and writers.path_exists(spark, path)
    tables = {"a": spark.range(3).toDF("n"), "b": spark.range(2).toDF("n")}
    one, two = (writers.save_baseline(tables, f"{tmp_path}/b{i}", "v1") for i in range(2))
    assert one == two and writers.save_baseline({**tables, "b": spark.range(3).toDF("n")}, f"{tmp_path}/b3", "v1") != one
