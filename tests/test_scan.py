"""Running values over segments against windows over whole keys."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from creditflow.operators import paths
from creditflow.operators.scan import SEGMENT, Segments, following, global_rank, lag, last, number, total
from creditflow.settings import DEFAULT

SEGMENTS = 16


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds half of all rows; null keys, null and repeated times, null values."""
    rng = random.Random(4)
    keys = ["hot"] * 1200 + [None] * 100 + [f"k{rng.randrange(300)}" for _ in range(1100)]
    data = [(i, k, rng.choice([None, *range(400)]), rng.choice([None, *range(9)])) for i, k in enumerate(keys)]
    return spark.createDataFrame(data, "id long, key string, at long, v long")


def multiset(df, columns):
    return Counter(map(tuple, df.select(*columns).collect()))


def test_equals_windows(rows):
    w = Window.partitionBy("key").orderBy("at", "id")
    to_here, onwards = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = rows.withColumns(
        {
            "a": F.lag("v").over(w),
            "b": F.last("v", ignorenulls=True).over(to_here),
            "c": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "d": F.first("v", ignorenulls=True).over(onwards),
            "e": F.sum("v").over(to_here),
            "f": F.row_number().over(w).cast("long"),
        }
    )
    cut = Segments.cut(rows, ("key",), ["at", "id"], SEGMENTS)
    got = cut.with_columns({"a": lag("v"), "b": last("v"), "c": last("v", before=True), "d": following("v"), "e": total("v"), "f": number()}).done()
    assert multiset(got, want.columns) == multiset(want, want.columns)
    twice = cut.with_columns({"x": lag("v")}).where("id % 3 > 0").with_columns({"y": total(F.coalesce("x", F.lit(1)))}).done()
    again = rows.withColumn("x", F.lag("v").over(w)).where("id % 3 > 0").withColumn("y", F.sum(F.coalesce("x", F.lit(1))).over(to_here))
    assert multiset(twice, again.columns) == multiset(again, again.columns)


def test_descending_order_and_no_key(rows):
    order = [F.desc("at"), F.asc("id")]
    got = global_rank(rows, order, "n")
    want = rows.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long"))
    assert multiset(got, want.columns) == multiset(want, want.columns)
    assert global_rank(rows.limit(0), order, "n").count() == 0


def test_no_task_holds_more_than_a_segment(rows):
    """The hot key lies in many segments, and the join that adds what they hand on gets fewer than two rows a segment."""
    cut = Segments.cut(rows, ("key",), ["at", "id"], SEGMENTS)
    sizes = {r[SEGMENT]: r["count"] for r in cut.rows.groupBy(SEGMENT).count().collect()}
    hot = cut.rows.where("key = 'hot'").select(SEGMENT).distinct().count()
    assert max(sizes.values()) < rows.count() / 8 and hot >= 6
    plan = cut.with_columns({"n": number()}).rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and f"{SEGMENT}#" in plan
    pieces = cut.rows.groupBy("key", SEGMENT).count()
    several = pieces.join(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key").count()
    assert several < 2 * SEGMENTS


def test_only_keys_in_several_segments_are_looked_through_for_what_they_hand_on(rows):
    cut = Segments.cut(rows, ("key",), ["at", "id"], SEGMENTS)
    lie = cut.rows.groupBy("key").agg(F.count_distinct(SEGMENT).alias("n")).where("n > 1")
    keys = {r["key"] for r in lie.collect()}
    assert "hot" in keys and len(keys) < SEGMENTS
    twice = cut.with_columns({"a": lag("v")}).with_columns({"b": total("v")})
    for found in (cut, twice):
        assert multiset(found.divided, found.rows.columns) == multiset(found.rows.where(F.col("key").isin(*(keys - {None})) | (F.col("key").isNull() & F.lit(None in keys))), found.rows.columns)


def test_journeys_of_a_hot_user(spark):
    """A user with half of all sessions is cut into segments; its journeys are those of a plain walk along time."""
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rng, start = random.Random(9), datetime(2024, 1, 2)
        users = ["hot"] * 300 + [f"u{rng.randrange(80)}" for _ in range(300)]
        sessions = []
        for i, u in enumerate(users):
            at = start + timedelta(minutes=rng.randrange(40_000))
            sessions.append((u, f"s{i:04}", at, at + timedelta(minutes=rng.randrange(30)), rng.choice(["Email", "Direct"]), True, False, "m1"))
        orders = [(rng.choice(users), start + timedelta(minutes=rng.randrange(40_000))) for _ in range(60)] + [(sessions[5][0], sessions[5][2])]
        s = spark.createDataFrame(sessions, "user_pseudo_id string, session_key string, session_start_ts timestamp_ntz, session_end_ts timestamp_ntz, channel string, is_attribution_eligible boolean, is_internal_admin_traffic boolean, mapping_version string")
        o = spark.createDataFrame(orders, "user_pseudo_id string, order_ts timestamp_ntz")
        got = {(r["user_pseudo_id"], r["journey_number"], tuple(r["session_key_path"]), r["next_purchase_ts"]) for r in paths.segmented_journeys(s, o, DEFAULT.inactivity_seconds).collect()}
        want = set()
        for u in set(users):
            own = sorted((x for x in sessions if x[0] == u), key=lambda x: (x[2], x[1]))
            bought = sorted(t for x, t in orders if x == u)
            journeys = []
            for i, x in enumerate(own):
                before = own[i - 1] if i else None
                fresh = before is None or x[2] >= before[3] + timedelta(seconds=DEFAULT.inactivity_seconds) or any(before[2] <= t < x[2] for t in bought)
                journeys += [[]] if fresh else []
                journeys[-1].append(x)
            want |= {(u, n, tuple(x[1] for x in j), next((t for t in bought if t >= j[0][2]), None)) for n, j in enumerate(journeys, 1)}
        assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
