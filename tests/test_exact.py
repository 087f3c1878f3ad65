"""Exact percentiles, mergeable distinct counts, whole suffix lists and the second derivation of all models."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditflow.functions import columns as C
from creditflow.operators import audits, distinct, domains, quantiles, reporting, validation
from creditflow.plans.run import Run
from creditflow.settings import DEFAULT


@pytest.mark.parametrize("few", [1024, 3])
def test_percentiles_equal_interpolated_order_statistics(spark, few):
    rng = random.Random(1)
    groups = {
        "many": [rng.gauss(0, 1) for _ in range(3000)],
        "skewed": [10.0**rng.uniform(-300, 300) for _ in range(500)] + [0.0] * 400,
        "same": [7.0] * 50,
        "one": [3.5],
        "two": [1.0, 2.0],
        "wide": [-1.7e308, 1.7e308, 0.0, 5.0],
        "odd": [float("-inf"), 1.0, 2.0, float("inf"), float("nan")],
        None: [float(i % 10) for i in range(101)],
    }
    rows = [(g, v, "x") for g, vs in groups.items() for v in vs] + [("many", None, "x"), ("empty", None, "x")]
    rng.shuffle(rows)
    fractions = [0.0, 0.025, 0.5, 0.75, 1.0]
    got = {r[0]: tuple(r)[1:] for r in quantiles.exact_percentiles(spark.createDataFrame(rows, "g string, v double, place string"), ["g"], "v", fractions, few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s, n = sorted(vs, key=lambda x: (x != x, x)), len(vs)
        for f, found in zip(fractions, got[g], strict=True):
            low, high = s[int(np.floor(f * (n - 1)))], s[int(np.ceil(f * (n - 1)))]
            want = low if low == high or (low != low and high != high) else low + (high - low) * (f * (n - 1) - np.floor(f * (n - 1)))
            assert found == pytest.approx(want, nan_ok=True), (g, f)
    assert got["many"][2] == pytest.approx(statistics.median(groups["many"]))
    assert quantiles.exact_percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).count() == 0


def test_percentiles_hold_no_group_in_a_buffer(spark):
    """Of a group of 200,000 values a pass hands on bins and, at the end, the few values of one bin."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    out = quantiles.exact_percentiles(df, ["g"], "v", [0.5])
    values = sorted(i * 7919 % 200_003 for i in range(200_000))
    assert out.first()["p0"] == (values[99_999] + values[100_000]) / 2
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_distinct_counts_of_chunks_add_up(spark):
    rng = random.Random(2)
    users = [None, *(f"u{i}" for i in range(70_000))]
    rows = [(rng.choice("abc"), rng.choice(users), rng.randrange(4)) for _ in range(60_000)] + [("d", None, 0)]
    df = spark.createDataFrame(rows, "k string, who string, chunk int")
    ids = distinct.dense_ids(df, "who")
    span = ids.agg(F.min("dense_id"), F.max("dense_id"), F.count("*"), F.count_distinct("dense_id")).first()
    assert span[0] == 0 and span[1] + 1 == span[2] == span[3] == len({w for _, w, _ in rows if w})
    known = df.join(ids, "who", "left")
    chunks = [distinct.bitmaps(known.where(F.col("chunk") == i), ["k"], "dense_id") for i in range(4)]
    assert chunks[0].where("k = 'a' AND bitmap IS NOT NULL").count() > 1  # a group's ids lie in several rows
    early = distinct.merged(chunks[:2], ["k"])  # merged in two steps
    got = {tuple(r) for r in distinct.counted(distinct.merged([early, *chunks[2:]], ["k"]), ["k"]).collect()}
    assert got == {(k, len({w for x, w, _ in rows if x == k and w}), sum(x == k for x, _, _ in rows)) for k in "abcd"}


def test_traffic_chunks_count_users_once(spark, sf):
    base = Run.shared(spark, sf).event_base
    users = distinct.dense_ids(base, "user_pseudo_id")
    parts = [audits.traffic_chunk(base.where(F.col("event_id") % 3 == i), users) for i in range(3)]
    columns = ["field", "value", "events", "distinct_users", "rank"]
    assert {tuple(r) for r in audits.combine_values(parts, 3).select(*columns).collect()} == {tuple(r) for r in audits.traffic_values(base, 3).select(*columns).collect()}


def test_domains_of_a_list_of_ten_thousand_rules(spark):
    """The plan does not grow with the list: rules are rows of a small join."""
    rules = ("com", "uk", "co.uk", "*.ck", "!www.ck", *(f"s{i}.zone{i % 100}" for i in range(10_000)))
    hosts = {f"a.b.s{i}.zone{i % 100}": f"b.s{i}.zone{i % 100}" for i in range(0, 10_000, 97)}
    hosts |= {"a.s5.zone7": "s5.zone7", "s7.zone7": None, "x.co.uk": "x.co.uk", "co.uk": None, "w.ck": None, "q.w.ck": "q.w.ck", "z.q.w.ck": "q.w.ck", "a.www.ck": "www.ck", "10.0.0.1": None, "localhost": None, "a..com": None, "A.com": "A.com", None: None}
    df = spark.createDataFrame([(h, w) for h, w in hosts.items()] * 2, "host string, want string")
    out = domains.registered_domains(df, domains.rules_table(spark, rules))
    assert out.count() == 2 * len(hosts) and [tuple(r) for r in out.collect() if r["domain"] != r["want"]] == []
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_formula_replay_finds_a_corrupted_credit(spark, sf):
    r = Run.shared(spark, sf)
    base = r.scenario_edges.where("scenario = 'baseline'")
    replay = lambda **x: {n["model"]: n for n in validation.formula_replay(*[x.get(k, v) for k, v in (("paths", r.revised), ("results", r.results), ("edges", base), ("effects", r.effects), ("attribution", r.markov_attribution))], DEFAULT).collect()}
    good = replay()
    assert len(good) == 6 and all(x["differences"] == 0 and x["compared"] > 0 for x in good.values())
    key = r.results.where("model = 'Linear'").orderBy("order_key", "channel").first()
    hit = (F.col("order_key") == key["order_key"]) & (F.col("model") == "Linear") & (F.col("channel") == key["channel"])
    bad = r.results.withColumn("attributed_conversion", F.when(hit, F.col("attributed_conversion") + 1e-8).otherwise(F.col("attributed_conversion")))
    assert {m: x["differences"] for m, x in replay(results=bad).items() if x["differences"]} == {"Linear": 1}
    assert replay(results=r.results.where(~hit))["Linear"]["differences"] == 1
    shifted = r.effects.withColumn("attribution_share", F.col("attribution_share") + F.when(F.col("channel") == "Email", 1e-6).otherwise(0.0))
    assert replay(effects=shifted)["Markov"]["differences"] == 1


def test_white_space_of_all_kinds_is_trimmed(spark):
    cases = {" a ": "a", "\ta\n": "a", " a b　": "a b", " \x85": None, "": None, None: None, "​a": "​a"}
    df = spark.createDataFrame(list(cases.items()), "x string, want string")
    assert [tuple(r) for r in df.select("x", "want", C.text(F.col("x")).alias("y")).collect() if r["y"] != r["want"]] == []
    odd = spark.createDataFrame([("(Not Set)\t",), (" <other>",), ("unknown\n",), ("ok\t",)], "x string")
    assert [r[0] for r in odd.select(C.placeholder_null(F.col("x"))).collect()] == [None, None, None, "ok"]


def test_top_paths_are_taken_in_order(spark, sf):
    r = Run.shared(spark, sf)
    plan = reporting.top_paths(r.revised, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    whole = [tuple(x) for x in reporting.journey_summary(r.revised, DEFAULT).where("summary_type = 'CONVERTING_PATH' AND sort_order <= 5").orderBy("sort_order").select("dimension_key", "sort_order", "attributable_conversions").collect()]
    assert [tuple(x)[:3] for x in reporting.top_paths(r.revised, 5).orderBy("sort_order").collect()] == whole
