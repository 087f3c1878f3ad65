"""Chains, path functions, bootstrap, checks and writers on hand-made cases."""

import hashlib
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditflow.functions import columns as C
from creditflow.operators import domains, markov, paths, reporting, sensitivity, sessions, staging, validation
from creditflow.operators.markov import Chain
from creditflow.plans.run import Run
from creditflow.settings import DEFAULT, Settings
from creditflow.sources import readers, writers


def chain(*many):
    src, dst = [], []
    for p in many:
        src += p[:-1]
        dst += p[1:]
    return Chain.of(src, dst, [1] * len(src))


S, E, D, O, N, K = "Start", "Email", "Direct", "Organic", "Null", "Conversion"


def test_keys_and_parameters_as_json_and_filters_give_them(spark):
    texts = [None, "", "u1", 'q"x', "b\\c", "é", "x/y", "a\nb", "a\n", "\x7f", "~ !"]
    rows = spark.createDataFrame([(v, i if i % 3 else None) for i, v in enumerate(texts)], "s string, n long")
    for c in ("n", "double(n)"):
        whole = F.sha2(F.to_json(F.struct(F.col("s").alias("a"), F.expr(c).alias("b")), {"ignoreNullFields": "false"}), 256)
        assert rows.where(C.hash_key(a=F.col("s"), b=F.expr(c)) == whole).count() == len(texts)
    kind = "array<struct<key: string, value: struct<string_value: string, int_value: bigint>>>"
    params = spark.createDataFrame([([("a", ("x", None)), ("b", (None, 5)), ("b", ("z", 6))],), (None,), ([None, ("b", None), (None, ("x", 7))],)], f"p {kind}")
    got = [tuple(r) for r in params.select(C.get_param(F.col("p"), "a", "string_value"), C.get_param(F.col("p"), "b", "int_value"), C.get_param(F.col("p"), "b", "string_value"), C.get_param(F.col("p"), "c", "int_value")).collect()]
    assert got == [("x", 5, None, None), (None,) * 4, (None,) * 4]


def test_chain_probabilities():
    assert chain([S, E, K]).conversion_probability() == 1
    assert chain([S, D, N]).conversion_probability() == 0
    assert chain([S, E, "Paid Search", K], [S, "Referral", "Unknown", N]).conversion_probability() == pytest.approx(0.5)
    loop = chain([S, "Paid Search", "Paid Search", K])
    assert loop.counts[1, 1] == 1 and loop.conversion_probability() == pytest.approx(1)


def test_removal():
    one = chain([S, E, K]).without(E)
    assert one.conversion_probability() == 0 and one.probabilities[0, -1] == 1
    two = chain([S, O, E, K], [S, O, N]).without(E)
    assert two.probabilities[two.states.index(O), -1] == 1 and two.conversion_probability() == 0
    three = chain([S, E, K], [S, E, K], [S, D, N])
    assert three.conversion_probability() == pytest.approx(2 / 3)
    assert {r[0]: r[4] for r in three.effects()} == pytest.approx({E: 1, D: 0})
    half = chain([S, E, K], [S, D, K]).without(E)
    assert half.probabilities[0, -1] == pytest.approx(0.5) and half.probabilities[0, half.states.index(D)] == pytest.approx(0.5)
    many = chain([S, E, E, K], [S, D, N], [S, "Unknown", E, N])
    for c in many.states[1:-2]:
        assert np.allclose(many.without(c).probabilities.sum(axis=1), 1)


def test_normalised():
    for bad in ({"a": 0.0, "b": 0.0}, {"a": -1e-4, "b": 0.2}, {"a": float("inf"), "b": 0.2}, {}):
        with pytest.raises(ValueError):
            markov.normalised(bad)
    assert markov.normalised({"a": -5e-13, "b": 0.2}) == {"a": 0.0, "b": 1.0}


def test_invalid_paths(spark):
    rows = [([E, K],), ([S, E, E],), ([S, K, E, N],), ([S, E, N],), ([S, K],)]
    bad = markov.invalid_paths(spark.createDataFrame(rows, "path array<string>"))
    assert bad.count() == 3


def test_path_functions(spark):
    df = spark.createDataFrame([([E, E, "Paid Search", E],), ([D, D],), ([E, D, E],), ([],)], "p array<string>")
    got = [tuple(r) for r in df.select(C.compress_path(F.col("p")), C.omit_direct(F.col("p"))).collect()]
    assert got == [([E, "Paid Search", E], [E, E, "Paid Search", E]), ([D], [D, D]), ([E, D, E], [E, E]), ([], [])]


def test_ranks_and_ties(spark):
    df = spark.createDataFrame([("Unknown", 0.2), (E, 0.2), (D, 0.6)], "channel string, v double").withColumn("r", sensitivity.ordinal_rank("v"))
    got = {r["channel"]: (r["r"], r["is_tied"]) for r in sensitivity.tied_channels(df, "v").collect()}
    assert got == {D: (1, False), E: (2, True), "Unknown": (3, True)}


def replayed_draws(users, replicates, seed, block_users):
    """Times per replicate and user, drawn as the operator defines it, from the full list of users."""
    digest = lambda *parts: int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[: sensitivity.HASH_DIGITS], 16)
    users = sorted(users, key=lambda u: (hashlib.md5(u.encode()).hexdigest(), u))
    out = []
    for r in range(replicates):
        times = Counter()
        for block, draws in Counter(digest(r, i) % len(users) // block_users for i in range(len(users))).items():
            own = users[block * block_users : (block + 1) * block_users]
            times.update(own[digest(r, block, k) % len(own)] for k in range(draws))
        out.append(times)
    return out


def test_bootstrap(spark):
    """Every replicate draws as many users as there are, with replacement; the effects are those of the drawn users' paths."""
    users = [("u1", [S, E, K]), ("u1", [S, D, N]), ("u2", [S, E, N]), ("u3", [S, D, K])] + [(f"v{i}", [S, E, K] if i % 2 else [S, D, N]) for i in range(60)]
    df = spark.createDataFrame(users, "user_pseudo_id string, path array<string>")
    rows = sorted(tuple(r) for r in sensitivity.bootstrap(df, 40, seed=7, block_users=16).collect())
    assert rows == sorted(tuple(r) for r in sensitivity.bootstrap(df.repartition(7), 40, seed=7, block_users=16).collect())
    names = {u for u, _ in users}
    for r, times in enumerate(replayed_draws(names, 40, 7, 16)):
        own = [x for x in rows if x[0] == r]
        assert sum(times.values()) == len(names) and {x[1:3] for x in own} == {(len(names), len(times))}
        pairs = Counter()
        for u, p in users:
            for e in zip(p, p[1:], strict=False):
                pairs[e] += times[u]
        src, dst, n = zip(*((*e, k) for e, k in pairs.items() if k), strict=True)
        want = {x[0]: x[4] for x in markov.Chain.of(list(src), list(dst), list(n)).effects()}
        assert {x[3]: x[4] for x in own} == pytest.approx(want)
    draws = sensitivity.bootstrap(df, 40, seed=7, block_users=16)
    effects = markov.removal_effects(markov.edges(df.withColumn("scenario", F.lit("b")), ("scenario",)), "scenario")
    got = {r["channel"]: r for r in sensitivity.bootstrap_summary(draws, effects).collect()}
    assert got[E]["mean_share"] == pytest.approx(np.mean([x[5] for x in rows if x[3] == E]))
    assert abs(got[E]["mean_share"] - got[E]["baseline_share"]) < 3 * got[E]["share_stddev"]
    assert got[E]["attempted_replicates"] == got[E]["successful_replicates"] + got[E]["failed_replicates"]


def test_reachability_finds_a_trapped_state(spark):
    edges = [("a", S, E, 5), ("a", E, K, 1), ("a", E, D, 1), ("a", D, D, 3), ("b", S, E, 1), ("b", E, N, 1), ("b", D, K, 0)]
    rows = {tuple(r) for r in markov.reachability(spark.createDataFrame(edges, "scenario string, src string, dst string, n long"), "scenario").collect()}
    assert rows == {("a", S, True, False, False), ("a", E, True, False, False), ("a", D, False, False, True), ("a", K, True, False, False), ("a", N, False, True, False),
                    ("b", S, False, True, False), ("b", E, False, True, False), ("b", K, True, False, False), ("b", N, False, True, False)}
    with pytest.raises(ValueError):
        markov.Chain.of([S, E, E, D], [E, K, D, D], [5, 1, 1, 3])


def test_rank_stability_keeps_channels_that_one_side_lacks(spark):
    row = lambda scenario, view, model, channel, share: (scenario, view, model, channel, share)
    results = [row("baseline", "baseline", "Linear", E, 0.6), row("baseline", "baseline", "Linear", D, 0.4), row("lookback_1d", "population_impact", "Linear", D, 1.0), row("baseline", "common_cohort", "Linear", E, 1.0), row("lookback_1d", "common_cohort", "Linear", E, 0.5), row("lookback_1d", "common_cohort", "Linear", "Other", 0.5)]
    df = spark.createDataFrame(results, "scenario string, cohort_view string, model string, channel string, conversion_share double")
    got = {(r["cohort_view"], r["channel"]): r for r in sensitivity.rank_stability(df).collect()}
    pick = lambda *k: tuple(got[k][c] for c in ("baseline_share", "scenario_share", "baseline_rank", "scenario_rank", "spearman_rank_correlation", "scenario_is_tied"))
    assert pick("population_impact", E) == (0.6, 0.0, 1, 2, -1.0, False)
    assert pick("population_impact", D) == (0.4, 1.0, 2, 1, -1.0, False)
    assert pick("common_cohort", "Other") == (0.0, 0.5, 2, 2, 1.0, True)
    assert len(got) == 4


def test_median_of_counts(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 5, 3), ("b", 2, 1), ("c", 1, 1), ("c", 4, 9)], "g string, v long, n long")
    assert {tuple(r) for r in sensitivity.median_of_counts(df, "v", "n", "g").collect()} == {("a", 3.0), ("b", 2.0), ("c", 4.0)}


def test_registered_bootstrap_draws_500_replicates(spark, sf):
    from creditflow.plans import composite  # noqa: F401  registers the queries
    from creditflow.plans.registry import QUERIES

    assert QUERIES["bootstrap_user_cluster"](spark, sf).select("replicate").distinct().count() == 500
    assert {r["attempted_replicates"] for r in QUERIES["bootstrap_summary"](spark, sf).collect()} == {500}


def test_bootstrap_keeps_inactive_channels_and_failures(spark):
    users = [("u1", [S, "Other", N]), ("u2", [S, E, K]), ("u3", [S, E, N]), ("u4", [S, E, K])]
    rows = sensitivity.bootstrap(spark.createDataFrame(users, "user_pseudo_id string, path array<string>"), 25, seed=7).collect()
    assert any(r["channel"] == "Other" and r["removal_effect"] == 0 for r in rows)
    assert len({r["replicate"] for r in rows}) == 25


BASE = "event_id long, event_ts timestamp_ntz, event_name string, user_pseudo_id string, session_key string, transaction_id string, purchase_revenue_in_usd double"


def test_orders(spark):
    t = lambda m: datetime(2024, 1, 2, 10, m)
    rows = [(1, t(1), "purchase", "u", None, " t1 ", 5.0), (2, t(2), "purchase", "u", "k", "t1", 7.0), (3, t(3), "purchase", "u", "k", "(NOT SET)", 1.0), (4, t(3), "purchase", "u", "k", " ", 1.0), (5, t(3), "purchase", None, None, "t2", 1.0), (6, t(2), "purchase", "u", "k2", "t3", 1.0)]
    got = {r["transaction_id"]: r for r in staging.order_cycles(staging.orders(spark.createDataFrame(rows, BASE))).collect()}
    assert set(got) == {"t1", "t3"}
    assert (got["t1"]["conversion_session_key"], got["t1"]["order_revenue_usd"], got["t1"]["duplicate_purchase_event_count"], got["t1"]["distinct_revenue_value_count"]) == ("k", 7.0, 1, 2)
    assert got["t3"]["previous_order_ts"] == t(1) and got["t1"]["previous_order_ts"] is None


def test_path_boundaries(spark):
    """An order at exactly the lookback, a session at exactly the order before, two orders in one session."""
    day = lambda d, h=0: datetime(2024, 1, d, h)
    cycles = spark.createDataFrame(
        [("o1", "u", day(10), "s2", 1.0, None), ("o2", "u", day(10, 1), "s2", 1.0, day(10)), ("o3", "u", day(20), "s9", 1.0, day(10, 1))],
        "order_key string, user_pseudo_id string, order_ts timestamp_ntz, conversion_session_key string, order_revenue_usd double, previous_order_ts timestamp_ntz",
    )
    rows = [("u", "s0", day(3)), ("u", "s1", day(2)), ("u", "s2", day(10)), ("u", "s3", day(10, 1))]
    s = spark.createDataFrame(rows, "user_pseudo_id string, session_key string, session_start_ts timestamp_ntz").withColumns({"channel": F.lit("Email"), "is_attribution_eligible": F.lit(True), "is_internal_admin_traffic": F.lit(False)})
    got = {(r["order_key"], r["session_key"]): r["touchpoint_eligibility_rule"] for r in paths.conversion_paths(cycles, s, DEFAULT).collect()}
    assert got == {("o1", "s0"): paths.STANDARD, ("o1", "s2"): paths.STANDARD, ("o2", "s2"): paths.EXCEPTION, ("o2", "s3"): paths.STANDARD}
    strict = {(r["order_key"], r["session_key"]) for r in paths.conversion_paths(cycles, s, DEFAULT, strict=True).collect()}
    assert strict == set(got) - {("o2", "s2")}


def test_channels(spark):
    rows = [
        ("event_level_source", "google", "cpc", None, None, False, "Paid Search"),
        ("event_level_source", "facebook.com", "CPC", "facebook.com", "facebook.com", False, "Paid Social"),
        ("event_level_source", "x", "paid-social", None, None, False, "Paid Social"),
        ("event_level_source", "pinterest.de", None, "pinterest.de", "pinterest.de", False, "Organic Social"),
        ("event_level_source", "c", "referral", "creatoracademy.youtube.com", "youtube.com", False, "Referral"),
        ("event_level_source", None, "(none)", None, None, False, "Direct"),
        ("event_level_source", "a", "weird", None, None, False, "Other"),
        ("Unknown", None, None, None, None, False, "Unknown"),
        ("external_referrer", "h", "organic", "h", None, False, "Organic Search"),
        ("event_level_source", "a", "email", None, None, True, "Internal/Admin"),
    ]
    df = spark.createDataFrame(rows, "t string, s string, m string, h string, d string, a boolean, want string")
    got = df.select("want", sessions.channel(F.col("a"), *[F.col(x) for x in "tsmhd"])["channel"].alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_internal_evidence_of_all_nulls(spark):
    t = datetime(2024, 1, 1)
    names = ["event_source", "event_medium", "event_campaign", "first_user_source", "first_user_medium", "first_user_campaign", "page_referrer", "page_referrer_host", "page_referrer_domain"]
    row = ("u", 1, "k", t, "page_view", *[None] * 9)
    df = spark.createDataFrame([row], "user_pseudo_id string, ga_session_id long, session_key string, event_ts timestamp_ntz, event_name string, " + ", ".join(f"{n} string" for n in names))
    r = sessions.resolve_sources(sessions.session_evidence(df, DEFAULT), DEFAULT).first()
    assert (r["source_resolution_tier"], r["source_quality"], r["internal_storefront_evidence_type_count"]) == ("Unknown", "missing", None)


def test_journey_boundaries(spark):
    s = Settings(boundary_end=datetime(2024, 1, 10))
    day = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [("u", "a", day(1), day(1, 1)), ("u", "b", day(2, 1), day(2, 2)), ("u", "c", day(3), day(3, 1)), ("v", "d", day(9), day(9)), ("w", "e", day(5), day(5))]
    t = spark.createDataFrame(rows, "user_pseudo_id string, session_key string, session_start_ts timestamp_ntz, session_end_ts timestamp_ntz")
    t = t.withColumns({"channel": F.lit("Email"), "mapping_version": F.lit("1"), "is_attribution_eligible": F.lit(True), "is_internal_admin_traffic": F.lit(False)})
    orders = spark.createDataFrame([("w", day(6))], "user_pseudo_id string, order_ts timestamp_ntz")
    j = paths.segmented_journeys(t, orders, 86_400)
    # b begins exactly one day after a's end: a new journey; c is within a day of b
    assert sorted(r["session_key_path"] for r in j.where("user_pseudo_id = 'u'").collect()) == [["a"], ["b", "c"]]
    got = {r["user_pseudo_id"]: r["journey_status"] for r in paths.nonconverting(j, s, 86_400).collect()}
    # v expires exactly at the boundary: censored; w buys exactly at its expiry: neither
    assert got == {"u": "Null", "v": "Right Censored"}


def test_funnel_problems(spark):
    ok = spark.createDataFrame([(O, 100, 0.5, 0.2, 0.1, 0.05), ("Referral", 50, 0.4, 0.15, 0.08, 0.04)], ["channel", "sessions", *[f"{e}_rate" for e in reporting.FUNNEL_EVENTS]])
    assert reporting.funnel_problems(ok).agg(F.sum("violations")).first()[0] == 0
    bad = ok.withColumn("purchase_rate", F.lit(1.01))
    assert reporting.funnel_problems(bad).where("check = 'rates_out_of_range'").first()["violations"] == 2
    with pytest.raises(ValueError):
        reporting.funnel_problems(ok.drop("sessions"))


def test_path_length_bins(spark):
    df = spark.createDataFrame([("PATH_LENGTH", 1, 70), ("PATH_LENGTH", 2, 20), ("PATH_LENGTH", 12, 10), ("OVERALL", 1, 100)], "summary_type string, sort_order long, attributable_conversions long")
    got = {r["bin"]: (r["conversions"], r["share"]) for r in reporting.path_length_bins(df).collect()}
    assert got == {"1": (70, 0.7), "2": (20, 0.2), "10+": (10, 0.1)}


def test_sums_that_differ_by_rounding_alone_are_ranked_by_path(spark):
    # 0.2 + 0.2 + 0.2 is greater than 0.6 as doubles; both paths have three orders and the same revenue.
    orders = [("a", "Zeta", 0.2), ("b", "Zeta", 0.2), ("c", "Zeta", 0.2), ("d", "Alpha", 0.6), ("e", "Alpha", 0.0), ("f", "Alpha", 0.0)]
    paths = spark.createDataFrame([(k, c, r, 1, 1) for k, c, r in orders], "order_key string, channel string, order_revenue_usd double, path_length long, touchpoint_number long")
    rows = reporting.journey_summary(paths, DEFAULT).where("summary_type = 'CONVERTING_PATH'").orderBy("sort_order").collect()
    assert [(r["dimension_key"], r["sort_order"]) for r in rows] == [("Alpha", 1), ("Zeta", 2)]
    assert [r["dimension_key"] for r in reporting.top_paths(paths).orderBy("sort_order").collect()] == ["Alpha", "Zeta"]


def test_reconcile_and_checks(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", None)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-12), ("y", 2.1), ("w", 1.0), ("z", None)], "k string, v double")
    assert {r["k"] for r in validation.reconcile(a, b, ["k"], {"v": 1e-9}).collect()} == {"y", "w"}
    results = validation.run_checks([validation.Check("none", a.where("v < 0")), validation.Check("some", a.where("v > 1"))])
    assert {r["check_id"]: r["status"] for r in results.collect()} == {"none": "PASS", "some": "FAIL"}
    with pytest.raises(AssertionError):
        validation.require(results)


def test_writers_and_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1, 2]), (2, "b", None)], "a int, b string, c array<int>")
    writers.save(df, f"{tmp_path}/t", cluster=["a"])
    with pytest.raises(Exception, match="(?i)exists"):
        writers.save(df, f"{tmp_path}/t")
    writers.save_chunks([df, df], f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 4
    assert writers.save_rows(spark, [(1, "x")], "n int, s string", f"{tmp_path}/r") == 1
    writers.save_csv(df, f"{tmp_path}/csv", ["a"])
    back = readers.read_csv(spark, f"{tmp_path}/csv").orderBy("a").collect()
    assert [r["a"] for r in back] == ["1", "2"] and back[0]["c"] == "[1,2]" and back[0]["b"] is None
    assert readers.snapshot(df).first()["rows"] == 2
    assert ("c", "array<int>") in readers.field_paths(df.schema)


def test_materialise_resumes(spark, sf, tmp_path):
    assert Run(spark, sf).materialise(str(tmp_path), "create") == list(Run.TABLES)
    again = Run(spark, sf)
    assert again.materialise(str(tmp_path)) == [] and again.results.count() > 0


def test_streamed_sessions(spark, sf, tmp_path):
    from creditflow.streaming import ingest

    events = spark.read.parquet(f"{sf}/events.parquet")
    late = events.limit(1).withColumn("ts", F.lit(datetime(2030, 1, 1)).cast("timestamp_ntz"))  # moves the watermark past all
    events.write.parquet(f"{tmp_path}/in")
    stream = ingest.streamed_sessions(ingest.stream_events(spark, f"{tmp_path}/in", events.schema))
    ingest.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    late.write.mode("append").parquet(f"{tmp_path}/in")
    ingest.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out").agg(F.sum("events").alias("n")).first()["n"]
    assert got == events.count()


def test_registered_domains(spark, tmp_path):
    urls = {
        "http://a.b.com.cn/x": "b.com.cn", "com.cn": None, "me.github.io/p?q": "me.github.io", "github.io": None, "https://192.168.1.1:8080/": None, "www.Shop.co.uk": "shop.co.uk", "//user@shop.example:80/x": "shop.example",
        "a.b.c.ck": "b.c.ck", "c.ck": None, "x.www.ck": "www.ck", "localhost/x": None, "a..com": None, "no host here": None, "": None,
    }
    got = spark.createDataFrame(list(urls.items()), "url string, want string").select("url", "want", C.url_host(F.col("url")).alias("host"), C.reg_domain(C.url_host(F.col("url")), DEFAULT.public_suffixes).alias("got"))
    assert [(r.url, r.got) for r in got.collect()] == [(r.url, r.want) for r in got.collect()]
    joined = domains.registered_domains(got, domains.rules_table(spark, DEFAULT.public_suffixes))
    assert [(r.url, r.domain) for r in joined.collect() if r.domain != r.want] == []
    path = tmp_path / "rules.dat"
    path.write_text("// rules\n\ncom\n*.kawasaki.jp\n!city.kawasaki.jp\n\u516c\u53f8.cn\nlong.one.example // note\n", encoding="utf-8")
    rules = readers.suffix_rules(str(path))
    assert "xn--55qx5d.cn" in rules and len(rules) == 6
    hosts = {"a.b.kawasaki.jp": "a.b.kawasaki.jp", "b.kawasaki.jp": None, "x.city.kawasaki.jp": "city.kawasaki.jp", "a.b.long.one.example": "b.long.one.example", "a.xn--55qx5d.cn": "a.xn--55qx5d.cn", "a.b.com": "b.com", "10.0.0.1": None, None: None}
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", C.reg_domain(F.col("h"), rules).alias("d")).collect()
    assert {r.h: r.d for r in rows} == hosts
    assert spark.createDataFrame([("a.b.co.uk",)], "h string").select(C.reg_domain(F.col("h"), ()).alias("d")).first().d == "co.uk"


def test_schema_audit(spark):
    from creditflow.operators import audits

    shards = {"e1": spark.createDataFrame([], "a int, p struct<x:string>"), "e2": spark.createDataFrame([], "a long"), "e3": spark.createDataFrame([], "a int, b int"), "other": spark.createDataFrame([], "a int")}
    rows = audits.schema_audit(readers.catalog_fields(spark, shards), ["e1", "e2", "e3"]).collect()
    got = {(r.field_path, r.data_type): (r.top_level_column, r.shards_containing_field, r.first_table, r.last_table, r.selected_shard_count, r.present_in_all_shards) for r in rows}
    assert got[("a", "int")] == ("a", 2, "e1", "e3", 3, False) and got[("a", "bigint")] == ("a", 1, "e2", "e2", 3, False)
    assert got[("p.x", "string")][0] == "p" and len(got) == 5


def test_shared_tables_outlive_a_cleared_cache(spark, sf):
    run = Run.shared(spark, sf)
    before = run.sessions.inputFiles()
    spark.catalog.clearCache()
    plan = run.results._jdf.queryExecution().executedPlan().toString()
    assert run.sessions.inputFiles() == before and "Exchange" not in plan and "FileScan parquet" in plan
    run.release()
    assert Run.shared(spark, sf) is not run and Run.shared(spark, sf).sessions.inputFiles() != before
