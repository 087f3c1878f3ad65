"""A whole run: every table of the model, each built once from the ones before.

``Run`` builds lazily; ``materialise`` writes the tables in order and lets a later call of the same settings and input
resume after the last complete one.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditflow.operators import attribution, markov, paths, sensitivity, sessions, staging
from creditflow.operators.scan import long_keys
from creditflow.plans import manifest
from creditflow.settings import DEFAULT, Settings
from creditflow.sources.buckets import scratch_bucketed as buckets_of
from creditflow.sources.readers import table
from creditflow.sources.web_events import web_events
from creditflow.sources.writers import scratch
from creditflow.workers import reachable


class Run:
    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT, raw: DataFrame | None = None):
        self.spark, self.sf_dir, self.s, self._raw = reachable(spark), sf_dir, settings, raw
        self._stored: dict[str, DataFrame] = {}

    _shared: dict[tuple[int, str], Run] = {}
    #: What paths are numbered by; with the user in front, tables bucketed by user need no shuffle for it either.
    path_keys: tuple[str, ...] = ("order_key",)
    #: Tables that several others read; a shared run stores each once, so that plans stay short and nothing is built twice.
    KEPT = (
        "event_base", "orders", "sources", "sessions", "cycles", "path_rows", "coverage", "results", "journeys", "short_null", "effects",
        "scenario_paths", "scenario_edges", "scenarios", "metrics", "lookback", "sensitivity", "bootstrap_draws",
    )

    #: Those that a shared run stores in buckets by user, as long as no user has so many events that a bucket would be one user's:
    #: events are shuffled by user once, and whatever goes along users or orders after that is not.
    OF_USERS = ("event_base", "orders", "sources", "sessions", "cycles", "path_rows", "coverage", "results")

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str) -> Run:
        """One run per session and folder, whose shared tables are stored in the folder that the machines share.

        They are files, not cached blocks: a cleared cache or a lost executor costs none of them.
        """
        key = (id(spark), sf_dir)
        if key not in cls._shared:
            cls._shared[key] = cls(spark, sf_dir)
            if cls._shared[key].by_user:
                cls._shared[key].path_keys = paths.ORDER
        return cls._shared[key]

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        if name in Run.KEPT and Run._shared.get((id(self.spark), self.sf_dir)) is self:
            if name not in self._stored:
                if name in Run.OF_USERS and self.by_user:
                    self._stored[name] = buckets_of(value, name, ["user_pseudo_id"], int(self.spark.conf.get("spark.sql.shuffle.partitions")))
                else:
                    path = scratch(self.spark, name)
                    value.write.option("compression", "zstd").parquet(path)
                    self._stored[name] = self.spark.read.schema(value.schema).parquet(path)
            return self._stored[name]
        return value

    def release(self) -> None:
        """Forget the stored tables; the next shared run builds its own."""
        self._stored.clear()
        Run._shared.pop((id(self.spark), self.sf_dir), None)

    @cached_property
    def by_user(self) -> bool:
        return long_keys(table(self.spark, self.sf_dir, "events"), ("user_id",)) is None

    @cached_property
    def raw(self) -> DataFrame:
        return web_events(table(self.spark, self.sf_dir, "events")) if self._raw is None else self._raw

    @cached_property
    def event_base(self) -> DataFrame:
        return staging.event_base(self.raw, self.s)

    @cached_property
    def orders(self) -> DataFrame:
        return staging.orders(self.event_base)

    @cached_property
    def cycles(self) -> DataFrame:
        return staging.order_cycles(self.orders)

    @cached_property
    def evidence(self) -> DataFrame:
        return sessions.session_evidence(self.event_base, self.s)

    @cached_property
    def sources(self) -> DataFrame:
        return sessions.resolve_sources(self.evidence, self.s)

    @cached_property
    def provisional_sources(self) -> DataFrame:
        return sessions.resolve_sources(self.sources.select(*sessions.EVIDENCE), self.s, provisional=True)

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions.touchpoints(self.sources, self.s)

    @cached_property
    def path_rows(self) -> DataFrame:
        return paths.path_rows(self.cycles, self.sessions, self.s, self.path_keys)

    @cached_property
    def strict(self) -> DataFrame:
        return paths.strict_paths(self.path_rows)

    @cached_property
    def revised(self) -> DataFrame:
        return paths.revised_paths(self.path_rows)

    @cached_property
    def coverage(self) -> DataFrame:
        return paths.order_coverage(self.cycles, self.sessions, self.strict, self.revised, self.s, self.path_keys == paths.ORDER)

    @cached_property
    def results(self) -> DataFrame:
        return attribution.attribution_results(self.revised, self.s, paths.ORDER)

    @cached_property
    def journeys(self) -> DataFrame:
        return paths.markov_journeys(self.sessions, self.orders, self.revised, self.s)

    @cached_property
    def short_null(self) -> DataFrame:
        return paths.short_null_journeys(self.sessions, self.orders, self.revised, self.s)

    @cached_property
    def markov_paths(self) -> DataFrame:
        return markov.full_paths(self.journeys)

    @cached_property
    def effects(self) -> DataFrame:
        return markov.removal_effects(markov.edges(self.markov_paths.withColumn("scenario", F.lit("baseline")), ("scenario",)), "scenario")

    @cached_property
    def markov_attribution(self) -> DataFrame:
        return markov.markov_attribution(self.effects, self.journeys)

    @cached_property
    def comparison(self) -> DataFrame:
        return attribution.rule_markov_comparison(self.results, self.markov_attribution)

    @cached_property
    def scenario_paths(self) -> DataFrame:
        return sensitivity.scenario_paths(self.journeys, self.short_null, self.revised, self.s)

    @cached_property
    def scenarios(self) -> DataFrame:
        return sensitivity.scenario_effects(self.scenario_edges)

    @cached_property
    def scenario_edges(self) -> DataFrame:
        return markov.edges(self.scenario_paths, ("scenario",))

    @cached_property
    def metrics(self) -> DataFrame:
        return sensitivity.path_metrics(self.scenario_paths)

    @cached_property
    def lookback(self) -> DataFrame:
        return sensitivity.lookback_results(self.revised, self.s, paths.ORDER)

    @cached_property
    def sensitivity(self) -> DataFrame:
        touchpoints, censored = sensitivity.channel_touchpoints(self.scenario_edges), sensitivity.censored_journeys(self.journeys, self.short_null)
        return sensitivity.sensitivity_results(self.lookback, self.scenarios, self.metrics, touchpoints, censored, self.s)

    @cached_property
    def bootstrap_draws(self) -> DataFrame:
        return sensitivity.bootstrap(self.markov_paths)

    TABLES = tuple(manifest.STEPS)

    def keys(self) -> dict[str, str]:
        """Of the tables that this run would write."""
        source = manifest.input_key(self.spark, f"{self.sf_dir}/events.parquet") if self._raw is None else manifest.frame_key(self._raw)
        return manifest.keys(self.s, source)

    def preflight(self, folder: str) -> dict[str, str]:
        """What is under ``folder`` of this very run: complete, stale or missing, per table; nothing is built."""
        return manifest.states(self.spark, folder, self.keys())

    def materialise(self, folder: str, mode: str = "resume") -> list[str]:
        """Write the tables under ``folder`` in order; complete ones of the same settings and input are read instead.

        ``mode`` as in ``manifest.to_build``.  A table's key is written last, so one that was cut off is not complete.
        """
        wanted = self.keys()
        build = manifest.to_build(manifest.states(self.spark, folder, wanted), mode)
        for name in self.TABLES:
            path = f"{folder}/{name}"
            if name in build:
                getattr(self, name).write.mode("overwrite").parquet(path)
                manifest.written(self.spark, folder, name, wanted[name])
            self._stored[name] = self.__dict__[name] = self.spark.read.parquet(path)
        return build

    def stored_by_user(self, buckets: int) -> Run:
        """A run whose orders and sessions are tables bucketed by user: what joins them by user needs no shuffle."""
        other = Run(self.spark, self.sf_dir, self.s, self._raw)
        other.__dict__["event_base"] = self.event_base
        for name in ("cycles", "sessions"):
            other.__dict__[name] = buckets_of(getattr(self, name), name, ["user_pseudo_id"], buckets)
        other.path_keys = paths.ORDER
        return other
