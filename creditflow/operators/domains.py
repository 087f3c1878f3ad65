"""Registered domains by a whole public suffix list: every tail of a host is looked up in the list by one join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditflow.functions.columns import REGISTRABLE


def rules_table(spark: SparkSession, rules: tuple[str, ...]) -> DataFrame:
    """(rule): a list as a table; lists in other scripts come with their Punycode forms (``readers.suffix_rules``)."""
    return spark.createDataFrame([(r,) for r in sorted(set(rules))], "rule string")


def registered_domains(hosts: DataFrame, rules: DataFrame, host: str = "host", name: str = "domain") -> DataFrame:
    """``hosts`` with the public suffix of each host and one label more; null for a suffix alone or an IP address.

    Each distinct host is cut into its tails, as many as it has labels, and each tail asks for itself, for a wildcard over
    its parent and for an exception.  The list is the small side of an equi-join, whatever its length: Spark broadcasts it
    by its size.  An exception wins (its suffix lacks the first label), then the longest rule, then the top-level domain.
    """
    parts = F.split(F.col("h"), r"\.")
    n = F.size(parts)
    distinct = hosts.select(F.col(host).alias("h")).where(F.col("h").rlike(REGISTRABLE)).distinct()
    tails = distinct.select("h", F.explode(F.sequence(F.lit(1), n)).alias("depth"), parts.alias("parts"), n.alias("n"))
    tail = lambda k: F.array_join(F.slice("parts", -k, k), ".")
    ask = F.array(
        F.struct(tail(F.col("depth")).alias("rule"), F.lit(0).alias("kind")),
        F.when(F.col("depth") > 1, F.struct(F.concat(F.lit("*."), tail(F.col("depth") - 1)).alias("rule"), F.lit(0).alias("kind"))),
        F.struct(F.concat(F.lit("!"), tail(F.col("depth"))).alias("rule"), F.lit(1).alias("kind")),
    )
    asked = tails.select("h", "depth", F.explode(F.filter(ask, lambda a: a.isNotNull())).alias("a")).select("h", "depth", "a.rule", "a.kind")
    hit = asked.join(rules.select("rule").distinct(), "rule")
    best = hit.groupBy("h").agg(F.max(F.when(F.col("kind") == 1, F.col("depth") - 1)).alias("spared"), F.max(F.when(F.col("kind") == 0, F.col("depth"))).alias("longest"))
    found = distinct.join(best, "h", "left").withColumns({"parts": parts, "suffix": F.coalesce("spared", "longest", F.lit(1))})
    own = F.when(F.col("suffix") < F.size("parts"), F.array_join(F.slice("parts", -(F.col("suffix") + 1), F.col("suffix") + 1), "."))
    return hosts.join(found.select(F.col("h").alias(host), own.alias(name)), host, "left")
