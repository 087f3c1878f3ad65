"""First-order absorbing Markov chains over channel paths.

Edges are counted on Spark.  A chain has a state per channel and three more, so what is solved is a matrix of a few
states per scenario; it is solved where Spark puts the scenario's edges.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditflow.functions.columns import adjacent_pairs, divide
from creditflow.settings import CONVERSION, NULL, START

TOLERANCE = 1e-12


def full_paths(journeys: DataFrame, path: str = "channel_path") -> DataFrame:
    """Included journeys as path arrays from Start to their outcome."""
    return journeys.where("is_markov_included").withColumn("path", F.concat(F.array(F.lit(START)), F.col(path), F.array(F.col("outcome_state"))))


def edges(paths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., src, dst, n): counts of neighbours, self-loops too."""
    pairs = paths.select(*by, F.explode(adjacent_pairs(F.col("path"))).alias("e"))
    return pairs.groupBy(*by, F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def invalid_paths(paths: DataFrame) -> DataFrame:
    """Paths that do not begin at Start, do not end in an outcome, or hold one of these in between."""
    p, n = F.col("path"), F.size("path")
    inner = F.slice(p, F.lit(2), F.greatest(n - 2, F.lit(0)))
    bad = (n < 2) | (F.get(p, F.lit(0)) != START) | ~F.get(p, n - 1).isin(CONVERSION, NULL) | F.exists(inner, lambda x: x.isin(START, CONVERSION, NULL))
    return paths.where(F.coalesce(bad, F.lit(True)))


@dataclass
class Chain:
    """Counts and row-normalised probabilities over (Start, channels in order, Conversion, Null)."""

    states: list[str]
    counts: np.ndarray
    probabilities: np.ndarray

    @classmethod
    def of(cls, src: list[str], dst: list[str], n: list[int]) -> Chain:
        channels = sorted({*src, *dst} - {START, CONVERSION, NULL})
        states = [START, *channels, CONVERSION, NULL]
        at = {s: i for i, s in enumerate(states)}
        counts = np.zeros((len(states), len(states)), dtype="int64")
        np.add.at(counts, ([at[s] for s in src], [at[d] for d in dst]), n)
        return cls(states, counts, cls._normalised(states, counts)).checked()

    @staticmethod
    def _normalised(states: list[str], counts: np.ndarray) -> np.ndarray:
        mass = counts.sum(axis=1, keepdims=True)
        p = np.divide(counts, mass, out=np.zeros(counts.shape), where=mass > 0)
        for name in (CONVERSION, NULL):
            p[states.index(name), states.index(name)] = 1.0
        return p

    def reaching(self) -> set[str]:
        """States from which an absorbing state can be reached."""
        seen = {len(self.states) - 2, len(self.states) - 1}
        while more := {int(i) for i in np.flatnonzero((self.probabilities[:, sorted(seen)] > 0).any(axis=1))} - seen:
            seen |= more
        return {self.states[i] for i in seen}

    def checked(self) -> Chain:
        if START not in self.states or self.probabilities[0].sum() == 0:
            raise ValueError("no path leaves Start")
        if np.abs(self.probabilities.sum(axis=1) - 1).max() > TOLERANCE:
            raise ValueError("a state has no way out or its row does not sum to one")
        if lost := set(self.states) - self.reaching():
            raise ValueError(f"no absorbing state is reached from {sorted(lost)}")
        return self

    def conversion_probability(self) -> float:
        """(I - Q) x = r, taken at Start."""
        k = len(self.states) - 2
        x = float(np.linalg.solve(np.eye(k) - self.probabilities[:k, :k], self.probabilities[:k, k])[0])
        if not -TOLERANCE <= x <= 1 + TOLERANCE:
            raise ValueError(f"absorption probability {x}")
        return min(max(x, 0.0), 1.0)

    def without(self, channel: str) -> Chain:
        """The channel's row and column dropped; what led to it leads to Null; nothing is renormalised."""
        if channel not in self.states[1:-2]:
            raise ValueError(f"{channel} is no channel of this chain")
        i = self.states.index(channel)
        counts, p = self.counts.copy(), self.probabilities.copy()
        for m in (counts, p):
            m[:, -1] += m[:, i]
        keep = [j for j in range(len(self.states)) if j != i]
        return Chain([self.states[j] for j in keep], counts[np.ix_(keep, keep)], p[np.ix_(keep, keep)]).checked()

    def effects(self) -> list[tuple[str, float, float, float, float]]:
        """(channel, base, probability without it, raw effect, removal effect); what rounding makes negative is 0."""
        base = self.conversion_probability()
        if base <= TOLERANCE:
            raise ValueError("the chain never converts")
        out = []
        for c in self.states[1:-2]:
            rest = self.without(c).conversion_probability()
            raw = 1 - rest / base
            out.append((c, base, rest, raw, 0.0 if -TOLERANCE <= raw < 0 else raw))
        return out


def normalised(effects: dict[str, float]) -> dict[str, float]:
    """Shares of the effects; errors on what cannot be shared."""
    if not effects or not all(np.isfinite(list(effects.values()))):
        raise ValueError("effects must be finite and not empty")
    if min(effects.values()) < -TOLERANCE:
        raise ValueError("an effect is negative")
    clean = {k: max(v, 0.0) for k, v in effects.items()}
    total = sum(clean.values())
    if total <= TOLERANCE:
        raise ValueError("no effect to share")
    return {k: v / total for k, v in clean.items()}


def transition_matrix(edge_counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The dense grid of states with counts and probabilities, absorbing states looping on themselves."""
    states = edge_counts.select(*by, F.explode(F.array("src", "dst")).alias("state")).distinct()
    ends = edge_counts.select(*by).distinct().select(*by, F.explode(F.array(F.lit(START), F.lit(CONVERSION), F.lit(NULL))).alias("state")) if by else None
    if ends is None:
        ends = edge_counts.sparkSession.createDataFrame([(START,), (CONVERSION,), (NULL,)], "state string")
    states = states.unionByName(ends).distinct()
    src, dst = states.withColumnRenamed("state", "src"), states.withColumnRenamed("state", "dst")
    grid = src.join(dst, list(by)) if by else src.crossJoin(F.broadcast(dst))  # states are channels: a few tens
    rows = grid.join(edge_counts, [*by, "src", "dst"], "left").fillna(0, ["n"])
    absorbing = F.col("src").isin(CONVERSION, NULL)
    p = F.when(absorbing, F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0)).otherwise(F.coalesce(divide(F.col("n"), F.sum("n").over(Window.partitionBy(*by, "src"))), F.lit(0.0)))
    return rows.withColumn("probability", p).withColumn("is_absorbing", absorbing)


def removal_effects(edge_counts: DataFrame, by: str) -> DataFrame:
    """by, channel, base and reduced probability, raw and adjusted effect, share: one chain per value of ``by``.

    A group is one chain's edges, at most states squared rows.  ``is_adjusted``: the raw effect was negative within the
    tolerance of floating point and is taken as 0; a materially negative one is an error, as it can't be shared.
    """
    names = ("channel", "base_probability", "probability_without", "raw_removal_effect", "removal_effect")

    def solve(key: tuple, e: pd.DataFrame) -> pd.DataFrame:
        rows = Chain.of(e["src"].to_list(), e["dst"].to_list(), e["n"].to_list()).effects()
        shares = normalised({r[0]: r[4] for r in rows})
        return pd.DataFrame([(*key, *r, r[3] != r[4], r[4] < -TOLERANCE, shares[r[0]]) for r in rows], columns=[by, *names, "is_adjusted", "is_materially_negative", "attribution_share"])

    kind = edge_counts.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, channel string, " + ", ".join(f"{n} double" for n in names[1:]) + ", is_adjusted boolean, is_materially_negative boolean, attribution_share double"
    return edge_counts.groupBy(by).applyInPandas(solve, schema)


def reachability(edge_counts: DataFrame, by: str) -> DataFrame:
    """by, state, reaches_conversion, reaches_null, is_trapped: which outcomes each state of each chain can come to.

    The edges of a chain, at most states squared, are one array; the states that reach an outcome grow backwards along
    them, as many steps as there are states, inside one expression.
    """
    chains = edge_counts.where("n > 0").groupBy(by).agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    ends = F.array(F.lit(START), F.lit(CONVERSION), F.lit(NULL))
    chains = chains.withColumn("states", F.array_union(F.array_union(F.transform("edges", lambda x: x["src"]), F.transform("edges", lambda x: x["dst"])), ends))

    def reaching(outcome: str):
        step = lambda seen, _: F.array_union(seen, F.transform(F.filter("edges", lambda x: F.array_contains(seen, x["dst"])), lambda x: x["src"]))
        return F.aggregate(F.col("states"), F.array(F.lit(outcome)), step)

    rows = chains.select(by, "states", reaching(CONVERSION).alias("c"), reaching(NULL).alias("z")).select(by, "c", "z", F.explode("states").alias("state"))
    found = rows.select(by, "state", F.array_contains("c", F.col("state")).alias("reaches_conversion"), F.array_contains("z", F.col("state")).alias("reaches_null"))
    return found.withColumn("is_trapped", ~F.col("reaches_conversion") & ~F.col("reaches_null"))


def markov_attribution(effects: DataFrame, journeys: DataFrame) -> DataFrame:
    """Shares of all conversions and revenue of the included conversion journeys."""
    totals = journeys.where((F.col("outcome_state") == CONVERSION) & F.col("is_markov_included")).agg(F.count(F.lit(1)).alias("conversions"), F.sum("attributable_revenue_usd").alias("revenue"))
    rows = effects.crossJoin(F.broadcast(totals))  # one row
    return rows.withColumns({"attributed_conversions": F.col("conversions") * F.col("attribution_share"), "attributed_revenue": F.col("revenue") * F.col("attribution_share")}).drop("conversions", "revenue")
