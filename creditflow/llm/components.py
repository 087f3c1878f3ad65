"""Connected components of a table of links, by minimum labels, hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditflow.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (x, label): every linked node with the smallest node that it reaches.

    Each round a node takes its label's label, then the smallest among its own and its neighbours'; the node that it
    had as label takes that too, so whole trees are hooked at once and long chains need few rounds.  Rounds go on until
    no label changes; labels only fall, so that ends.
    Labels are written to the shared folder each round; both sides of a join are read from files, so that Spark
    can split a node with very many links.  No link and no label comes to the driver, only their checksum.
    Null ends are dropped; repeated links and loops do no harm; no links give no rows.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    edges = written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    seen = None
    while True:
        jumped = labels.alias("l").join(labels.alias("r"), F.col("l.label") == F.col("r.x")).select(F.col("l.x").alias("x"), F.col("r.label").alias("label"))
        jumped = written(jumped, "labels")
        met = edges.join(jumped, "x").groupBy(F.col("y").alias("x")).agg(F.min("label").alias("least"))
        met = jumped.join(met, "x").select(F.explode(F.array("x", "label")).alias("x"), F.least("label", "least").alias("label"))
        labels = written(met.groupBy("x").agg(F.min("label").alias("label")), "labels")
        now = tuple(labels.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("decimal(38,0)"))).first())
        if now == seen:
            return labels
        seen = now
