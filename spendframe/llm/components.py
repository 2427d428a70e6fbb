"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.llm import common


def components(links: DataFrame) -> DataFrame:
    """Every node of ``links`` (a, b: long, not null) with the smallest node it can reach: node, root.

    Each round a node takes the smallest label among its neighbours and then the label of that label, so
    rounds grow with the logarithm of the longest path. Minima are taken before the shuffle; the joins have
    one row per node on one side. Rounds are stored in the shared folder, and the last one stays. An empty table
    gives an empty table.
    """
    with common.Tables() as rounds:
        labels = settled(links)
    rounds.paths.pop()  # what is returned reads this one alone
    rounds.remove(links.sparkSession)
    return labels


def settled(links: DataFrame) -> DataFrame:
    both = common.stored(
        links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).filter("node <> other").distinct()
    )
    labels = common.stored(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("low"))
        lower = common.stored(labels.join(seen, "node").select("node", F.least("root", "low").alias("root"), F.col("root").alias("was")))
        far = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = common.stored(lower.join(far, "root", "left").select("node", F.coalesce("next", "root").alias("root"), "was"))
        labels = jumped.select("node", "root")
        if jumped.filter("root <> was").isEmpty():
            return labels
