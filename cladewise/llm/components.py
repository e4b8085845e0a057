"""Connected components of a table of links, by labels that spread and shortcuts along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(skey, component) for every key in ``links`` (a, b); component is the smallest key of its component.

    In each round a key takes the smallest label among itself and its neighbours, and then the label of
    that label. Labels are sums over shuffles with partial minima, and every round is written to the
    shared folder; a key with very many links is one row of a partial minimum per task.
    """
    both = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(both.groupBy(F.col("a").alias("skey")).agg(F.least(F.min("b"), F.col("skey")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["skey"]).groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels["skey"] == near["a"]).select("skey", F.least("component", "near").alias("new"), F.col("component").alias("old"))
        spread = scratch.save(spread)
        above = spread.select(F.col("skey").alias("up"), F.col("new").alias("top"))
        jumped = spread.join(above, spread["new"] == above["up"], "left").select("skey", F.coalesce("top", "new").alias("component"), (F.coalesce("top", "new") != F.col("old")).alias("changed"))
        jumped = scratch.save(jumped)
        done = jumped.where("changed").limit(1).isEmpty()
        scratch.drop(labels, spread)
        labels = jumped.select("skey", "component")
        scratch.paths[id(labels)] = scratch.paths.pop(id(jumped))
        scratch._held.append(labels)
        if done:
            return labels
