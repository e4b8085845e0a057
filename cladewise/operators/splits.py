"""Aggregates over tree samples given as splits: (tree, split, d), one row per tree and internal edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import numbered


def consensus(splits: DataFrame, share: float = 0.5) -> DataFrame:
    """Splits of more than a share of the trees: (split, n, mean_d)."""
    m = splits.select("tree").distinct().agg(F.count("*").alias("m"))
    tally = splits.groupBy("split").agg(F.count("*").alias("n"), F.avg("d").alias("mean_d"))
    return tally.join(F.broadcast(m)).where(F.col("n") > share * F.col("m")).select("split", "n", "mean_d")


def length_table(splits: DataFrame) -> DataFrame:
    """(split, k, d): each split's lengths in order of tree, numbered from 0."""
    k = F.row_number().over(Window.partitionBy("split").orderBy("tree")) - 1
    return splits.select("split", k.cast("long").alias("k"), "d")


def topologies(splits: DataFrame) -> DataFrame:
    """(tree, topology): the sorted set of splits of positive length."""
    return splits.where("d > 0").groupBy("tree").agg(F.array_sort(F.collect_set("split")).alias("topology"))


def topology_rank(splits: DataFrame) -> DataFrame:
    """(topology, n, rank) by falling frequency; equal frequencies share a rank.

    Ranks are numbers of the distinct frequencies, of which m trees have fewer than the root of 2 m.
    """
    n = topologies(splits).groupBy("topology").agg(F.count("*").alias("n"))
    ranks = n.select("n").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"))).cast("long"))
    return n.join(F.broadcast(ranks), "n").select("topology", "n", "rank")


def same_topology_mean(splits: DataFrame) -> DataFrame:
    """(topology, split, n, mean_d): inside one topology the mean tree has the mean lengths."""
    s = splits.join(topologies(splits), "tree")
    return s.groupBy("topology", "split").agg(F.count("*").alias("n"), F.avg("d").alias("mean_d"))


def common_edges(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """(a, b, split, da, db) of edges that both trees of a pair have."""
    one = splits.select(F.col("tree").alias("a"), "split", F.col("d").alias("da"))
    two = splits.select(F.col("tree").alias("b"), "split", F.col("d").alias("db"))
    return pairs.join(one, "a").join(two, ["b", "split"]).select("a", "b", "split", "da", "db")


def edges_of_one(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """(a, b, split, da): edges of the first tree that the second lacks."""
    one = splits.select(F.col("tree").alias("a"), "split", F.col("d").alias("da"))
    two = splits.select(F.col("tree").alias("b"), "split")
    return pairs.join(one, "a").join(two, ["b", "split"], "left_anti").select("a", "b", "split", "da")


def compatible(a: Column, b: Column, leaves: int) -> Column:
    """Whether two splits, as masks of the side without leaf 0, can be in one tree."""
    whole = F.lit((1 << leaves) - 1)
    not_a, not_b = whole.bitwiseXOR(a), whole.bitwiseXOR(b)
    return (not_a.bitwiseAND(b) == 0) | (a.bitwiseAND(not_b) == 0) | (a.bitwiseAND(b) == 0)


def is_ancestor(a: Column, b: Column, leaves: int) -> Column:
    """Whether split a's side lies in neither side of split b: a is above b."""
    whole = F.lit((1 << leaves) - 1)
    return (a.bitwiseAND(b) != 0) & (a.bitwiseAND(whole.bitwiseXOR(b)) != 0)


def orthant_distance(splits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, distance): length of the path that shrinks edges of one tree only through the star and moves common ones straight."""
    both = common_edges(pairs, splits).groupBy("a", "b").agg(F.sum(F.pow(F.col("da") - F.col("db"), 2)).alias("s"))
    first = edges_of_one(pairs, splits).groupBy("a", "b").agg(F.sum(F.pow("da", F.lit(2))).alias("x"))
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    second = edges_of_one(back, splits).groupBy("a", "b").agg(F.sum(F.pow("da", F.lit(2))).alias("y")).select(F.col("b").alias("a"), F.col("a").alias("b"), "y")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    full = pairs.join(both, ["a", "b"], "left").join(first, ["a", "b"], "left").join(second, ["a", "b"], "left")
    return full.select("a", "b", F.sqrt(F.pow(F.sqrt(zero("x")) + F.sqrt(zero("y")), 2) + zero("s")).alias("distance"))


def distances_to(splits: DataFrame, centre: DataFrame) -> DataFrame:
    """(tree, sq): squared Euclidean distance of each tree's lengths to those of ``centre`` (split, mean_d), absent edges being 0."""
    own = splits.join(centre, "split", "left").groupBy("tree").agg(F.sum(F.pow(F.col("d") - F.coalesce("mean_d", F.lit(0.0)), 2) - F.pow(F.coalesce("mean_d", F.lit(0.0)), 2)).alias("part"))
    whole = centre.agg(F.coalesce(F.sum(F.pow("mean_d", F.lit(2))), F.lit(0.0)).alias("whole"))
    return own.join(F.broadcast(whole)).select("tree", (F.col("part") + F.col("whole")).alias("sq"))


def credibility_radius(distances: DataFrame, level: float) -> DataFrame:
    """The order statistic at ceil(n * level), at most the last, of column ``distance``."""
    n = distances.agg(F.count("*").alias("n"))
    ranked = numbered(distances, "k", "distance").withColumn("k", F.col("k") - 1)
    at = F.least(F.ceil(F.col("n") * level), F.col("n") - 1)
    return ranked.join(F.broadcast(n)).where(F.col("k") == at).select(F.col("distance").alias("radius"), "n")
