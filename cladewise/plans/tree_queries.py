"""Queries on tree samples, splits and tree hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions import mathx
from cladewise.operators import splits as sp
from cladewise.registry import query

from . import bindings as b

r6 = lambda x: F.round(x, 6) + F.lit(0.0)
#: Share of trees at which the samples at hand, whose splits are many, have a consensus.
SHARE = 0.035


@query(f"WITH {b.SPLITS} SELECT split, count(*) AS n, round(avg(d), 6) AS mean_d FROM splits GROUP BY split HAVING count(*) > {SHARE} * (SELECT count(DISTINCT tree) FROM splits)")
def majority_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return sp.consensus(b.splits(spark, folder), SHARE).withColumn("mean_d", F.round("mean_d", 6))


@query(f"WITH {b.SPLITS} SELECT split, row_number() OVER (PARTITION BY split ORDER BY tree) - 1 AS k, d FROM splits")
def split_length_table(spark: SparkSession, folder: str) -> DataFrame:
    return sp.length_table(b.splits(spark, folder))


@query("""WITH l AS (SELECT l_linenumber AS leaf, l_orderkey AS tree, sum(l_quantity) AS d FROM lineitem GROUP BY ALL)
SELECT leaf, count(*) AS n, round(avg(d), 6) AS mean_d, min(d) AS min_d, max(d) AS max_d FROM l GROUP BY leaf""")
def leaf_length_table(spark: SparkSession, folder: str) -> DataFrame:
    x = b.table(spark, folder, "lineitem")
    leaves = x.groupBy(F.col("l_linenumber").alias("leaf"), "l_orderkey").agg(F.sum("l_quantity").alias("d"))
    return leaves.groupBy("leaf").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_d"), F.min("d").alias("min_d"), F.max("d").alias("max_d"))


_TOPOLOGY = "t AS (SELECT tree, string_agg(CAST(split AS VARCHAR), ',' ORDER BY split) AS topology FROM splits WHERE d > 0 GROUP BY tree)"


@query(f"WITH {b.SPLITS}, {_TOPOLOGY} SELECT topology, count(*) AS n, dense_rank() OVER (ORDER BY count(*) DESC) AS rank FROM t GROUP BY topology")
def topology_rank(spark: SparkSession, folder: str) -> DataFrame:
    return sp.topology_rank(b.splits(spark, folder)).select(F.array_join("topology", ",").alias("topology"), "n", "rank")


@query(f"WITH {b.SPLITS}, {_TOPOLOGY} SELECT topology, split, count(*) AS n, round(avg(d), 6) AS mean_d FROM splits JOIN t USING (tree) GROUP BY ALL")
def same_topology_mean(spark: SparkSession, folder: str) -> DataFrame:
    m = sp.same_topology_mean(b.splits(spark, folder))
    return m.select(F.array_join("topology", ",").alias("topology"), "split", "n", F.round("mean_d", 6).alias("mean_d"))


_PAIRS = "pairs AS (SELECT DISTINCT a.tree AS a, a.tree + 1 AS b FROM splits a WHERE a.tree + 1 IN (SELECT tree FROM splits))"


def _pairs(s: DataFrame) -> DataFrame:
    """Each tree with the one of the next number."""
    trees = s.select(F.col("tree").alias("a")).distinct()
    return trees.join(trees.select((F.col("a") - 1).alias("a")), "a", "left_semi").withColumn("b", F.col("a") + 1)


@query(f"WITH {b.SPLITS}, {_PAIRS} SELECT pairs.a, pairs.b, x.split, x.d AS da, y.d AS db FROM pairs JOIN splits x ON x.tree = a JOIN splits y ON y.tree = b AND y.split = x.split")
def common_edges(spark: SparkSession, folder: str) -> DataFrame:
    s = b.splits(spark, folder)
    return sp.common_edges(_pairs(s), s)


@query(f"WITH {b.SPLITS}, {_PAIRS} SELECT pairs.a, pairs.b, x.split, x.d AS da FROM pairs JOIN splits x ON x.tree = a ANTI JOIN splits y ON y.tree = b AND y.split = x.split")
def missing_edges(spark: SparkSession, folder: str) -> DataFrame:
    s = b.splits(spark, folder)
    return sp.edges_of_one(_pairs(s), s)


_MASKS = "m AS (SELECT l_orderkey AS tree, l_returnflag AS flag, bit_or(1 << (l_linenumber - 1)) AS mask FROM lineitem GROUP BY ALL)"


def _masks(spark: SparkSession, folder: str) -> DataFrame:
    x = b.table(spark, folder, "lineitem")
    bit = F.expr("shiftleft(1L, l_linenumber - 1)")
    return x.groupBy(F.col("l_orderkey").alias("tree"), F.col("l_returnflag").alias("flag")).agg(F.bit_or(bit).alias("mask"))


def _mask_pairs(spark: SparkSession, folder: str) -> DataFrame:
    m = _masks(spark, folder)
    two = m.select("tree", F.col("flag").alias("flag2"), F.col("mask").alias("mask2"))
    return m.join(two, "tree").where("flag < flag2")


@query(f"""WITH {_MASKS} SELECT x.tree, x.flag, y.flag AS flag2, ((127 - x.mask) & y.mask) = 0 OR (x.mask & (127 - y.mask)) = 0 OR (x.mask & y.mask) = 0 AS compatible
FROM m x JOIN m y ON x.tree = y.tree AND x.flag < y.flag""")
def split_compatibility(spark: SparkSession, folder: str) -> DataFrame:
    p = _mask_pairs(spark, folder)
    return p.select("tree", "flag", "flag2", sp.compatible(F.col("mask"), F.col("mask2"), 7).alias("compatible"))


@query(f"WITH {_MASKS} SELECT x.tree, x.flag, y.flag AS flag2 FROM m x JOIN m y ON x.tree = y.tree AND x.flag <> y.flag WHERE (x.mask & y.mask) <> 0 AND (x.mask & (127 - y.mask)) <> 0")
def ancestor_pairs(spark: SparkSession, folder: str) -> DataFrame:
    m = _masks(spark, folder)
    two = m.select("tree", F.col("flag").alias("flag2"), F.col("mask").alias("mask2"))
    p = m.join(two, "tree").where("flag <> flag2")
    return p.where(sp.is_ancestor(F.col("mask"), F.col("mask2"), 7)).select("tree", "flag", "flag2")


@query(f"WITH {_MASKS} SELECT tree, CAST(bit_or(mask) AS BIGINT) AS leaves, CAST(bit_count(bit_or(mask)) AS BIGINT) AS n_leaves FROM m GROUP BY tree")
def leaf_set_union(spark: SparkSession, folder: str) -> DataFrame:
    u = _masks(spark, folder).groupBy("tree").agg(F.bit_or("mask").alias("leaves"))
    return u.withColumn("n_leaves", F.bit_count("leaves").cast("long"))


@query(f"""WITH {b.SPLITS}, {_PAIRS},
c AS (SELECT pairs.a, pairs.b, sum((x.d - y.d) ** 2) AS s FROM pairs JOIN splits x ON x.tree = a JOIN splits y ON y.tree = b AND y.split = x.split GROUP BY ALL),
p AS (SELECT pairs.a, pairs.b, sum(x.d ** 2) AS s FROM pairs JOIN splits x ON x.tree = a ANTI JOIN splits y ON y.tree = b AND y.split = x.split GROUP BY ALL),
q AS (SELECT pairs.a, pairs.b, sum(x.d ** 2) AS s FROM pairs JOIN splits x ON x.tree = b ANTI JOIN splits y ON y.tree = a AND y.split = x.split GROUP BY ALL)
SELECT a, b, round(sqrt((sqrt(coalesce(p.s, 0)) + sqrt(coalesce(q.s, 0))) ** 2 + coalesce(c.s, 0)), 6) AS distance
FROM pairs LEFT JOIN c USING (a, b) LEFT JOIN p USING (a, b) LEFT JOIN q USING (a, b)""")
def same_orthant_distance(spark: SparkSession, folder: str) -> DataFrame:
    s = b.splits(spark, folder)
    return sp.orthant_distance(s, _pairs(s)).withColumn("distance", F.round("distance", 6))


_CENTRE = "centre AS (SELECT split, sum(d) / (SELECT count(DISTINCT tree) FROM splits) AS mean_d FROM splits GROUP BY split)"
_DIST = "dist AS (SELECT tree, sum((d - mean_d) ** 2 - mean_d ** 2) + (SELECT sum(mean_d ** 2) FROM centre) AS sq FROM splits JOIN centre USING (split) GROUP BY tree)"


def _distances(spark: SparkSession, folder: str) -> DataFrame:
    s = b.splits(spark, folder)
    m = s.select("tree").distinct().agg(F.count("*").alias("m"))
    centre = s.groupBy("split").agg(F.sum("d").alias("t")).join(F.broadcast(m)).select("split", (F.col("t") / F.col("m")).alias("mean_d"))
    return sp.distances_to(s, centre)


@query(f"WITH {b.SPLITS}, {_CENTRE}, {_DIST} SELECT round(avg(sq), 4) AS variance, count(*) AS n FROM dist")
def frechet_variance(spark: SparkSession, folder: str) -> DataFrame:
    return _distances(spark, folder).agg(F.round(F.avg("sq"), 4).alias("variance"), F.count("*").alias("n"))


@query(f"""WITH {b.SPLITS}, {_CENTRE}, {_DIST}, w AS (SELECT tree, max(w) AS w FROM splits GROUP BY tree)
SELECT round(sum(w * sq) / sum(w), 4) AS mean_loss, round(sum(w * sqrt(sq)) / sum(w), 6) AS median_loss FROM dist JOIN w USING (tree)""")
def weighted_mean_loss(spark: SparkSession, folder: str) -> DataFrame:
    w = b.splits(spark, folder).groupBy("tree").agg(F.max("w").alias("w"))
    x = _distances(spark, folder).join(w, "tree")
    mean = lambda v: F.sum(F.col("w") * v) / F.sum("w")
    return x.agg(F.round(mean(F.col("sq")), 4).alias("mean_loss"), F.round(mean(F.sqrt("sq")), 6).alias("median_loss"))


@query(f"""WITH {b.SPLITS}, {_CENTRE}, {_DIST}, k AS (SELECT sq, row_number() OVER (ORDER BY sq) - 1 AS k, count(*) OVER () AS n FROM dist)
SELECT round(sqrt(sq), 6) AS radius, n FROM k WHERE k = least(ceil(n * 0.95), n - 1)""")
def credibility_radius(spark: SparkSession, folder: str) -> DataFrame:
    d = _distances(spark, folder).select(F.sqrt("sq").alias("distance"))
    return sp.credibility_radius(d, 0.95).select(F.round("radius", 6).alias("radius"), "n")


_NODES = """nodes AS (
  SELECT 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent, 0.0 AS d, false AS leaf FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.5, false FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, abs(s_acctbal) / 10000, true FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, abs(c_acctbal) / 10000, true FROM customer)"""


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(node, parent, d, leaf) of the hierarchy region, nation, supplier or customer."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = lambda n: b.table(spark, folder, n)
    rows = t("region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("d"), F.lit(False).alias("leaf"))
    rows = rows.unionByName(t("nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"), F.lit(0.5).alias("d"), F.lit(False).alias("leaf")))
    for table, key, up, d in (("supplier", "s_suppkey", "s_nationkey", "s_acctbal"), ("customer", "c_custkey", "c_nationkey", "c_acctbal")):
        rows = rows.unionByName(t(table).select(name(key[0], key).alias("node"), name("n", up).alias("parent"), (F.abs(d) / 10000).alias("d"), F.lit(True).alias("leaf")))
    return rows


@query(f"WITH {_NODES} SELECT parent, round(sum(CASE WHEN d > 0 THEN -d / 0.1 - 1 * ln(0.1) END), 4) AS log_prior, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent")
def tree_prior_gamma(spark: SparkSession, folder: str) -> DataFrame:
    n = _nodes(spark, folder).where("parent IS NOT NULL")
    prior = F.sum(F.when(F.col("d") > 0, mathx.gamma_log_pdf(F.col("d"), 1.0, 0.1)))
    return n.groupBy("parent").agg(F.round(prior, 4).alias("log_prior"), F.count("*").alias("n"))


@query(f"WITH {_NODES} SELECT node, parent, CAST(d AS DOUBLE) * CAST(2.5 AS DOUBLE) AS d FROM nodes")
def tree_scale(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder).select("node", "parent", (F.col("d") * 2.5).alias("d"))


@query(f"""WITH RECURSIVE {_NODES}, up AS (SELECT node AS leaf, parent AS node FROM nodes WHERE leaf UNION ALL SELECT up.leaf, nodes.parent FROM up JOIN nodes USING (node))
SELECT node, count(*) AS n_leaves FROM up WHERE node IS NOT NULL GROUP BY node""")
def descendant_leaf_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = _nodes(spark, folder)
    up = n.where("leaf").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_leaves"))
    total, links = up, n.select("node", "parent")
    for _ in range(2):  # the hierarchy has three levels
        up = up.join(links, "node").where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("n_leaves"))
        total = total.unionByName(up)
    return total.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"))
