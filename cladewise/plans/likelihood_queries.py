"""Queries of column likelihoods and tree space; beyond SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators import alignments, dirichlet_process, divergence, integrated, simulation, splicing, symbolic, tree_gradients, tree_means, tree_sampler, trees, variational
from cladewise.registry import query

from . import bindings as b

TREE = "((((t1:0.1,t2:0.2):0.15,t3:0.3):0.2,(t4:0.1,t5:0.4):0.25):0.1,(t6:0.3,t7:0.2):0.1,t0:0.5);"
TAXA = [f"t{k}" for k in range(8)]
ALPHA = [0.2] * 5


@query()
def column_marginal_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Log marginal likelihood of every column: one evaluation per distinct column, joined back to positions."""
    a = b.alignment_blocks(spark, folder)
    value = trees.pattern_likelihoods(alignments.patterns(a), TREE, TAXA, ALPHA)
    return a.join(value.select("codes", F.round("logml", 6).alias("logml")), "codes").select("aln", "pos", "logml")


@query()
def column_expectation(spark: SparkSession, folder: str) -> DataFrame:
    a = b.alignment_blocks(spark, folder)
    value = trees.pattern_likelihoods(alignments.patterns(a), TREE, TAXA, ALPHA)
    return a.join(value, "codes").select("aln", "pos", *(F.round(F.col("expectation")[k], 6).alias(f"p{k}") for k in range(5)))


LEAVES = ["a", "b", "c", "d", "e"]
SHAPES = ["(((b:1,c:1):{0},d:1):{1},e:1,a:1);", "(((b:1,d:1):{0},c:1):{1},e:1,a:1);", "((b:1,c:1):{0},(d:1,e:1):{1},a:1);"]


def _sample(spark: SparkSession, folder: str) -> DataFrame:
    """(tree, newick): trees whose branch lengths come from orders; three shapes in turn."""
    x, y = F.col("o_totalprice") / 100000 + 0.01, F.col("o_custkey") % 97 / 10.0 + 0.01
    newick = F.lit(None).cast("string")
    for k, shape in enumerate(SHAPES):
        parts = shape.replace("{1}", "{0}").split("{0}")
        text = F.concat(F.lit(parts[0]), x.cast("string"), F.lit(parts[1]), y.cast("string"), F.lit(parts[2]))
        newick = F.when(F.col("o_orderkey") % 3 == k, text).otherwise(newick)
    return b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("tree"), newick.alias("newick"))


@query()
def geodesic_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of each tree from the one of the next number."""
    t = _sample(spark, folder).select(F.col("tree").alias("i"), F.col("newick").alias("first"))
    u = t.select((F.col("i") - 1).alias("i"), F.col("first").alias("second"))
    pairs = t.join(u, "i").select("i", (F.col("i") + 1).alias("j"), "first", "second")
    return trees.geodesic_pairs(pairs, LEAVES).withColumn("distance", F.round("distance", 6))


@query()
def frechet_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of four random walks toward the mean of the trees."""
    return tree_means.random_walks(_sample(spark, folder), LEAVES, "mean").withColumn("d", F.round("d", 6))


@query()
def geometric_median(spark: SparkSession, folder: str) -> DataFrame:
    """The tree of least summed distance to all trees, by one job a pass."""
    found, _ = tree_means.geometric_median(_sample(spark, folder), LEAVES)
    return found.withColumn("d", F.round("d", 6))


@query()
def expected_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of the polynomials of random columns, by closed parts and by pruning, on small combs."""
    sizes = [1, 2, 3, 4, 5]
    closed = trees.expected_terms(spark, sizes, 300).withColumnRenamed("terms", "decomposition")
    return closed.join(trees.expected_terms(spark, sizes, 300, prune=True).withColumnRenamed("terms", "pruning"), "x")


@query()
def mean_tree_newick(spark: SparkSession, folder: str) -> DataFrame:
    """The ends of four walks toward the mean, as trees."""
    ends = tree_means.random_walks(_sample(spark, folder), LEAVES, "mean", steps=10)
    return trees.newick_of_splits(ends.select(F.col("walk").alias("tree"), "kind", "mask", "d"), LEAVES).withColumnRenamed("tree", "walk")


@query()
def mh_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Ten steps of chains at two temperatures over the trees of the alignment's species."""
    return tree_sampler.metropolis_hastings(alignments.patterns(b.alignment_blocks(spark, folder)), TREE, TAXA, ALPHA, 10, [1.0, 2.0])


@query()
def spliced_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Two exons of every document, in its own block and the next id's, over blocks made of each document's letters and their complements.

    Where a block ends inside an exon, or the next id has no document or no letters, the target is filled with N and the
    other source, if the splice has it at all, with gaps. Documents without an id have no place.
    """
    s = b.sequences(spark, folder).withColumn("text", F.translate("seq", "-", "")).where("doc_id IS NOT NULL")
    row = lambda src, text: F.struct(F.lit(src).alias("src"), text.alias("text"))
    rows = s.withColumn("r", F.explode(F.array(row("target", F.col("text")), row("other", F.translate("text", "GATC", "CTAG")))))
    size = F.length("r.text").cast("long")
    maf = rows.select(F.lit("f").alias("file"), F.col("doc_id").alias("at"), F.col("doc_id").alias("block"), "r.src", (F.col("doc_id") * (1 << 20)).alias("start"), size.alias("size"), F.lit("+").alias("strand"), "r.text")
    part = F.explode(F.array(F.lit(0), F.lit(1)))
    exons = s.select(F.col("doc_id").alias("splice"), part.alias("part"))
    start = (F.col("splice") + F.col("part")) * (1 << 20)
    return splicing.splice(maf, exons.select("splice", "part", (start + 5).alias("from"), (start + 25).alias("to")), "target")


@query()
def gradient_ascent_trace(spark: SparkSession, folder: str) -> DataFrame:
    return tree_gradients.gradient_ascent(alignments.patterns(b.alignment_blocks(spark, folder)), TREE, TAXA, ALPHA, 4)


@query()
def hmc_trace(spark: SparkSession, folder: str) -> DataFrame:
    return tree_gradients.hamiltonian(alignments.patterns(b.alignment_blocks(spark, folder)), TREE, TAXA, ALPHA, 4)


@query()
def variational_dirichlet(spark: SparkSession, folder: str) -> DataFrame:
    """The Dirichlet distribution closest to the posterior of each column, joined back to positions."""
    a = b.alignment_blocks(spark, folder)
    fit = variational.pattern_approximations(alignments.patterns(a), TREE, TAXA, ALPHA)
    return a.join(fit, "codes").select("aln", "pos", *(F.round(F.col("xi")[k], 5).alias(f"xi{k}") for k in range(5)))


@query()
def symbolic_polynomials(spark: SparkSession, folder: str) -> DataFrame:
    """Polynomials of all distinct columns, expanded from the tree's terms over sets of leaves."""
    found = symbolic.expanded_columns(alignments.patterns(b.alignment_blocks(spark, folder)), TREE, TAXA, len(ALPHA))
    return found.select(F.array_join("codes", ",").alias("codes"), "n", F.array_join("exponents", ",").alias("exponents"), F.round("coefficient", 9).alias("coefficient"))


@query()
def column_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of each distinct column's closest Dirichlet distribution from its posterior, by stratified sampling, with its error."""
    fit = variational.pattern_approximations(alignments.patterns(b.alignment_blocks(spark, folder)), TREE, TAXA, ALPHA)
    targets = divergence.column_targets(fit.withColumn("key", F.xxhash64("codes")), TREE, TAXA, ALPHA)
    return divergence.divergences(targets, ALPHA, 4000, 4)


@query()
def simulate_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """As many columns as the folder's alignment blocks have."""
    n = b.alignment_blocks(spark, folder).count()
    return simulation.simulate_columns(spark, n, TREE, TAXA, ALPHA, 1)


@query()
def simulate_gaussian_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return simulation.gaussian_mixture(spark, 1000, [(0.0, 0.0), (5.0, 1.0), (-3.0, 4.0)], [0.5, 0.3, 0.2], 0.5, 1)


@query()
def gaussian_dpm_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Ten sweeps over the orders as points of price and key."""
    o = b.table(spark, folder, "orders")
    points = o.select(F.col("o_orderkey").alias("i"), (F.col("o_totalprice") / 50000).alias("x"), (F.col("o_orderkey") % 1000 / 100.0).alias("y"))
    return dirichlet_process.sample(points, dirichlet_process.Model(), 10, 1)[0]


def _marginals(spark: SparkSession, folder: str, make) -> DataFrame:
    c = b.counts(spark, folder, ("user_id", "day")).withColumn("day", F.col("day").cast("string"))
    return integrated.marginals(c, [f"c{k}" for k in range(5)], make).withColumn("logml", F.round("logml", 6))


@query()
def integrated_background(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of letters under pseudocounts that have a gamma distribution."""
    return _marginals(spark, folder, lambda: integrated.gamma_prior(5, 5.0, 0.2, integrated.DRAWS, 1))


@query()
def entropy_background(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of letters whose relative entropy has a beta distribution."""
    return _marginals(spark, folder, lambda: integrated.entropy_prior(5, 10.0, 10.0, integrated.DRAWS, 1))


@query()
def entropy_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return integrated.entropy_histogram(spark, 4, 200_000, seed=1)
