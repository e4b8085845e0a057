"""Queries of text formats, of running split totals and of hidden states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.operators import alignments, hmm, trees
from cladewise.registry import query
from cladewise.sources import clusters, fasta, partitions, results
from cladewise.streaming import consensus

from . import bindings as b
from .likelihood_queries import TAXA, TREE


@query(
    f"WITH {b.SEQ} SELECT '>' || concat_ws('.', CAST(doc_id AS VARCHAR), lang) || chr(10) || "
    r"rtrim(regexp_replace(seq, '(.{80})', '\1' || chr(10), 'g'), chr(10)) AS value FROM seqs JOIN documents USING (doc_id)"
)
def fasta_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's letters as a FASTA record with lines of 80."""
    names = b.table(spark, folder, "documents").select("doc_id", F.col("lang").alias("contig"))
    s = b.sequences(spark, folder).join(names, "doc_id")
    return fasta.fasta_lines(s.select(F.col("doc_id").cast("string").alias("taxon"), "contig", "seq"))


_ROWS = "(SELECT chain, step, round(posterior, 2) AS p FROM history WHERE step <= 50)"


@query(f"""WITH {b.HISTORY}, r AS (SELECT chain, chr(9) || string_agg(printf('%.2f', p), ' ' ORDER BY step) || ' ' AS line FROM {_ROWS} GROUP BY chain)
SELECT -1 AS part, CAST(0 AS BIGINT) AS row, '[Result]' AS line UNION ALL SELECT 8, 0, 'posterior =' UNION ALL SELECT 9, chain, line FROM r
UNION ALL SELECT 12, 0, 'partitions =' UNION ALL SELECT 13, user_id, chr(9) || 'm' || (user_id % 3) || ':8:{{' || string_agg('(' || user_id || ', ' || event_id || ')' || CASE WHEN event_id % 2 = 1 THEN '!' ELSE '' END, ', ' ORDER BY event_id) || '}}'
FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def result_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a result file: posterior values of the first steps of every chain, and one partition per user."""
    history = b.history(spark, folder).where("step <= 50").select("chain", "step", F.round("posterior", 2).alias("posterior"))
    e = b.table(spark, folder, "events").where("user_id IS NOT NULL")
    element = F.struct(F.col("event_id"), F.col("user_id").alias("seq"), F.col("event_id").alias("pos"), (F.col("event_id") % 2 == 1).alias("reverse"))
    own = e.groupBy("user_id").agg(F.array_sort(F.collect_list(element)).alias("elements"))
    subset = F.struct(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.lit(8).alias("length"), "elements")
    lines = partitions.partition_lines(own.select(F.col("user_id").alias("row"), F.array(subset).alias("subsets")), "row")
    return results.history_lines(history, partitions=lines.withColumnRenamed("value", "line"))


@query(f"""WITH m AS (SELECT user_id % 10 AS cluster, (event_id % 6) AS o, {", ".join(f"count(*) FILTER (event_id % 5 = {k}) AS c{k}" for k in range(5))} FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
r AS (SELECT cluster, count(*) AS members FROM events e JOIN (SELECT DISTINCT user_id % 10 AS cluster FROM events) c ON e.user_id % 10 = c.cluster GROUP BY cluster),
t AS (SELECT cluster, k, string_agg(printf('%6.2f ', CAST([c0, c1, c2, c3, c4][k] AS DOUBLE)), '' ORDER BY o) AS v FROM m, (SELECT unnest(range(1, 6)) AS k) GROUP BY ALL)
SELECT cluster, 0 AS at, 'cluster_' || cluster || ' =' AS line FROM r UNION ALL SELECT cluster, k, chr(9) || 'GATC-'[k] || ': ' || v FROM t
UNION ALL SELECT cluster, 6, 'cluster_' || cluster || '_components = ' || members FROM r UNION ALL SELECT cluster, 7, 'cluster_' || cluster || '_type = user' FROM r""")
def cluster_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Count matrices of ten clusters as the lines of a cluster file."""
    e = b.table(spark, folder, "events").where("user_id IS NOT NULL").select((F.col("user_id") % 10).alias("cluster"), (F.col("event_id") % 6).alias("o"), (F.col("event_id") % 5).alias("k"))
    cells = e.groupBy("cluster", "o").agg(F.array(*(F.sum((F.col("k") == k).cast("long")) for k in range(5))).alias("c"), F.count("*").alias("n"))
    own = cells.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("o", "c"))).alias("s"), F.sum("n").alias("members"))
    row = lambda k: F.transform("s", lambda x: x["c"][k])
    counts = F.array(*map(row, range(5)))
    rows = own.select("cluster", counts.alias("counts"), "members", F.lit("user").alias("type"), F.array().cast("array<struct<seq:int,pos:int,reverse:boolean>>").alias("sites"))
    return clusters.cluster_lines(rows)


@query(
    f"WITH {b.SPLITS} SELECT split, count(*) AS n, sum(d) AS total FROM splits GROUP BY split "
    "UNION ALL SELECT -1, count(DISTINCT tree), CAST(0 AS DOUBLE) FROM splits"
)
def running_split_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The state that a stream of trees keeps, from all trees at once."""
    edge = F.struct(F.col("split").cast("long").alias("split"), F.col("d").cast("double").alias("d"))
    samples = b.splits(spark, folder).groupBy("tree").agg(F.collect_list(edge).alias("edges"))
    return consensus.split_totals(samples)


@query()
def hmm_posterior(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of two states, of a narrow and of a wide prior over letters, at every site of every alignment block."""
    a = b.alignment_blocks(spark, folder)
    found = alignments.patterns(a)
    value = lambda alpha, name: trees.pattern_likelihoods(found, TREE, TAXA, [alpha] * 5).select("codes", F.col("logml").alias(name))
    s = a.join(value(0.1, "x"), "codes").join(value(1.0, "y"), "codes").select("aln", "pos", F.array("x", "y").alias("logml"))
    states = hmm.forward_backward(s, [0.5, 0.5], [[0.95, 0.05], [0.05, 0.95]])
    return states.select("aln", "pos", *(F.round(F.col("posterior")[k], 6).alias(f"p{k}") for k in range(2)))
