"""Motif clusters as INI texts with a section [Cluster], and back.

A cluster is a key with one line per letter (``G: 1.00 2.00``, the gap as ``-``) and keys for its number of members, its type and its sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .partitions import element_text, elements_of
from .results import _lines

LETTERS = "GATC-"


def vector_text(values: Column) -> Column:
    """Numbers in six places with two decimals, a space behind each."""
    return F.array_join(F.transform(values, lambda x: F.format_string("%6.2f ", x.cast("double"))), "")


def matrix_lines(matrix: Column, letters: str = LETTERS) -> Column:
    """Lines of a matrix given as one array per letter."""
    return F.array(*(F.concat(F.lit(f"{c}: "), vector_text(matrix[k])) for k, c in enumerate(letters)))


def parse_matrix(lines: Column, letters: str = LETTERS) -> Column:
    """Array per letter, from lines in any order and case; a letter without a line is empty. What isn't such a line raises an error."""

    def row(c: str) -> Column:
        own = F.filter(lines, lambda x: F.upper(F.substring(x, 1, 1)) == c)
        numbers = F.filter(F.split(F.substring(F.element_at(own, 1), 3, 1 << 30), r"\s+"), lambda x: x != "")
        return F.when(F.size(own) > 0, F.transform(numbers, lambda x: x.cast("double"))).otherwise(F.array().cast("array<double>"))

    bad = F.exists(lines, lambda x: ~F.regexp_like(F.upper(x), F.lit(f"^[{letters.replace('-', '')}{'-' if '-' in letters else ''}]:")))
    return F.when(bad, F.raise_error(F.lit("neither letter nor counts")).cast("array<array<double>>")).otherwise(F.array(*map(row, letters)))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(file, cluster, counts, members, type, sites): counts as one array per letter G, A, T, C and gap; sites null where the file has none."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    named = rows.select("file", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^cluster_([0-9]+)\s*[=:]"), F.lit(1)))).alias("name"))
    # the key depends on the row, so a cluster's part of the text is cut out first
    part = F.regexp_extract_all("text", F.lit(r"(?m)^(cluster_[0-9]+[_a-z]*\s*[=:][^\n]*(?:\n[ \t]+[^\n]*)*)"), F.lit(1))
    own = lambda suffix: F.coalesce(F.try_element_at(F.filter(part, lambda x: F.regexp_extract(x, r"^(cluster_[0-9]+[_a-z]*)", 1) == F.concat(F.lit("cluster_"), "name", F.lit(suffix))), F.lit(1)), F.lit(""))
    value = lambda suffix: F.regexp_replace(own(suffix), r"^cluster_[0-9]+[_a-z]*", "value")
    found = named.select("file", F.col("name").cast("int").alias("cluster"), *(_lines(value(s), "value").alias(n) for s, n in (("", "rows"), ("_components", "members"), ("_type", "type"), ("_sites", "sites"))))
    first = lambda c: F.try_element_at(c, F.lit(1))
    return found.select(
        "file",
        "cluster",
        parse_matrix(F.col("rows")).alias("counts"),
        first("members").cast("int").alias("members"),
        first("type").alias("type"),
        F.when(F.size("sites") > 0, elements_of(F.array_join("sites", " "))).alias("sites"),
    )


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """(cluster, at, line) from (cluster, counts, members, type, sites); the section and the list of names are added by ``write_clusters``."""
    key = F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))
    parts = [
        F.array(F.concat(key, F.lit(" ="))),
        F.transform(matrix_lines(F.col("counts")), lambda x: F.concat(F.lit("\t"), x)),
        F.array(F.concat(key, F.lit("_components = "), F.col("members").cast("string")), F.concat(key, F.lit("_type = "), F.coalesce("type", F.lit("")))),
        F.when(F.size("sites") > 0, F.array(F.concat(key, F.lit("_sites = "), F.array_join(F.transform("sites", element_text), ", ")))).otherwise(F.array().cast("array<string>")),
    ]
    return clusters.select("cluster", F.posexplode(F.concat(*parts)).alias("at", "line"))


def write_clusters(clusters: DataFrame, path: str) -> None:
    """One INI file. It holds a few lines per motif, whatever the number of sequences, but for the list of sites."""
    names = clusters.agg(F.array_join(F.transform(F.array_sort(F.collect_list("cluster")), lambda k: F.concat(F.lit("cluster_"), k.cast("string"))), " ").alias("names"))
    head = names.select(F.lit(-1).alias("cluster"), F.posexplode(F.array(F.lit("[Cluster]"), F.concat(F.lit("cluster = "), "names"))).alias("at", "line"))
    lines = head.unionByName(cluster_lines(clusters))
    lines.repartition(1).sortWithinPartitions("cluster", "at").select(F.col("line").alias("value")).write.text(path)
