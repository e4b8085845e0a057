"""Sampling histories as INI texts with a section [Result], and back.

Every matrix is a key with indented lines: a line per chain with a value per step (``cluster-sizes``: a line per
recorded partition), ``-`` for an empty one. ``partitions`` has a line per partition. A file is one row until its lines are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .partitions import subsets_of

SECTION = "[Result]"
#: The format's matrices in its order, and whether they are written with two decimals.
MATRICES = (("components", False), ("cluster-sizes", False), ("switches", False), ("likelihood", True), ("posterior", True), ("temperature", True))
VALUES = ("components", "switches", "likelihood", "posterior", "temperature")
PARTITIONS = ("partitions", "map_partition", "mean_partition", "median_partition")


def _lines(text: Column, key: str) -> Column:
    """The lines of a key's value, those on the key's own line first, blank ones left out."""
    body = F.regexp_extract(text, rf"(?m)^{key}\s*[=:]([^\n]*(?:\n[ \t]+[^\n]*|\n[ \t]*(?=\n))*)", 1)
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.translate(x, "\t", " "))), lambda x: x != "")


def _numbers(line: Column) -> Column:
    return F.transform(F.filter(F.split(line, r"\s+"), lambda x: (x != "") & (x != "-")), lambda x: x.cast("double"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every file; one without the section raises an error when it is read."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows.withColumn("text", F.when(F.contains("text", F.lit(SECTION)), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no section [Result]: "), "file"))))


def read_history(texts: DataFrame) -> DataFrame:
    """(file, chain, step, components, switches, likelihood, posterior, temperature), chains and steps from 0.

    A matrix that is missing, or shorter than another, gives nulls.
    """
    arrays = texts.select("file", *(F.transform(_lines(F.col("text"), k), _numbers).alias(k) for k in VALUES))
    most = F.greatest(*(F.size(k) for k in VALUES))
    chains = arrays.where(most > 0).select("file", F.explode(F.sequence(F.lit(0), most - 1)).alias("chain"), *VALUES)
    chains = chains.select("file", "chain", *(F.coalesce(F.try_element_at(k, F.col("chain") + 1), F.array().cast("array<double>")).alias(k) for k in VALUES))
    return chains.select("file", "chain", F.posexplode(F.arrays_zip(*VALUES)).alias("step", "x")).select("file", "chain", "step", *(F.col("x")[k].alias(k) for k in VALUES))


def read_cluster_sizes(texts: DataFrame) -> DataFrame:
    """(file, row, sizes)."""
    rows = texts.select("file", F.posexplode(_lines(F.col("text"), "cluster-sizes")).alias("row", "line"))
    return rows.select("file", "row", F.transform(_numbers(F.col("line")), lambda x: x.cast("int")).alias("sizes"))


def read_result_partitions(texts: DataFrame) -> DataFrame:
    """(file, kind, row, subsets) of the sampled partitions and of the estimates, as far as the file has them; ``subsets`` as in the text files of partitions."""
    parts = None
    for kind in PARTITIONS:
        own = texts.select("file", F.lit(kind).alias("kind"), F.posexplode(_lines(F.col("text"), kind)).alias("row", "line"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.select("file", "kind", "row", subsets_of(F.col("line")).alias("subsets"))


def _number(x: Column, fixed: bool) -> Column:
    whole = x == F.floor(x)
    plain = F.when(whole, x.cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))
    return F.format_string("%.2f", x) if fixed else plain


def history_lines(history: DataFrame, sizes: DataFrame | None = None, partitions: DataFrame | None = None) -> DataFrame:
    """(part, row, line): the file's lines in order of (part, row).

    ``history`` (chain, step, any of the matrices' columns), ``sizes`` (row, sizes), ``partitions`` (row, line). A chain is one line of
    the format, and so one row here; a null value is written as nan, a chain without steps can't occur.
    """
    spark = history.sparkSession
    out = spark.createDataFrame([(-1, 0, SECTION)], "part int, row long, line string")
    for part, (key, fixed) in enumerate(MATRICES):
        head = spark.createDataFrame([(2 * part, 0, f"{key} =")], "part int, row long, line string")
        if key == "cluster-sizes":
            if sizes is None:
                continue
            text = F.when(F.size("sizes") == 0, "-").otherwise(F.concat(F.array_join("sizes", " "), F.lit(" ")))
            body = sizes.select(F.col("row").cast("long").alias("row"), text.alias("text"))
        elif key not in history.columns:
            continue
        else:
            own = F.array_sort(F.collect_list(F.struct("step", F.coalesce(_number(F.col(key).cast("double"), fixed), F.lit("nan")).alias("x"))))
            body = history.groupBy(F.col("chain").cast("long").alias("row")).agg(F.concat(F.array_join(F.transform(own, lambda s: s["x"]), " "), F.lit(" ")).alias("text"))
        out = out.unionByName(head).unionByName(body.select(F.lit(2 * part + 1).alias("part"), "row", F.concat(F.lit("\t"), "text").alias("line")))
    if partitions is not None:
        part = 2 * len(MATRICES)
        out = out.unionByName(spark.createDataFrame([(part, 0, "partitions =")], "part int, row long, line string"))
        out = out.unionByName(partitions.select(F.lit(part + 1).alias("part"), F.col("row").cast("long").alias("row"), F.concat(F.lit("\t"), "line").alias("line")))
    return out


def write_history(lines: DataFrame, path: str) -> None:
    """The lines as one text file; the format has no parts."""
    lines.repartition(1).sortWithinPartitions("part", "row").select(F.col("line").alias("value")).write.text(path)
