"""Alignments and mixtures drawn from their models. A row's draws depend on the seed and its number alone, not on how rows are dealt to tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import Node, parse_newick


def simulate_columns(spark: SparkSession, n: int, newick: str, taxa: list[str], alpha: list[float], seed: int = 0) -> DataFrame:
    """(pos, codes): columns whose letter probabilities are Dirichlet draws; along a branch of length d a letter is drawn anew with chance 1 - exp(-d)."""

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = parse_newick(newick)
        for frame in frames:
            columns = []
            for pos in frame["id"]:
                rng = np.random.default_rng((seed, int(pos)))
                theta, seen = rng.dirichlet(alpha), {}

                def down(node: Node, letter: int) -> None:
                    if not node.children:
                        seen[node.name] = letter
                    for c in node.children:
                        down(c, int(rng.choice(len(theta), p=theta)) if rng.random() < -np.expm1(-c.d) else letter)

                down(root, int(rng.choice(len(theta), p=theta)))
                columns.append([seen[t] for t in taxa])
            yield pd.DataFrame({"pos": frame["id"], "codes": columns})

    return spark.range(n).mapInPandas(drawn, "pos long, codes array<int>")


def gaussian_mixture(spark: SparkSession, n: int, means: list[tuple[float, float]], weights: list[float], sd: float, seed: int = 0) -> DataFrame:
    """(i, x, y, cluster): points of a mixture of round normal distributions."""
    total = float(sum(weights))
    bounds = np.cumsum([w / total for w in weights[:-1]]).tolist()
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("i")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("i")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    cluster = F.lit(len(weights) - 1)
    for k in reversed(range(len(bounds))):
        cluster = F.when(u < bounds[k], k).otherwise(cluster)
    radius, angle = F.sqrt(-2 * F.log(uniform(1))) * sd, uniform(2) * (2 * np.pi)
    centre = lambda axis: F.element_at(F.array(*(F.lit(float(m[axis])) for m in means)), F.col("cluster") + 1)
    points = spark.range(n).withColumnRenamed("id", "i").withColumn("cluster", cluster)
    return points.select("i", (centre(0) + radius * F.cos(angle)).alias("x"), (centre(1) + radius * F.sin(angle)).alias("y"), "cluster")
