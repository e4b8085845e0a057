"""What a sequence logo shows: for each position the relative entropy of its letters, its credible interval, and its weight."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions import mathx

DRAWS = 4000


def logo_entropy(counts: DataFrame, columns: list[str], prior: list[float] | None = None) -> DataFrame:
    """``counts`` with ``entropy``, in nats, and ``weight``, the position's letters over the most of any position.

    With pseudocounts ``prior`` it is the posterior mean of the relative entropy to the prior's shares; without, the log of the alphabet's size
    minus the entropy of the letters' shares, 0 where there are none. Zeros and empty tables are fine; a null count gives nulls.
    """
    n = [F.col(c).cast("double") for c in columns]
    total = sum(n[1:], n[0])
    if prior is None:
        entropy = F.when(total == 0, 0.0).otherwise(math.log(len(columns)) - mathx.entropy([x / total for x in n]))
    else:
        alpha, whole = [x + float(p) for x, p in zip(n, prior)], total + float(sum(prior))
        share = [math.log(p / sum(prior)) for p in prior]
        entropy = sum((a / whole * (mathx.digamma(a + 1.0) - s) for a, s in zip(alpha, share)), F.lit(0.0)) - mathx.digamma(whole + 1.0)
    rows = counts.withColumns({"entropy": entropy, "weight": total})
    most = rows.agg(F.max("weight").alias("__most"))
    return rows.crossJoin(F.broadcast(most)).withColumn("weight", F.when(F.col("__most") > 0, F.col("weight") / F.col("__most")).otherwise(0.0)).drop("__most")  # one row


def entropy_intervals(counts: DataFrame, columns: list[str], prior: list[float], share: float = 0.95, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """The distinct count vectors with ``low`` and ``high``, between which the relative entropy to the prior's shares lies with probability ``share``.

    From seeded draws of each vector's posterior; equal vectors have equal intervals, whichever task holds them. Vectors with nulls have none.
    """
    base = np.log(np.array(prior) / sum(prior))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                alpha = np.array(row, float) + prior
                rng = np.random.Generator(np.random.PCG64([seed, *(int(x * 1024) for x in row)]))
                theta = np.maximum(rng.dirichlet(alpha, draws), 1e-300)
                ends.append(np.quantile((theta * (np.log(theta) - base)).sum(1), [(1 - share) / 2, (1 + share) / 2]))
            low, high = zip(*ends) if ends else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.float64()), pa.array(high, pa.float64())], [*columns, "low", "high"])

    vectors = counts.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna().distinct()
    return vectors.mapInArrow(drawn, ", ".join(f"{c} double" for c in [*columns, "low", "high"]))
