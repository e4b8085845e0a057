"""Marginal probabilities of count vectors under priors without a closed form: averages over a fixed number of seeded draws.

Both priors are symmetric in the letters, so each multiset of counts is evaluated once, by whichever task
holds it, and joined back. The draws are made anew in every task from the seed; they don't grow with the data.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRAWS, BINS = 20_000, 100
Evaluate = Callable[[np.ndarray], float]


def lgamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by eight steps of the recurrence and Stirling's series."""
    z, steps = x + 8.0, x.copy()
    for k in range(1, 8):
        steps = steps * (x + k)
    s = 1 / (z * z)
    series = (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(steps)


def _mean(logs: np.ndarray, log_weights: np.ndarray | None = None) -> float:
    """Log of the (weighted) mean of exp(logs)."""
    w = np.zeros(len(logs)) if log_weights is None else log_weights
    top, base = (logs + w).max(), w.max()
    return float(top + np.log(np.exp(logs + w - top).sum()) - base - np.log(np.exp(w - base).sum()))


def gamma_prior(letters: int, shape: float, scale: float, draws: int, seed: int) -> Evaluate:
    """Dirichlet-multinomial probabilities whose pseudocounts have a gamma distribution each."""
    alpha = np.maximum(np.random.default_rng(seed).gamma(shape, scale, (draws, letters)), 1e-12)
    whole, parts = alpha.sum(1), lgamma(alpha)

    def evaluate(counts: np.ndarray) -> float:
        met = counts > 0
        return _mean((lgamma(alpha[:, met] + counts[met]) - parts[:, met]).sum(1) + lgamma(whole) - lgamma(whole + counts.sum()))

    return evaluate


def relative_entropy(theta: np.ndarray) -> np.ndarray:
    """Entropy over its largest value, from 0 to 1."""
    return -(theta * np.log(np.maximum(theta, 1e-300))).sum(1) / math.log(theta.shape[1])


def entropy_prior(letters: int, a: float, b: float, draws: int, seed: int) -> Evaluate:
    """Multinomial probabilities whose letters are such that their relative entropy has a beta distribution.

    Letters are drawn evenly from the simplex and weighted by that distribution over the histogram of the draws' own entropies.
    """
    theta = np.random.default_rng(seed).dirichlet(np.ones(letters), draws)
    h = np.clip(relative_entropy(theta), 1e-9, 1 - 1e-9)
    bins = np.minimum((h * BINS).astype(int), BINS - 1)
    mass = np.bincount(bins, minlength=BINS)[bins] / draws
    weights, logs = (a - 1) * np.log(h) + (b - 1) * np.log1p(-h) - np.log(mass), np.log(np.maximum(theta, 1e-300))
    return lambda counts: _mean(logs @ counts, weights)


def marginals(counts: DataFrame, columns: Sequence[str], make: Callable[[], Evaluate]) -> DataFrame:
    """``counts`` with ``logml``. A row with a null count has none; zero counts have 0."""
    key = F.when(F.forall(F.array(*columns), lambda x: x.isNotNull()), F.array_sort(F.array(*(F.col(c).cast("double") for c in columns))))
    rows = counts.withColumn("__key", key)

    def evaluated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluate = None
        for batch in batches:
            evaluate = evaluate or make()
            value = [evaluate(np.array(k)) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], ["__known", "logml"])

    known = rows.select("__key").dropna().distinct().mapInArrow(evaluated, "__known array<double>, logml double")
    return rows.join(known, rows["__key"] == known["__known"], "left").drop("__key", "__known")


def entropy_histogram(spark: SparkSession, letters: int, n: int, bins: int = BINS, seed: int = 0) -> DataFrame:
    """(bin, n, pdf): relative entropies of ``n`` even draws from the simplex. A thousand draws have one seed, whichever task makes them."""

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total = np.zeros(bins, np.int64)
            for block in frame["id"]:
                some = min(1000, n - 1000 * int(block))
                h = relative_entropy(np.random.default_rng((seed, int(block))).dirichlet(np.ones(letters), some))
                total += np.bincount(np.minimum((h * bins).astype(int), bins - 1), minlength=bins)
            yield pd.DataFrame({"bin": np.arange(bins), "n": total})

    sums = spark.range(-(-n // 1000)).mapInPandas(drawn, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    return sums.where("n > 0").withColumn("pdf", F.col("n") * bins / F.lit(float(n)))


def _fingerprint(counts: DataFrame, columns: Sequence[str], parameters: dict) -> str:
    """Of the parameters and of the distinct count vectors, whatever their order, number of copies or other columns."""
    vectors = counts.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna().distinct()
    own = vectors.agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), *columns)).alias(f"h{k}") for k in range(2))).first()
    return json.dumps({"parameters": parameters, "columns": len(columns), "vectors": list(own)}, sort_keys=True)


class StaleMarginals(ValueError):
    """Stored marginals are of other counts or parameters."""


def stored_marginals(counts: DataFrame, columns: Sequence[str], make: Callable[[], Evaluate], parameters: dict, folder: str, renew: bool = False) -> DataFrame:
    """``marginals`` by way of a table in ``folder``, which is made where there is none.

    ``parameters`` names all that ``make`` depends on. A table that was made from other parameters or other count vectors is refused with
    ``StaleMarginals``, or made anew with ``renew``. The fingerprint is written last, so a table cut short counts as none.
    """
    spark, own = counts.sparkSession, _fingerprint(counts, columns, parameters)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/fingerprint/_SUCCESS")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if there and not renew:
        found = spark.read.schema("value string").text(f"{folder}/fingerprint").first()
        if found is None or found["value"] != own:
            raise StaleMarginals(f"{folder} holds marginals of other counts or parameters")
    known = [F.col(c).cast("double").alias(c) for c in columns]
    if not there or renew:
        vectors = counts.select(*known).dropna().distinct()
        marginals(vectors, columns, make).write.mode("overwrite").parquet(f"{folder}/marginals")
        spark.createDataFrame([(own,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/fingerprint")
    schema = ", ".join(f"{c} double" for c in columns) + ", logml double"
    table = spark.read.schema(schema).parquet(f"{folder}/marginals").select(*(F.col(c).alias(f"__{c}") for c in columns), "logml")
    same = [counts[c].cast("double") == table[f"__{c}"] for c in columns]
    return counts.join(table, same, "left").drop(*(f"__{c}" for c in columns))
