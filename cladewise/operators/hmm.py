"""Posterior state probabilities of a hidden Markov model over the sites of an alignment.

Steps of the model are products of small matrices, and products can be taken block by block: a first
pass gives one matrix per block of sites, a second one carries messages over those matrices, and a
third one finishes every block from the messages at its ends. No task holds a whole alignment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sites in a block.
BLOCK = 4096


def _steps(logml: np.ndarray, transition: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Matrices that carry a row of forward messages over each site, and the logarithms taken out of them."""
    scale = logml.max(1)
    steps = transition[None] * np.exp(logml - scale[:, None])[:, None, :]
    if first:
        steps[0] = np.diag(np.exp(logml[0] - scale[0]))
    return steps, scale


def forward_backward(sites: DataFrame, start: list[float], transition: list[list[float]], block: int = BLOCK) -> DataFrame:
    """(aln, pos, posterior): probabilities of the states at each site given all sites.

    ``sites``: (aln, pos, logml ARRAY<DOUBLE>) with a log likelihood per state; positions of an alignment
    run from 0 without gaps. ``start`` are the probabilities of the first site's state. An empty table
    gives no rows. Other columns are not read.
    """
    pi, t = np.array(start, float), np.array(transition, float)
    k = len(pi)

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        steps, _ = _steps(np.stack(rows["logml"].to_numpy()), t, int(rows["pos"].iloc[0]) == 0)
        whole = np.eye(k)
        for m in steps:
            whole = whole @ m
            whole /= whole.max()
        return pd.DataFrame({"aln": [rows["aln"].iloc[0]], "block": [rows["block"].iloc[0]], "whole": [whole.ravel()]})

    def messages(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        wholes = [np.array(w).reshape(k, k) for w in rows["whole"]]
        enter, leave = [pi], [np.ones(k)]
        for w in wholes[:-1]:
            enter.append((v := enter[-1] @ w) / v.sum())
        for w in wholes[:0:-1]:
            leave.append((v := w @ leave[-1]) / v.sum())
        return pd.DataFrame({"aln": rows["aln"], "block": rows["block"], "enter": enter, "leave": leave[::-1]})

    def finish(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        if not len(rows):
            return pd.DataFrame({"aln": [], "pos": [], "posterior": []})
        steps, _ = _steps(np.stack(rows["logml"].to_numpy()), t, int(rows["pos"].iloc[0]) == 0)
        a, b = np.empty((len(rows), k)), np.empty((len(rows), k))
        v = np.array(ends["enter"].iloc[0])
        for i, m in enumerate(steps):
            v = v @ m
            v = a[i] = v / v.sum()
        v = np.array(ends["leave"].iloc[0])
        for i in range(len(rows) - 1, -1, -1):
            b[i] = v
            v = steps[i] @ v
            v = v / v.sum()
        both = a * b
        return pd.DataFrame({"aln": rows["aln"], "pos": rows["pos"], "posterior": list(both / both.sum(1, keepdims=True))})

    s = sites.select(F.col("aln").cast("long").alias("aln"), F.col("pos").cast("long").alias("pos"), "logml").withColumn("block", F.floor(F.col("pos") / block))
    wholes = s.groupBy("aln", "block").applyInPandas(product, "aln long, block long, whole array<double>")
    ends = wholes.groupBy("aln").applyInPandas(messages, "aln long, block long, enter array<double>, leave array<double>")
    return s.groupBy("aln", "block").cogroup(ends.groupBy("aln", "block")).applyInPandas(finish, "aln long, pos long, posterior array<double>")
