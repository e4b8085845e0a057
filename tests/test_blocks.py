"""Queries of alignment blocks take every embedding."""

import math

import numpy as np
import pytest

from cladewise import registry
from cladewise.operators import alignments
from cladewise.plans import bindings


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("blocks")
    rows = [(k, [(k * 7 + p * 3) % 11 / 10.0 for p in range(3)]) for k in (*range(8), *range(16, 19))] + [(None, [0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def test_missing_species_of_a_block_are_unknown(spark, folder):
    rows = {(r["aln"], r["pos"]): r["codes"] for r in bindings.alignment_blocks(spark, folder).collect()}
    assert set(rows) == {(a, p) for a in (0, 2) for p in range(3)}
    for p in range(3):
        assert rows[0, p] == [math.floor(float(np.float32((k * 7 + p * 3) % 11 / 10.0)) * 10) % 5 for k in range(8)]
        assert -1 not in rows[2, p][:3] and rows[2, p][3:] == [-1] * 5


@pytest.mark.parametrize("name", ["column_marginal_likelihood", "column_expectation", "hmm_posterior", "variational_dirichlet", "simulate_alignment"])
def test_every_block_has_its_rows(spark, folder, name):
    rows = registry.queries()[name](spark, folder).collect()
    assert len(rows) == 6
    if name != "simulate_alignment":
        assert {(r["aln"], r["pos"]) for r in rows} == {(a, p) for a in (0, 2) for p in range(3)}


@pytest.mark.parametrize("name", ["mh_trace", "gradient_ascent_trace", "hmc_trace"])
def test_chains_see_every_block(spark, folder, name, monkeypatch):
    seen, patterns = [], alignments.patterns
    monkeypatch.setattr(alignments, "patterns", lambda a: seen.append(patterns(a)) or seen[-1])
    assert registry.queries()[name](spark, folder).count() > 0
    assert seen[0].groupBy().sum("n").first()[0] == 6
