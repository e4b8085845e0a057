"""Blocks of files without separators, logo data, and stored marginals."""

import math
import random

import numpy as np
import pytest

from cladewise.operators import alignment_blocks, integrated, logo
from cladewise.sources import fasta


def scanned(taxa, keep):
    """One pass from the first record on; '>' is a rule."""
    out, seen, block, held = [], set(), 0, False
    for k, t in enumerate(taxa):
        if t == ">" or t in seen:
            block, seen, held = block + held, set(), False
            if t == ">" or not keep:
                continue
        seen.add(t)
        held = True
        out.append((k, block))
    return out


@pytest.mark.parametrize("keep", [True, False])
@pytest.mark.parametrize("bucket", [100_000, 3])
def test_blocks_equal_a_scan(spark, monkeypatch, keep, bucket):
    monkeypatch.setattr(alignment_blocks, "BUCKET", bucket)
    rng = random.Random(2)
    files = {"a": [rng.choice("tuvwxyz>") for _ in range(60)], "b": list("abcabcabdbd"), "c": ["x"], "d": list(">>ab>>a>ba>"), "e": ["x"] * 5}
    rows = [(f, k // 4, k, t, ">>>" if t == ">" else t) for f, own in files.items() for k, t in enumerate(own)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "file string, at long, rec long, taxon string, header string").repartition(3)
    got = sorted((r["file"], r["pos"], r["block"]) for r in alignment_blocks.blocks_of(table, table["header"], keep).collect())
    assert got == sorted((f, k, block) for f, own in files.items() for k, block in scanned(own, keep))


def test_blocks_of_a_file(spark, tmp_path):
    text = "".join(f">{t}.c{k}\nAC\n" for k in range(9) for t in ("hg", "mm", "rn")[: 2 + k % 2])
    (tmp_path / "m.fa").write_text(text)
    found = alignment_blocks.blocks_of(fasta.read_fasta(spark, str(tmp_path / "m.fa"))).collect()
    assert {r["contig"]: r["block"] for r in found} == {f"c{k}": k for k in range(9)}
    none = fasta.read_fasta(spark, str(tmp_path / "m.fa")).limit(0)
    assert alignment_blocks.blocks_of(none).count() == 0


COLUMNS = ["c0", "c1", "c2"]


def test_logo(spark):
    rows = [(5, 0, 0), (2, 2, 2), (0, 0, 0), (9, 1, 0)]
    table = spark.createDataFrame(rows, "c0 long, c1 long, c2 long")
    plain = {tuple(r)[:3]: (r["entropy"], r["weight"]) for r in logo.logo_entropy(table, COLUMNS).collect()}
    assert plain[5, 0, 0] == (pytest.approx(math.log(3)), 0.5) and plain[2, 2, 2][0] == pytest.approx(0, abs=1e-12) and plain[0, 0, 0] == (0.0, 0.0)
    prior = [1.0, 1.0, 2.0]
    means = {tuple(r)[:3]: r["entropy"] for r in logo.logo_entropy(table, COLUMNS, prior).collect()}
    ends = {tuple(map(int, tuple(r)[:3])): (r["low"], r["high"]) for r in logo.entropy_intervals(table.unionByName(table), COLUMNS, prior).collect()}
    rng = np.random.default_rng(5)
    for row in rows:
        theta = rng.dirichlet(np.array(row) + prior, 100_000)
        h = (theta * np.log(np.maximum(theta, 1e-300) / (np.array(prior) / 4))).sum(1)
        assert means[row] == pytest.approx(h.mean(), abs=0.005)
        assert ends[row][0] == pytest.approx(np.quantile(h, 0.025), abs=0.03) and ends[row][1] == pytest.approx(np.quantile(h, 0.975), abs=0.05)
        assert ends[row][0] < means[row] < ends[row][1]
    assert logo.logo_entropy(table.limit(0), COLUMNS, prior).count() == 0 and len(ends) == 4


def test_stored_marginals(spark, tmp_path):
    rows = [(1, 2, 0), (0, 2, 1), (1, 2, 0), (4, 4, 4), (None, 1, 1)]
    table = spark.createDataFrame(rows, "c0 long, c1 long, c2 long")
    calls = {"shape": 2.0, "scale": 1.0, "draws": 500}
    make = lambda shape=2.0: (lambda: integrated.gamma_prior(3, shape, 1.0, 500, 1))
    folder = f"file://{tmp_path}/cache"
    shown = lambda df: sorted(map(tuple, df.select(*COLUMNS, "logml").collect()), key=repr)
    want = shown(integrated.marginals(table, COLUMNS, make()))
    assert shown(integrated.stored_marginals(table, COLUMNS, make(), calls, folder)) == want
    # read back: what would be computed now doesn't matter
    assert shown(integrated.stored_marginals(table.unionByName(table.limit(1)).limit(5), COLUMNS, make(9.0), calls, folder)) == want
    with pytest.raises(integrated.StaleMarginals):
        integrated.stored_marginals(table, COLUMNS, make(9.0), {**calls, "shape": 9.0}, folder)
    more = table.unionByName(spark.createDataFrame([(7, 7, 7)], table.schema))
    with pytest.raises(integrated.StaleMarginals):
        integrated.stored_marginals(more, COLUMNS, make(), calls, folder)
    assert len(shown(integrated.stored_marginals(more, COLUMNS, make(), calls, folder, renew=True))) == 6
    assert len(shown(integrated.stored_marginals(more, COLUMNS, make(), calls, folder))) == 6
