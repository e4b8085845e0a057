"""Hidden states against sums over all paths, and a stream's totals against those of all its trees."""

import itertools
import math
import random

from cladewise.operators import hmm
from cladewise.streaming import consensus


def brute(logml, start, transition):
    k, n = len(start), len(logml)
    mass = [[0.0] * k for _ in range(n)]
    for path in itertools.product(range(k), repeat=n):
        p = start[path[0]] * math.prod(transition[a][b] for a, b in zip(path, path[1:])) * math.exp(sum(x[s] for x, s in zip(logml, path)))
        for i, s in enumerate(path):
            mass[i][s] += p
    return [[x / sum(row) for x in row] for row in mass]


def test_posterior_states(spark):
    rng = random.Random(4)
    start, transition = [0.3, 0.7], [[0.9, 0.1], [0.2, 0.8]]
    data = {a: [[rng.uniform(-5, 0) for _ in range(2)] for _ in range(n)] for a, n in ((1, 8), (2, 1), (3, 3))}
    rows = [(a, i, x, "extra") for a, sites in data.items() for i, x in enumerate(sites)]
    frame = spark.createDataFrame(rows, "aln long, pos int, logml array<double>, block string")
    for block in (3, 4096):
        got = {(r["aln"], r["pos"]): r["posterior"] for r in hmm.forward_backward(frame, start, transition, block).collect()}
        assert len(got) == len(rows)
        for a, sites in data.items():
            for i, want in enumerate(brute(sites, start, transition)):
                assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(got[a, i], want))
    assert hmm.forward_backward(frame.where("false"), start, transition).count() == 0


def test_stream_of_trees(spark, tmp_path):
    schema = "tree long, edges array<struct<split: bigint, d: double>>"
    batches = [[(1, [(6, 1.0), (12, 2.0)]), (2, [(6, 3.0)])], [(3, [(6, 2.0), (24, 1.0)]), (4, None)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        job = consensus.start(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), availableNow=True)
        assert job.awaitTermination(120)
    found = consensus.latest(spark, str(tmp_path / "out"))
    whole = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, consensus.split_totals(whole).collect()))
    assert [tuple(r) for r in consensus.majority(found).collect()] == [(6, 3, 2.0)]
    assert consensus.split_totals(whole.where("false")).count() == 0
