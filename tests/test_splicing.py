"""Spliced extraction against a walk over single columns."""

import random

import pytest

from cladewise import registry
from cladewise.operators import splicing

MAF = "file string, at long, block long, src string, start long, size long, strand string, text string, part string"
EXONS = "splice string, part int, from long, to long, strand string"


def block(n, start, texts, strand="+"):
    size = lambda t: len(t.replace("-", ""))
    return [("f", 0, n, src, start if src == "hg" else 7, size(t), strand, t, "x") for src, t in texts.items()]


def walked(rows, exons):
    """Every source's letters by place of the target, joined over the exons."""
    at, used = {}, {"hg"}
    for n in {r[2] for r in rows}:
        own = {r[3]: r for r in rows if r[2] == n}
        if "hg" not in own:
            continue
        place, stop = own["hg"][4], own["hg"][4] + own["hg"][5]
        if any(place < b and a < stop for a, b in exons):
            used |= own.keys()
        for k, letter in enumerate(own["hg"][7]):
            for src in own:
                cell = at.setdefault(place, {})
                cell[src] = cell.get(src, "") + own[src][7][k]
            place += letter != "-" and place < stop - 1
    out = {}
    for src in used:
        cells = [at.get(p) for a, b in exons for p in range(a, b)]
        out[src] = "".join(("N" if src == "hg" else "-") if c is None else c.get(src, "-" * len(c["hg"])) for c in cells)
    return out


def test_splice_against_walk(spark):
    rng = random.Random(3)
    rows, place = [], 100
    for n in range(12):
        width, names = rng.randint(1, 12), ["hg", *rng.sample(["mm", "rn", "cf"], rng.randint(0, 3))]
        texts = {s: "".join(rng.choice("ACGT--") for _ in range(width)) for s in names}
        texts["hg"] = rng.choice(["", "-"]) + "A" + texts["hg"]
        texts = {s: t.ljust(len(texts["hg"]), "-") for s, t in texts.items()}
        rows += block(n, place, texts)
        place += rows[-len(texts)][5] + rng.choice([0, 0, 3])
    rows += block(99, 0, {"mm": "ACG"})
    wanted = {f"s{k}": sorted((a := rng.randint(90, place), a + rng.randint(1, 30)) for _ in range(rng.randint(1, 4))) for k in range(40)}
    exons = [(s, k, a, b, "clash") for s, parts in wanted.items() for k, (a, b) in enumerate(parts)]
    found = splicing.splice(spark.createDataFrame(rows, MAF), spark.createDataFrame(exons, EXONS), "hg").collect()
    assert {(r["splice"], r["src"]): r["seq"] for r in found} == {(s, src): t for s, parts in wanted.items() for src, t in walked(rows, parts).items()}
    assert len(found) == len({(r["splice"], r["src"]) for r in found})


def test_splice_strands_and_nothing(spark):
    maf = spark.createDataFrame(block(0, 10, {"hg": "AC-GT", "mm": "ACTG-"}), MAF)
    exons = spark.createDataFrame([("a", 0, 11, 15, None), ("b", 0, 50, 53, None), ("c", 0, 5, 5, None), (None, 0, 1, 2, None)], EXONS)
    rows = {(r["splice"], r["src"]): r["seq"] for r in splicing.splice(maf, exons, "hg", "-").collect()}
    assert rows == {("a", "hg"): "NAC-G", ("a", "mm"): "--CAG", ("b", "hg"): "NNN"}
    assert splicing.splice(maf.limit(0), exons.limit(0), "hg").count() == 0
    with pytest.raises(ValueError):
        splicing.splice(maf, exons, "hg", "x")


@pytest.mark.parametrize(
    "rows, why",
    [
        (block(0, 10, {"hg": "ACGT"}) + block(1, 12, {"hg": "ACGT"}), "overlap"),
        (block(0, 10, {"hg": "AC"}) + block(1, 12, {"hg": "AC"}, "-"), "mixed"),
        (block(0, 10, {"hg": "AC", "mm": "AC"}) + block(0, 10, {"mm": "AC"}), "twice"),
        ([("f", 0, 0, "hg", 10, 3, "+", "AC", "x")], "number of its letters"),
    ],
)
def test_splice_refuses(spark, rows, why):
    exons = spark.createDataFrame([("a", 0, 8, 20, None)], EXONS)
    with pytest.raises(Exception, match=why):
        splicing.splice(spark.createDataFrame(rows, MAF), exons, "hg").collect()


def test_query_splices_every_document(spark, tmp_path):
    """Ids of every remainder, blocks that end inside or before an exon, missing neighbours, and no text at all."""
    texts = {0: "A" * 40, 1: "C" * 10, 2: "G" * 30, 4: "", 5: None}
    spark.createDataFrame([*texts.items(), (None, "ACGT" * 10)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {(r["splice"], r["src"]): r["seq"] for r in registry.queries()["spliced_extraction"](spark, str(tmp_path)).collect()}
    part = lambda k, fill: ((texts.get(k) or "")[5:25]).ljust(20, fill)
    for k in texts:
        assert rows[k, "target"] == part(k, "N") + part(k + 1, "N")
    other = lambda k: part(k, "-").translate(str.maketrans("GATC", "CTAG"))
    assert {k for k, src in rows if src == "other"} == {0, 1, 2}
    for k in (0, 1, 2):
        assert rows[k, "other"] == other(k) + other(k + 1)
