"""A stored index of MAF blocks, blocks cut to regions, and FASTA files as MAF blocks."""

import pytest

from cladewise.sources import fasta, genome

MAF = """##maf version=1

a score=1
s hg19.chr1 100 6 + 1000 AC-GTAA
s mm9.chr4 7 6 - 900 ACT-TAA

a
s hg19.chr1 200 4 + 1000 GGTT
s mm9.chr4 20 3 - 900 GG-T

a
s mm9.chr4 40 3 - 900 GGT

a
s hg19.chr2 100 4 + 500 TTTT
"""


@pytest.fixture
def rows(spark, tmp_path):
    (tmp_path / "x.maf").write_text(MAF)
    return genome.read_maf(spark, str(tmp_path / "x.maf"))


def test_regions_are_cut_to_the_reference(spark, tmp_path, rows):
    index = str(tmp_path / "index")
    genome.write_index(rows, "hg19", index)
    regions = spark.createDataFrame([(1, "chr1", 102, 105), (2, "chr1", 0, 1000), (3, "chr2", 0, 100), (4, "chr1", 203, 900)], "id int, chrom string, start long, end long")
    found = genome.lookup(spark, index, "hg19", regions)
    cut = {(r["id"], r["src"], r["start"], r["size"], r["text"]) for r in genome.trim_to_regions(rows, found, "hg19").collect()}
    assert cut == {
        (1, "hg19.chr1", 102, 3, "-GTA"), (1, "mm9.chr4", 9, 3, "T-TA"), (2, "hg19.chr1", 100, 6, "AC-GTAA"), (2, "mm9.chr4", 7, 6, "ACT-TAA"),
        (2, "hg19.chr1", 200, 4, "GGTT"), (2, "mm9.chr4", 20, 3, "GG-T"), (4, "hg19.chr1", 203, 1, "T"), (4, "mm9.chr4", 22, 1, "T"),
    }
    with pytest.raises(Exception, match="not an index of mm9"):
        genome.lookup(spark, index, "mm9", regions).collect()


def test_fasta_files_as_blocks(spark, tmp_path):
    for name, text in (("a.fa", ">x.c1\nAC-G\n>y\nACTG\n"), ("b.fa", ">x.c2\nTT\n")):
        (tmp_path / name).write_text(text)
    maf = genome.sequences_to_maf(fasta.read_fasta(spark, str(tmp_path / "*.fa")))
    texts = sorted(r["value"] for r in genome.maf_lines(maf).collect())
    assert texts == ["a\ns x.c1 0 3 + 3 AC-G\ns y 0 4 + 4 ACTG\n", "a\ns x.c2 0 2 + 2 TT\n"]
