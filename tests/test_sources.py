"""Text formats: what is read, and that what is written reads back the same."""

import pytest

from cladewise.sources import fasta, genome, partitions


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text("\n\n>hg.chr1|first |x\nACG T\r\n\nNN\n>>>>>>\n>mm.chr2.b\nAC\n>solo\n>end\n" + "A" * 170 + "\n")
    rows = fasta.read_fasta(spark, str(path)).orderBy("at", "rec").collect()
    assert [(r["taxon"], r["contig"], r["seq"]) for r in rows] == [("hg", "chr1", "ACGTNN"), ("mm", "chr2.b", "AC"), ("solo", None, ""), ("end", None, "A" * 170)]
    assert rows[0]["desc"] == ["hg.chr1", "first", "x"]
    fasta.write_fasta(fasta.read_fasta(spark, str(path)), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.txt"))
    assert max(map(len, text.split("\n"))) == 80
    again = fasta.read_fasta(spark, str(tmp_path / "out"))
    key = lambda r: (r["taxon"], r["contig"] or "", r["seq"])
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))


def test_fasta_of_nothing(spark, tmp_path):
    (tmp_path / "e.fa").write_text("")
    assert fasta.read_fasta(spark, str(tmp_path / "e.fa")).count() == 0


def test_counts(spark, tmp_path):
    (tmp_path / "c.fa").write_text("> one\n1 2 3.5 0 1e-1 ; bad ;\n0 0 0 0 1 ;\n>\n1 1 1 1 1;\n")
    rows = fasta.read_counts(spark, str(tmp_path / "c.fa")).orderBy("at", "rec", "pos").collect()
    assert [(r["pos"], r["counts"]) for r in rows] == [(0, [1, 2, 3.5, 0, 0.1]), (1, [0, 0, 0, 0, 1]), (0, [1, 1, 1, 1, 1])]
    lines = [r["value"] for r in fasta.count_lines(fasta.read_counts(spark, str(tmp_path / "c.fa"))).collect()]
    (tmp_path / "d.fa").write_text("\n".join(lines))
    again = fasta.read_counts(spark, str(tmp_path / "d.fa"))
    assert sorted(r["counts"] for r in again.collect()) == sorted(r["counts"] for r in rows)


def test_bed(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nchrM\t1669\t3228\nchr1 5 9 name\nscaffold 1 2\n")
    assert [tuple(r) for r in genome.read_bed(spark, str(tmp_path / "a.bed")).orderBy("start").collect()] == [("chr1", 5, 9), ("chrM", 1669, 3228)]


def test_maf(spark, tmp_path):
    path = tmp_path / "a.maf"
    path.write_text("##maf version=1\n\na score=1\ns hg.chr1 10 4 + 100 AC-GT\ns mm.chr2 5 3 - 90 ..-T.\ni mm x\n\n\na\ns hg.chr1 20 2 + 100 AA\n")
    rows = genome.read_maf(spark, str(path)).orderBy("at", "block", "rec").collect()
    assert [(r["src"], r["start"], r["size"], r["strand"], r["src_size"], r["text"]) for r in rows] == [
        ("hg.chr1", 10, 4, "+", 100, "AC-GT"),
        ("mm.chr2", 5, 3, "-", 90, "AC-TT"),
        ("hg.chr1", 20, 2, "+", 100, "AA"),
    ]
    genome.write_maf(genome.read_maf(spark, str(path)), str(tmp_path / "out"))
    again = genome.read_maf(spark, str(tmp_path / "out")).select("src", "start", "rec", "text")
    assert sorted(map(tuple, again.collect())) == sorted((r["src"], r["start"], r["rec"], r["text"]) for r in rows)
    assert genome.maf_to_sequences(genome.read_maf(spark, str(path))).where("taxon = 'mm' AND contig = 'chr2'").count() == 1
    (tmp_path / "bad.maf").write_text("a\ns hg.chr1 10 4 + AC\n")
    with pytest.raises(Exception, match="seven fields"):
        genome.read_maf(spark, str(tmp_path / "bad.maf")).collect()


def test_partitions(spark, tmp_path):
    lines = ["base:10:{(0, 3), (1, 12)!}, other:8:{(2, 0)}", "-", "base:10:{}"]
    (tmp_path / "p.txt").write_text("\n".join(lines) + "\n\n")
    found = partitions.read_partitions(spark, str(tmp_path / "p.txt"))
    rows = partitions.partition_elements(found).orderBy("line", "cluster", "seq").collect()
    assert [(r["cluster"], r["model"], r["length"], r["seq"], r["pos"], r["reverse"]) for r in rows] == [
        (0, "base", 10, 0, 3, False),
        (0, "base", 10, 1, 12, True),
        (1, "other", 8, 2, 0, False),
    ]
    assert [r["value"] for r in partitions.partition_lines(found.orderBy("line")).collect()] == lines


def test_names_are_cleared_before_the_first_dot(spark):
    from cladewise.sources.genome import clear_names

    rows = clear_names(spark.createDataFrame([("hg19.chr1.x",), ("mm",), ("",), (None,)], "src string")).collect()
    assert [r["src"] for r in rows] == ["hg19", "mm", "", None]
