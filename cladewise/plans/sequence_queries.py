"""Queries on sequences, alignments, motifs and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cladewise.functions import alphabet, mathx
from cladewise.operators import alignments, motifs, ranges, running
from cladewise.registry import query

from . import bindings as b

r6 = lambda x: F.round(x, 6) + F.lit(0.0)


@query(f"WITH {b.SITES} SELECT letter, count(*) AS n FROM sites GROUP BY letter")
def letter_tally(spark: SparkSession, folder: str) -> DataFrame:
    return alignments.letter_tally(b.sequences(spark, folder), "ACGTN-")


@query(f"WITH {b.SEQ} SELECT kmer, count(*) AS n FROM (SELECT substr(seq, i, 3) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM seqs)) GROUP BY kmer")
def kmer_tally_k3(spark: SparkSession, folder: str) -> DataFrame:
    return alignments.kmer_tally(b.sequences(spark, folder), 3)


@query(f"WITH {b.SEQ} SELECT doc_id, translate(seq, 'GATC-', '01234') AS codes, translate(seq, 'GATC', 'CTAG') AS complement FROM seqs")
def encode_complement(spark: SparkSession, folder: str) -> DataFrame:
    s = b.sequences(spark, folder)
    return s.select("doc_id", F.translate("seq", alphabet.NUCLEOTIDES, "01234").alias("codes"), alphabet.complement(F.col("seq")).alias("complement"))


@query(f"WITH {b.SEQ} SELECT doc_id, reverse(translate(seq, 'GATC', 'CTAG')) AS revcomp FROM seqs")
def reverse_complement(spark: SparkSession, folder: str) -> DataFrame:
    return b.sequences(spark, folder).select("doc_id", alphabet.reverse_complement(F.col("seq")).alias("revcomp"))


@query(f"WITH {b.SITES} SELECT pos, letter, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY pos), 6) AS freq FROM sites GROUP BY pos, letter")
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    return alignments.profile(b.sites(spark, folder)).select("pos", "letter", "n", F.round("freq", 6).alias("freq"))


@query(f"WITH {b.CELLS} SELECT array_to_string(codes, ',') AS pattern, count(*) AS n FROM blocks GROUP BY codes")
def alignment_pattern_counts(spark: SparkSession, folder: str) -> DataFrame:
    p = alignments.patterns(b.alignment_blocks(spark, folder))
    return p.select(F.array_join("codes", ",").alias("pattern"), "n")


@query(f"""WITH {b.CELLS}, k AS (SELECT aln, codes, row_number() OVER (PARTITION BY aln ORDER BY pos) - 1 AS pos FROM blocks WHERE codes[1] <> 4)
SELECT aln, pos, i - 1 AS species, codes[i] AS code FROM (SELECT *, unnest(range(1, 9)) AS i FROM k)""")
def strip_reference_gaps(spark: SparkSession, folder: str) -> DataFrame:
    a = alignments.strip_gaps(b.alignment_blocks(spark, folder), 0)
    return a.select("aln", "pos", F.posexplode("codes").alias("species", "code")).withColumn("species", F.col("species").cast("long"))


@query(f"""WITH {b.SITES}, m AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM sites WHERE letter IN ('-', 'N')),
i AS (SELECT doc_id, island, min(pos) AS start, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 3)
SELECT doc_id, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_masked, min(start) AS first_start FROM i GROUP BY doc_id""")
def mask_gap_runs(spark: SparkSession, folder: str) -> DataFrame:
    return alignments.gap_runs(b.sequences(spark, folder), 3)


@query(f"""WITH {b.SEQ} SELECT doc_id, array_to_string(list_transform(regexp_extract_all(seq, '[-N]+|[^-N]+'),
lambda x: CASE WHEN regexp_matches(x, '^[-N]') AND length(x) >= 3 THEN repeat('N', length(x)) ELSE x END), '') AS masked FROM seqs""")
def masked_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences with runs of three gaps or missing letters and more as N."""
    return b.sequences(spark, folder).select("doc_id", alignments.mask_gaps(F.col("seq"), 3).alias("masked"))


_ALPHA = [0.2] * 5
_LG = " + ".join(f"lgamma(c{k} + 0.2)" for k in range(5)) + " - lgamma(c0 + c1 + c2 + c3 + c4 + 1.0) - 5 * lgamma(0.2) + lgamma(1.0)"


@query(f"WITH {b.counts_sql('user_id, day')} SELECT user_id, CAST(day AS VARCHAR) AS day, round({_LG}, 6) + 0.0 AS logml FROM counts")
def dirichlet_multinomial_logml(spark: SparkSession, folder: str) -> DataFrame:
    c = b.counts(spark, folder, ("user_id", "day"))
    return c.select("user_id", F.col("day").cast("string").alias("day"), r6(mathx.dirichlet_multinomial(b.count_columns(), _ALPHA)).alias("logml"))


_N = "(c0 + c1 + c2 + c3 + c4)"


@query(f"WITH {b.counts_sql()} SELECT user_id, " + ", ".join(f"round((c{k} + 0.2) / ({_N} + 1.0), 6) AS p{k}" for k in range(5)) + " FROM counts")
def posterior_mean_probs(spark: SparkSession, folder: str) -> DataFrame:
    p = motifs.posterior_mean(b.count_columns(), _ALPHA)
    return b.counts(spark, folder).select("user_id", *(F.round(x, 6).alias(f"p{k}") for k, x in enumerate(p)))


_P = [f"((c{k} + 0.2) / ({_N} + 1.0))" for k in range(5)]


@query(f"WITH {b.counts_sql()} SELECT user_id, round(-(" + " + ".join(f"{p} * ln({p})" for p in _P) + "), 6) AS entropy FROM counts")
def column_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return b.counts(spark, folder).select("user_id", F.round(mathx.entropy(motifs.posterior_mean(b.count_columns(), _ALPHA)), 6).alias("entropy"))


@query(f"WITH {b.counts_sql()} SELECT user_id, round(" + " + ".join(f"{p} * log2({p} / 0.2)" for p in _P) + ", 6) + 0.0 AS information FROM counts")
def information_content(spark: SparkSession, folder: str) -> DataFrame:
    p = motifs.posterior_mean(b.count_columns(), _ALPHA)
    return b.counts(spark, folder).select("user_id", r6(mathx.kl_divergence(p, [F.lit(0.2)] * 5)).alias("information"))


_ALIGNED = ", ".join(f"(c{k} + 0.2) / ({_N} + 1.0) AS p{k}" for k in range(5))
_A, _Q = [f"coalesce(x.p{k}, 0.2)" for k in range(5)], [f"coalesce(y.p{k}, 0.2)" for k in range(5)]


@query(f"""WITH {b.counts_sql('user_id, day')}, m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY day) AS pos, {_ALIGNED} FROM counts),
pair AS (SELECT DISTINCT user_id AS u, user_id + 1 AS v, k FROM m, (VALUES (-1), (0), (1)) s(k) WHERE user_id + 1 IN (SELECT user_id FROM m)),
x AS (SELECT u, v, k, pos, {", ".join(f"p{k}" for k in range(5))} FROM pair JOIN m ON m.user_id = u),
y AS (SELECT u, v, k, pos + k AS pos, {", ".join(f"p{k}" for k in range(5))} FROM pair JOIN m ON m.user_id = v)
SELECT coalesce(x.u, y.u) AS first, coalesce(x.v, y.v) AS second, coalesce(x.k, y.k) AS shift, round(avg({" + ".join(f"{a} * log2({a} / {q})" for a, q in zip(_A, _Q))}), 6) + 0.0 AS kl
FROM x FULL JOIN y ON x.u = y.u AND x.v = y.v AND x.k = y.k AND x.pos = y.pos GROUP BY ALL""")
def motif_kl_shift(spark: SparkSession, folder: str) -> DataFrame:
    c = b.counts(spark, folder, ("user_id", "day"))
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    m = c.select(F.col("user_id").alias("motif"), pos.alias("pos"), *(p.alias(f"p{k}") for k, p in enumerate(motifs.posterior_mean(b.count_columns(), _ALPHA))))
    pairs = m.select(F.col("motif").alias("first")).distinct().join(m.select((F.col("motif") - 1).alias("first")).distinct(), "first", "left_semi")
    return motifs.shifted_kl(m, pairs.withColumn("second", F.col("first") + 1), (-1, 0, 1)).withColumn("kl", r6("kl"))


PWM = motifs.pwm_from_counts([[8, 1, 1, 2], [1, 9, 1, 1], [2, 1, 8, 1], [1, 1, 1, 9]], 0.5)


@query(f"""WITH {b.SEQ}, s AS (SELECT doc_id, i AS pos, substr(seq, i, 4) AS w FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 2)) AS i FROM seqs)),
v AS (SELECT doc_id, pos, round({motifs.pwm_sql(PWM, "w")}, 6) + 0.0 AS score FROM s WHERE NOT regexp_matches(w, '[-N]'))
SELECT doc_id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS k FROM v) WHERE k <= 3""")
def pwm_scan_topk(spark: SparkSession, folder: str) -> DataFrame:
    return motifs.pwm_best(b.sequences(spark, folder), PWM, 3)


@query(f"""WITH {b.SEQ}, s AS (SELECT doc_id, i AS pos, substr(seq, i, 4) AS w FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 2)) AS i FROM seqs)),
v AS (SELECT doc_id, pos, round({motifs.pwm_sql(PWM, "w")}, 6) + 0.0 AS score FROM s WHERE NOT regexp_matches(w, '[-N]')) SELECT doc_id, pos, score FROM v WHERE score >= 5.0""")
def pwm_scan_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Every window whose score reaches a threshold."""
    return motifs.pwm_scan(b.sequences(spark, folder), PWM).select("doc_id", F.col("pos").cast("long").alias("pos"), r6("score").alias("score")).where("score >= 5.0")


@query(f"""WITH {b.counts_sql('user_id, day')}, m AS (SELECT user_id, day, {_LG} AS s FROM counts)
SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN count(*) OVER w = 3 THEN round(sum(s) OVER w, 6) ELSE 0.0 END + 0.0 AS score FROM m
WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)""")
def motif_scan_window(spark: SparkSession, folder: str) -> DataFrame:
    c = b.counts(spark, folder, ("user_id", "day")).withColumn("s", mathx.dirichlet_multinomial(b.count_columns(), _ALPHA))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(0, 2)
    score = F.when(F.count("*").over(w) == 3, F.round(F.sum("s").over(w), 6)).otherwise(0.0) + F.lit(0.0)
    return c.select("user_id", F.col("day").cast("string").alias("day"), score.alias("score"))


@query(f"""WITH {b.SITES}, l AS (SELECT letter, lag(letter, 1) OVER w AS a, lag(letter, 2) OVER w AS b2 FROM sites WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT b2 || a AS context, letter, count(*) AS n FROM l WHERE a IN ('A','C','G','T') AND b2 IN ('A','C','G','T') AND letter IN ('A','C','G','T') GROUP BY ALL""")
def markov_context_counts(spark: SparkSession, folder: str) -> DataFrame:
    return alignments.context_counts(b.sequences(spark, folder), 2)


_REGIONS = "regions AS (SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS BIGINT) AS start, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS stop FROM documents)"


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    """Half-open intervals: the documents end to end."""
    d = b.table(spark, folder, "documents").select("doc_id", "n_chars")
    d = running.running_sum(d, F.col("n_chars"), "doc_id")
    return d.select("doc_id", (F.col("running") - F.col("n_chars")).alias("start"), F.col("running").alias("stop"))


@query(f"WITH {_REGIONS} SELECT doc_id, {ranges.bin_sql('start', 'stop')} AS bin FROM regions WHERE stop > start")
def ucsc_bin(spark: SparkSession, folder: str) -> DataFrame:
    return _regions(spark, folder).where("stop > start").select("doc_id", ranges.smallest_bin(F.col("start"), F.col("stop")).alias("bin"))


@query(f"""WITH {_REGIONS}, q AS (SELECT item_id, item_id * 50000 AS qs, item_id * 50000 + 3000 AS qe FROM benchmark)
SELECT item_id, doc_id, start, stop FROM q JOIN regions ON start < qe AND stop > qs AND stop > start""")
def range_lookup(spark: SparkSession, folder: str) -> DataFrame:
    q = b.table(spark, folder, "benchmark").select("item_id", (F.col("item_id") * 50000).alias("qs"), (F.col("item_id") * 50000 + 3000).alias("qe"))
    found = ranges.bin_range_join(q, _regions(spark, folder).where("stop > start"), "qs", "qe", "start", "stop")
    return found.select("item_id", "doc_id", "start", "stop")


@query(f"WITH {b.SITES} SELECT doc_id, pos, CAST(sum(CASE WHEN letter <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) - 1 AS ref_pos FROM sites")
def ref_coordinate(spark: SparkSession, folder: str) -> DataFrame:
    return alignments.reference_coordinates(b.sites(spark, folder)).select("doc_id", "pos", "ref_pos")


@query(f"""WITH {b.SEQ}, u AS (SELECT doc_id, replace(seq, '-', '') AS seq FROM seqs)
SELECT doc_id, array_to_string(list_transform(range(0, length(seq) // 3), lambda i: CASE WHEN instr(substr(seq, 3 * i + 1, 3), 'N') > 0 THEN 'X' ELSE
substr('{alphabet.CODON_ACIDS}', 16 * (instr('{alphabet.CODON_BASES}', seq[3 * i + 1]) - 1) + 4 * (instr('{alphabet.CODON_BASES}', seq[3 * i + 2]) - 1) + instr('{alphabet.CODON_BASES}', seq[3 * i + 3]), 1) END), '') AS protein FROM u""")
def codon_translate(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps go first; a codon with N gives X and an incomplete last codon nothing."""
    s = b.sequences(spark, folder).select("doc_id", alphabet.ungap(F.col("seq")).alias("seq"))
    return alphabet.translate_codons(s, "seq", "protein")


@query(f"""WITH {b.SEQ} SELECT doc_id, lower(replace(seq, '-', '')) AS ungapped, regexp_replace(seq, '[^GATC]', 'N', 'g') AS masked,
substr(replace(seq, '-', ''), 6, 10) AS part, length(regexp_replace(seq, '[^GATC]', '', 'g')) AS n_letters FROM seqs""")
def sequence_helpers(spark: SparkSession, folder: str) -> DataFrame:
    s, ungapped = b.sequences(spark, folder), alphabet.ungap(F.col("seq"))
    letters = F.length(F.regexp_replace("seq", "[^GATC]", "")).cast("long")
    return s.select("doc_id", F.lower(ungapped).alias("ungapped"), F.regexp_replace("seq", "[^GATC]", "N").alias("masked"), F.substring(ungapped, 6, 10).alias("part"), letters.alias("n_letters"))


@query(f"WITH {b.CELLS} SELECT aln, pos, codes[4] AS code FROM blocks WHERE pos BETWEEN 10 AND 19")
def species_slice(spark: SparkSession, folder: str) -> DataFrame:
    """One species of every alignment over a range of positions."""
    return alignments.site_slice(b.alignment_blocks(spark, folder), 10, 20).select("aln", F.col("pos").cast("long").alias("pos"), F.col("codes")[3].alias("code"))


@query(f"""WITH {b.SEQ}, k AS (SELECT substr(seq, i, 3) AS w FROM (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM seqs))
SELECT 16 * (instr('GATC', w[1]) - 1) + 4 * (instr('GATC', w[2]) - 1) + instr('GATC', w[3]) - 1 AS code, count(*) AS n FROM k WHERE regexp_full_match(w, '[GATC][GATC][GATC]') GROUP BY 1""")
def context_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Words of three plain letters by their number in base 4."""
    k = alignments.kmer_tally(b.sequences(spark, folder), 3).where(F.col("kmer").rlike("^[GATC]{3}$"))
    digit = lambda i: F.instr(F.lit("GATC"), F.substring("kmer", i, 1)) - 1
    return k.select((16 * digit(1) + 4 * digit(2) + digit(3)).cast("long").alias("code"), "n")


@query(f"WITH {b.SEQ} SELECT doc_id, printf('%10s (%2d): %s', coalesce(source, ''), CAST(doc_id % 100 AS INT), seq) AS line FROM seqs JOIN documents USING (doc_id)")
def pretty_alignment(spark: SparkSession, folder: str) -> DataFrame:
    d = b.table(spark, folder, "documents")
    seq = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGTN-]", "")
    return d.select("doc_id", F.format_string("%10s (%2d): %s", F.coalesce("source", F.lit("")), F.col("doc_id") % 100, seq).alias("line"))


TAXA = ("src0", "src1", "src2", "src999")


@query(f"""WITH {b.SEQ}, r AS (SELECT lang, source AS taxon, doc_id, seq FROM seqs JOIN documents USING (doc_id)), f AS (SELECT lang, taxon, arg_min(seq, doc_id) AS seq FROM r WHERE taxon IN {TAXA} GROUP BY ALL),
a AS (SELECT lang, max(length(seq)) AS n FROM f GROUP BY lang) SELECT a.lang, t.taxon, coalesce(f.seq, repeat('N', a.n)) AS seq FROM a, (SELECT unnest({list(TAXA)}) AS taxon) t LEFT JOIN f ON f.lang = a.lang AND f.taxon = t.taxon""")
def alignment_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Records on the taxa of a tree: the first of a taxon stays, unknown taxa go, missing taxa are N."""
    d = b.table(spark, folder, "documents").select("doc_id", "lang", F.col("source").alias("taxon"))
    records = d.join(b.sequences(spark, folder), "doc_id").select(F.col("lang").alias("aln"), "taxon", F.col("doc_id").alias("rec"), "seq")
    return alignments.on_taxa(records, TAXA).withColumnRenamed("aln", "lang")


@query(f"""WITH {b.SEQ}, r AS (SELECT lang, source AS taxon, doc_id, seq FROM seqs JOIN documents USING (doc_id)), f AS (SELECT lang, taxon, arg_max(seq, doc_id) AS seq FROM r WHERE taxon IN {TAXA} GROUP BY ALL),
a AS (SELECT lang, max(length(seq)) AS n FROM f GROUP BY lang) SELECT a.lang, t.taxon, coalesce(f.seq, repeat('N', a.n)) AS seq FROM a, (SELECT unnest({list(TAXA)}) AS taxon) t LEFT JOIN f ON f.lang = a.lang AND f.taxon = t.taxon""")
def alignment_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """As ``alignment_fill``, but a later record of a taxon takes the place of an earlier one."""
    d = b.table(spark, folder, "documents").select("doc_id", "lang", F.col("source").alias("taxon"))
    records = d.join(b.sequences(spark, folder), "doc_id").select(F.col("lang").alias("aln"), "taxon", F.col("doc_id").alias("rec"), "seq")
    return alignments.on_taxa(records, TAXA, last=True).withColumnRenamed("aln", "lang")


@query("SELECT array_to_string(list_sort(list(DISTINCT source)), ' ') AS taxa, count(DISTINCT source) AS n FROM documents WHERE source IS NOT NULL")
def taxa_list(spark: SparkSession, folder: str) -> DataFrame:
    """The taxa of all records, in order."""
    found = alignments.distinct_taxa(b.table(spark, folder, "documents").select(F.col("source").alias("taxon")))
    return found.select(F.array_join("taxa", " ").alias("taxa"), F.size("taxa").cast("long").alias("n"))


@query(f"WITH {b.SEQ} SELECT doc_id, split_part(lower(coalesce(source, '')) || '.chr' || doc_id, '.', 1) AS name, length(replace(seq, '-', '')) AS letters FROM seqs JOIN documents USING (doc_id)")
def reference_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Record names without their contigs, and the letters of each record that aren't gaps."""
    d = b.table(spark, folder, "documents")
    seq = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGTN-]", "")
    name = F.split_part(F.concat(F.lower(F.coalesce("source", F.lit(""))), F.lit(".chr"), F.col("doc_id").cast("string")), F.lit("."), F.lit(1))
    return d.select("doc_id", name.alias("name"), F.length(alphabet.ungap(seq)).cast("long").alias("letters"))


@query(f"""WITH {b.CELLS} SELECT aln, pos, array_to_string(list_transform(codes, lambda c, k: CASE WHEN pos % 5 = 0 AND k = 3 THEN 4 WHEN pos % 5 = 0 AND k = 1 THEN 0 ELSE c END), ',') AS codes FROM blocks""")
def alignment_cells_set(spark: SparkSession, folder: str) -> DataFrame:
    """Two cells of every fifth column are written over."""
    a = b.alignment_blocks(spark, folder)
    cells = a.where("pos % 5 = 0").select("aln", "pos", F.explode(F.create_map(F.lit(2), F.lit(4), F.lit(0), F.lit(0))).alias("species", "code"))
    new = alignments.set_cells(a, cells)
    return new.select("aln", F.col("pos").cast("long").alias("pos"), F.array_join("codes", ",").alias("codes"))


@query(f"""WITH {b.CELLS}, a AS (SELECT aln, pos, array_to_string(codes, '') AS codes FROM blocks), n AS (SELECT aln, max(pos) + 1 AS behind FROM a GROUP BY aln)
SELECT aln, pos, codes FROM a UNION ALL SELECT aln, pos + behind, codes FROM a JOIN n USING (aln) WHERE pos < 20""")
def append_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Every alignment and behind it its own first columns."""
    a = b.alignment_blocks(spark, folder)
    return alignments.append(a, alignments.site_slice(a, 0, 20)).select("aln", F.col("pos").cast("long").alias("pos"), F.array_join("codes", "").alias("codes"))


@query(f"""WITH {b.SEQ}
SELECT doc_id, translate(seq, 'GATC', '') = '' AS is_dna, md5(array_to_string(list_transform(range(1, length(seq) + 1), lambda i: strpos('GATC', substr(seq, i, 1)) - 1), ',')) AS places,
md5(regexp_replace(seq, '[^GATC]', '', 'g')) AS letters, CASE WHEN translate(seq, 'GATC', '') = '' THEN 'dna' WHEN translate(seq, 'GATC-', '') = '' THEN 'gapped' WHEN translate(seq, 'GATC-N', '') = '' THEN 'missing' END AS alphabet FROM seqs""")
def alphabet_helpers(spark: SparkSession, folder: str) -> DataFrame:
    """Every sequence: whether it is of four letters, digests of its letters' places and of the letters they give, and the first alphabet that has all of them."""
    places, seq = alphabet.ordinals(F.col("seq"), "GATC"), F.col("seq")
    kinds = {"dna": "GATC", "gapped": "GATC-", "missing": "GATC-N"}
    s = b.sequences(spark, folder)
    return s.select("doc_id", alphabet.alphabetic(seq, "GATC").alias("is_dna"), F.md5(F.array_join(places, ",")).alias("places"), F.md5(alphabet.characters(places, "GATC")).alias("letters"), alphabet.first_alphabet(seq, kinds).alias("alphabet"))


@query(f"""WITH {b.SITES}, e AS (SELECT doc_id, doc_id % 20 AS first FROM seqs WHERE length(seq) >= 40)
SELECT s.doc_id AS seq, s.pos, coalesce(s.pos = e.first, false) AS is_start, NOT coalesce(s.pos BETWEEN e.first AND e.first + 9, false) AS is_background
FROM sites s LEFT JOIN e ON e.doc_id = s.doc_id""")
def site_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Which places of every sequence start an element, and which none covers."""
    s = b.sites(spark, folder).select(F.col("doc_id").alias("seq"), "pos")
    elements = b.sequences(spark, folder).where(F.length("seq") >= 40).select(F.col("doc_id").alias("seq"), (F.col("doc_id") % 20).cast("int").alias("pos"))
    return motifs.site_kinds(s, elements, 10)
