"""Nucleotide and protein alphabets as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters in the order of their codes. N (nucleotides) and X (proteins) are missing data, code -1.
NUCLEOTIDES, MISSING = "GATC-", "N"
AMINO_ACIDS, MISSING_AMINO = "ARNDCQEGHILKMFPSTWYV-", "X"
#: Fixed values of the standard genetic code: first, second and third base in the order TCAG.
CODON_BASES = "TCAG"
CODON_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def code(letter: Column, alphabet: str = NUCLEOTIDES) -> Column:
    """Code of a letter of either case; -1 for missing data, null for a letter outside the alphabet."""
    missing = MISSING if alphabet == NUCLEOTIDES else MISSING_AMINO
    place = F.instr(F.lit(alphabet), F.upper(letter)) - 1
    return F.when(F.upper(letter) == missing, F.lit(-1)).when(place >= 0, place)


def decode(value: Column, alphabet: str = NUCLEOTIDES) -> Column:
    missing = MISSING if alphabet == NUCLEOTIDES else MISSING_AMINO
    return F.when(value == -1, F.lit(missing)).when((value >= 0) & (value < len(alphabet)), F.substring(F.lit(alphabet), value + 1, F.lit(1)))


def encode_sequence(seq: Column) -> Column:
    """Codes of a whole sequence as an array."""
    return F.transform(F.split(seq, ""), lambda x: code(x))


def is_nucleotide(letter: Column) -> Column:
    return letter.rlike("^[ACGTacgt]$")


def complement(seq: Column) -> Column:
    """G and C, A and T change places; gaps and missing data stay."""
    return F.translate(seq, "GATCgatc", "CTAGctag")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def ungap(seq: Column) -> Column:
    return F.regexp_replace(seq, "[-.]", "")


def wrap(seq: Column, width: int = 80) -> Column:
    """The sequence broken into lines."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def _codon_codes() -> np.ndarray:
    """Letter of each triple of places in CODON_BASES; place 4 is of any other letter."""
    out = np.full((5, 5, 5), ord("X"), np.uint8)
    out[:4, :4, :4] = np.frombuffer(CODON_ACIDS.encode(), np.uint8).reshape(4, 4, 4)
    return out


def translated(texts: pa.Array) -> pa.Array:
    """Amino acids of ASCII or other texts, read in frame: all codons of an array at once."""
    texts = texts.cast(pa.large_string())
    ascii_only = pc.all(pc.string_is_ascii(texts)).as_py()
    if ascii_only is False:  # places are those of letters, not of bytes
        texts = pc.replace_substring_regex(texts, "[^\\x00-\\x7F]", "N")
    place = np.full(256, 4, np.intp)
    for k, c in enumerate(CODON_BASES):
        place[[ord(c), ord(c.lower())]] = k
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.diff(offsets) // 3
    ends = np.r_[0, np.cumsum(sizes)]
    data = texts.buffers()[2]
    letters = place[np.frombuffer(data, np.uint8)] if data is not None and ends[-1] else np.zeros(0, np.intp)
    first = np.repeat(offsets[:-1] - 3 * ends[:-1], sizes) + 3 * np.arange(ends[-1])
    acids = _codon_codes()[letters[first], letters[first + 1], letters[first + 2]] if ends[-1] else np.zeros(0, np.uint8)
    valid = texts.is_valid() if texts.null_count else None
    out = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(acids))])
    return pc.if_else(valid, out, pa.scalar(None, pa.large_string())) if valid is not None else out


def translate_codons(rows: DataFrame, seq: str, name: str) -> DataFrame:
    """``rows`` with the amino acids of the sequences in ``seq``, read in frame, as ``name`` in their place; unknown codons give X, an incomplete last codon nothing."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != seq)

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [n for n in batch.schema.names if n != seq]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), translated(batch.column(seq)).cast(pa.string())], [*others, name])

    return rows.mapInArrow(translate, f"{fields}, `{name}` string")


def alphabetic(seq: Column, alphabet: str) -> Column:
    """Whether every letter belongs to the alphabet, in either case; true for an empty sequence."""
    return F.translate(F.upper(seq), alphabet.upper(), "") == ""


def ordinals(seq: Column, alphabet: str) -> Column:
    """Places of the letters in the alphabet as an array, -1 for others."""
    return F.transform(F.filter(F.split(seq, ""), lambda x: x != ""), lambda x: (F.instr(F.lit(alphabet), F.upper(x)) - 1).cast("int"))


def characters(places: Column, alphabet: str) -> Column:
    """The letters at these places; a place outside the alphabet gives no letter."""
    return F.array_join(F.transform(places, lambda k: F.when(k >= 0, F.substring(F.lit(alphabet), k + 1, F.lit(1))).otherwise("")), "")


def first_alphabet(seq: Column, alphabets: dict[str, str]) -> Column:
    """Name of the first alphabet that has all letters of the sequence; null if none has."""
    return F.coalesce(*(F.when(alphabetic(seq, letters), F.lit(name)) for name, letters in alphabets.items()))
