"""Scalar functions on nucleotide strings, as column expressions. Null in, null out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.params import EffectiveRange

BASES = "ACGT"


def bases(seq: Column) -> Column:
    """Upper case, with everything but A, C, G and T as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    """Complement read backwards; N stays N."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCATGCA")


def effective_range(seq: Column, used: EffectiveRange, quality: bool = False) -> Column:
    """The used ranges joined; on the minus strand the reverse complement (of a quality, the reverse)."""
    parts = [F.substring(seq, F.lit(a + 1), (F.length(seq) if b == -1 else F.lit(b + 1)) - a) for a, b in used.ranges]
    joined = F.concat(*parts)
    if used.strand == "-":
        return F.reverse(joined) if quality else reverse_complement(joined)
    return joined


def seed_encode(seq: Column, length: int) -> Column:
    """First ``length`` bases, two bits each (A 0, C 1, G 2, T 3); others and missing ones count as A. length <= 31."""
    padded = F.rpad(F.translate(F.upper(F.substring(seq, 1, length)), "N", "A"), length, "A")
    digits = F.regexp_replace(F.translate(padded, BASES, "0123"), "[^0-3]", "0")
    return F.conv(digits, 4, 10).cast("long")


def seed_decode(seed: Column, length: int) -> Column:
    """The bases of a two-bit seed."""
    return F.translate(F.lpad(F.conv(seed.cast("string"), 10, 4), length, "0"), "0123", BASES)


def n_positions(seq: Column) -> Column:
    """0-based positions of N in ascending order."""
    at = F.sequence(F.lit(1), F.length(seq))
    return F.when(F.contains(seq, F.lit("N")), F.transform(F.filter(at, lambda i: F.substring(seq, i, F.lit(1)) == "N"), lambda i: i - 1)).when(seq.isNotNull(), F.array().cast("array<int>"))


def trim(seq: Column, length: int | Column) -> Column:
    """At most the first ``length`` characters."""
    return F.substring(seq, F.lit(1), F.lit(length) if isinstance(length, int) else length)


def replace_base(seq: Column, position: Column, base: Column) -> Column:
    """``seq`` with the base at a 0-based position overwritten."""
    return F.overlay(seq, base, position + 1, F.lit(1))


def gc_fraction(seq: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    gc = F.length(seq) - F.length(F.translate(seq, "GCgc", ""))
    return F.when(F.length(seq) > 0, gc / F.length(seq))


def hash64(key: Column, bits: int) -> Column:
    """The invertible integer mix used for k-mers of ``bits`` / 2 bases, below 2^bits; bits <= 60.

    Fixed values: the shifts. A left shift is masked before it happens, so nothing overflows.
    """
    mask = (1 << bits) - 1
    keep: Callable[[Column], Column] = lambda x: x.bitwiseAND(F.lit(mask).cast("long"))
    left = lambda x, n: F.shiftleft(x.bitwiseAND(F.lit(mask >> n).cast("long")), n) if bits > n else F.lit(0).cast("long")
    right = lambda x, n: x.bitwiseXOR(F.shiftright(x, n))
    x = keep(F.lit(mask).cast("long") - keep(key) + left(key, 21))
    x = right(x, 24)
    x = keep(x + left(x, 3) + left(x, 8))
    x = right(x, 14)
    x = keep(x + left(x, 2) + left(x, 4))
    x = right(x, 28)
    return keep(x + left(x, 31))


def clamped_quality(quality: Column) -> Column:
    """Phred score of one quality character within 3..40."""
    return F.greatest(F.lit(3), F.least(F.lit(40), F.ascii(quality) - 33))


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def longest_match(a: Column, b: Column) -> Column:
    """Length of the longest run of equal characters at equal positions."""
    pieces = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, F.lit("1")).otherwise(F.lit("0")))
    return F.array_max(F.transform(F.split(F.array_join(pieces, ""), "0"), F.length))


def cigar_length(cigar: Column, consuming: str) -> Column:
    """Summed lengths of the operations in ``consuming`` (``MDN=X`` of the reference, ``MIS=X`` of the query)."""
    parts = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{consuming}]"), 1)
    return F.aggregate(parts, F.lit(0), lambda n, x: n + x.cast("int"))
