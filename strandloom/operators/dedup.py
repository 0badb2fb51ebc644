"""Duplicate removal, shifts, filters and order of mapping records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sort keys of the record kinds below the position, in the order that breaks ties.
PAIRED_TIES = ["mapq", "direction", "is_unique", "read_id", "positive_alignment_length", "negative_alignment_length"]
SINGLE_TIES = ["fragment_length", "mapq", "direction", "is_unique", "read_id"]
MOST_DUPS = 255


def _value(name: str) -> Column:
    """A sort value with null below all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-1).cast("long"))


def placed(df: DataFrame) -> DataFrame:
    """Records with a position and an extent; others are no mappings."""
    return df.filter("rid IS NOT NULL AND fragment_start_position IS NOT NULL AND fragment_length IS NOT NULL")


def mark_duplicates(df: DataFrame, key: list[str], ties: list[str], mode: str = "low_mem") -> DataFrame:
    """One record per key with ``n_copies`` (all copies) and ``num_dups`` (at most 255).

    ``low_mem`` keeps the record with the highest mapq, of equal ones the first in sort order;
    ``in_memory`` keeps the last in sort order. Null keys are equal to each other, null sort
    values are lowest. Remaining ties are broken by all other columns. The group's best record
    is an aggregate, so a hot key is reduced on every task before the shuffle.
    """
    rest = [c for c in df.columns if c not in key and c != "num_dups"]
    sort = [c for c in ties if c in rest]
    others = [c for c in rest if c not in sort]
    if mode == "low_mem":
        order = [(-_value(c) if c == "mapq" else _value(c)).alias(f"o{i}") for i, c in enumerate(["mapq", *(c for c in sort if c != "mapq")])]
        pick = F.min
    elif mode == "in_memory":
        order = [_value(c).alias(f"o{i}") for i, c in enumerate(sort)]
        pick = F.max
    else:
        raise ValueError(f"mode must be low_mem or in_memory, not {mode!r}")
    best = pick(F.struct(*order, *(F.col(c) for c in [*sort, *others]))).alias("best")
    found = df.groupBy(*key).agg(best, F.count("*").alias("n_copies"))
    return found.select(*key, *(F.col("best")[c].alias(c) for c in rest), "n_copies", F.least("n_copies", F.lit(MOST_DUPS)).cast("int").alias("num_dups"))


def mark_bulk_duplicates(df: DataFrame, position: list[str], barcode: str, ties: list[str], abundance: DataFrame) -> DataFrame:
    """One record per position of single-cell data, whichever its barcode.

    The barcode with most copies wins, of equal ones the more abundant in ``abundance(barcode,
    abundance)``, then the smaller; its low_mem record stands for the position, with the copies
    of all barcodes. A barcode without abundance counts 0.
    """
    cell = mark_duplicates(df, [*position, barcode], ties)
    known = abundance.select(F.col("barcode").alias(barcode), "abundance")
    ranked = cell.join(known, barcode, "left").withColumn("abundance", F.coalesce("abundance", F.lit(0)))
    rest = [c for c in cell.columns if c not in [*position, "num_dups", "n_copies"]]
    best = F.min(F.struct((-F.col("n_copies")).alias("o0"), (-F.col("abundance")).alias("o1"), F.col(barcode).alias("o2"), *(F.col(c) for c in rest))).alias("best")
    found = ranked.groupBy(*position).agg(best, F.sum("n_copies").alias("n_copies"))
    return found.select(*position, *(F.col("best")[c].alias(c) for c in rest), "n_copies", F.least("n_copies", F.lit(MOST_DUPS)).cast("int").alias("num_dups"))


def at_least_mapq(df: DataFrame, threshold: int = 30) -> DataFrame:
    """Records with mapq of at least the threshold; null mapq fails."""
    return df.filter(F.col("mapq") >= threshold)


def tn5_shift_paired(df: DataFrame) -> DataFrame:
    """Ends of fragments moved to the transposition site: start + 4, end - 5."""
    return df.withColumns({
        "fragment_start_position": F.col("fragment_start_position") + 4,
        "fragment_length": F.col("fragment_length") - 9,
        "positive_alignment_length": F.col("positive_alignment_length") - 4,
        "negative_alignment_length": F.col("negative_alignment_length") - 5,
    })


def tn5_shift_single(df: DataFrame) -> DataFrame:
    """Start + 4 of plus-strand reads (direction 1), end - 5 of minus-strand ones."""
    plus = F.col("direction") == 1
    return df.withColumns({
        "fragment_start_position": F.col("fragment_start_position") + F.when(plus, 4).otherwise(0),
        "fragment_length": F.col("fragment_length") - F.when(plus, 0).otherwise(5),
    })


def mapping_counts(df: DataFrame) -> DataFrame:
    """Uniquely and multiply mapped records per ``is_unique``."""
    return df.groupBy("is_unique").agg(F.count("*").alias("n_mappings"))


def in_order(df: DataFrame, ties: list[str]) -> DataFrame:
    """Records by reference sequence and sort key, as a range-partitioned sort."""
    return df.orderBy("rid", "fragment_start_position", *(["fragment_length"] if "fragment_length" not in ties else []), *ties)
