"""The cell a barcode stands for: spelling, then one-base repair against a whitelist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A whitelist of up to this many rows is spread as a broadcast of its one-base
#: neighbourhood (at most 1 + 4 x length entries a row); a longer one is joined by shuffle.
BROADCAST_WHITELIST_ROWS = 10_000


def normal_barcode(barcode: Column) -> Column:
    """Upper case, without the ``-1`` kind of suffix and without outer spaces. Null stays null."""
    return F.trim(F.substring_index(F.upper(barcode), "-", 1))


def neighbourhood(whitelist: DataFrame, barcode: str = "barcode") -> DataFrame:
    """``(seen, cell)``: every whitelist barcode under its own spelling, and every string one
    substituted base (or N) away from exactly one whitelist barcode and not itself listed.

    Null barcodes are ignored, repeated ones count once. A string near two barcodes has no row.
    """
    listed = whitelist.select(F.col(barcode).alias("cell")).filter("cell IS NOT NULL").distinct()
    at = F.explode(F.sequence(F.lit(1), F.length("cell")))
    near = (
        listed.filter(F.length("cell") > 0)
        .select("cell", at.alias("at"))
        .select("cell", "at", F.explode(F.array(*map(F.lit, "ACGTN"))).alias("base"))
        .filter(F.substring("cell", F.col("at"), F.lit(1)) != F.col("base"))
        .select(F.overlay("cell", "base", "at", F.lit(1)).alias("seen"), "cell", F.lit(1).alias("d"))
    )
    return (
        listed.select(F.col("cell").alias("seen"), "cell", F.lit(0).alias("d"))
        .unionByName(near)
        .groupBy("seen")
        .agg(F.min(F.struct("d", "cell")).alias("best"), F.count("*").alias("n"))
        .filter("best.d = 0 OR n = 1")
        .select("seen", "best.cell", (F.col("best.d") == 0).alias("listed"))
    )


def with_cell(df: DataFrame, whitelist: DataFrame, barcode: str = "cell_barcode", into: str = "cell") -> DataFrame:
    """Adds ``into`` (the cell) and ``{into}_listed`` (true if the normalised spelling is on the
    whitelist without repair, else false; null barcodes give null and false).

    A barcode that cannot be repaired stays as normalised. An empty whitelist repairs nothing.
    Columns that have the new names already are replaced.
    The whitelist is broadcast only if its row count is within ``BROADCAST_WHITELIST_ROWS``;
    otherwise the repair table is joined by shuffle. Its keys are unique, so the join may be split
    anywhere on the side of the rows, which adaptive execution does with a hot barcode.
    """
    df = df.drop(*({into, f"{into}_listed"} - {barcode}))
    seen, fixed, ok = "__seen", "__fixed", "__ok"
    table = neighbourhood(whitelist).select(F.col("seen").alias(seen), F.col("cell").alias(fixed), F.col("listed").alias(ok))
    rows = df.withColumn(seen, normal_barcode(F.col(barcode)))
    small = whitelist.count() <= BROADCAST_WHITELIST_ROWS
    joined = rows.join(F.broadcast(table) if small else table, seen, "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns if c != into],
        F.coalesce(fixed, seen).alias(into),
        F.coalesce(ok, F.lit(False)).alias(f"{into}_listed"),
    )
