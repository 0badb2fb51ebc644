"""Problem 4: distinct counts by multiresolution bitmaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of each level's bitmap; a power of two, at least 64.
BITS = 4096
#: A level takes part in an estimate while at most this share of its bits is set.
FULL = 0.926
#: Levels; the last takes all hashes beyond.
LEVELS = 32


def _level(h: Column) -> Column:
    """Leading zeros of the hash's upper half: level l with probability 2^-(l + 1)."""
    x = F.shiftrightunsigned(h, 32)
    for by in (1, 2, 4, 8, 16):
        x = x.bitwiseOR(F.shiftrightunsigned(x, by))
    return F.least(F.lit(LEVELS) - F.bit_count(x), F.lit(LEVELS - 1)).cast("tinyint")


def bitmaps(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``keys..., field, level, word, bits``: 64 bits of a level's bitmap per row.

    Null values are not counted; null keys are a group. A value's place depends on its hash
    alone, so repeated rows, order and partitioning change nothing, and bitmaps of days, files
    or groups merge by OR. Tasks OR their own rows before anything is shuffled: at most
    LEVELS x BITS / 64 rows per group, field and task, however hot a group.
    """
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNotNull(), F.xxhash64(f)).alias("h")) for f in fields)))
    rows = df.select(*keys, each.alias("x")).select(*keys, "x.field", "x.h").filter("h IS NOT NULL")
    place = F.col("h").bitwiseAND(F.lit(BITS - 1))
    bit = F.expr(f"shiftleft(1L, cast(h & {min(BITS, 64) - 1} AS int))")
    placed = rows.select(*keys, "field", _level(F.col("h")).alias("level"), F.shiftright(place, 6).cast("int").alias("word"), bit.alias("bits"))
    return placed.groupBy(*keys, "field", "level", "word").agg(F.bit_or("bits").alias("bits"))


def merge(maps: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps united by ``keys``, a subset of their columns."""
    return maps.groupBy(*keys, "field", "level", "word").agg(F.bit_or("bits").alias("bits"))


def estimate(maps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., field, n_distinct, std_error``.

    Levels up to the last one that is more than FULL are skipped; the others are counted
    linearly and the sum is scaled by the skipped share. std_error is the estimate's relative
    standard error (sampling by the skipped levels, and linear counting), at most about 1.5 %;
    three times it is the error bound.
    """
    level = F.col("l.level").cast("double")
    fill = maps.groupBy(*keys, "field", "level").agg(F.sum(F.bit_count("bits")).alias("n_set"))
    by = fill.groupBy(*keys, "field").agg(F.collect_list(F.struct(F.col("level").cast("int").alias("level"), F.col("n_set").cast("double").alias("s"))).alias("levels"))
    base = F.aggregate("levels", F.lit(0), lambda m, x: F.when(x.s > FULL * BITS, F.greatest(m, x.level + 1)).otherwise(m))
    used = by.withColumn("base", F.least(base, F.lit(LEVELS - 1)))
    load = lambda x: -F.log(F.lit(1.0) - F.least(x.s, F.lit(BITS - 1.0)) / BITS)
    over = lambda f: F.aggregate(F.filter("levels", lambda x: x.level >= F.col("base")), F.lit(0.0), lambda m, x: m + f(load(x)))
    n, spread = over(lambda t: BITS * t), over(lambda t: BITS * (F.exp(t) - t - 1))
    sampling = n * (1 - F.pow(F.lit(2.0), -F.col("base")))
    return used.select(
        *keys, "field", F.round(n * F.pow(F.lit(2.0), F.col("base"))).cast("long").alias("n_distinct"), F.when(n > 0, F.sqrt(spread + sampling) / n).otherwise(0.0).alias("std_error")
    )


def rollups(maps: DataFrame, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """Estimates for every grouping set, ``scope`` naming it; keys outside a set are null."""
    parts = []
    for s in sets:
        found = estimate(merge(maps, s), s)
        parts.append(found.select(F.lit("+".join(s) or "all").alias("scope"), *(F.col(k) if k in s else F.lit(None).cast(maps.schema[k].dataType).alias(k) for k in keys), "field", "n_distinct", "std_error"))
    return reduce(DataFrame.unionByName, parts)
