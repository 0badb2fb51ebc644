"""Whitelist abundance, barcode correction and translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.sequence import clamped_quality


def abundance(observed: DataFrame, whitelist: DataFrame, barcode: str = "barcode", limit: int | None = None) -> DataFrame:
    """``barcode, abundance``: how often each whitelist barcode is observed without N.

    ``limit`` stops after so many observed rows, as a bounded first look at a huge input. Null
    barcodes are no observation; listed barcodes never seen have no row.
    """
    seen = observed.filter(~F.contains(barcode, F.lit("N"))).select(F.col(barcode).alias("barcode"))
    if limit is not None:
        seen = seen.limit(limit)
    return seen.groupBy("barcode").agg(F.count("*").alias("abundance")).join(whitelist.select("barcode").distinct(), "barcode", "left_semi")


def check_whitelist(observed: DataFrame, whitelist: DataFrame, barcode: str = "barcode") -> DataFrame:
    """``n_observed, n_listed, passed``: passed unless less than one barcode in twenty is listed."""
    n = observed.filter(F.col(barcode).isNotNull()).groupBy(barcode).agg(F.count("*").alias("n"))
    listed = whitelist.select(F.col("barcode").alias(barcode), F.lit(1).alias("listed")).distinct()
    joined = n.join(listed, barcode, "left")
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_observed"), F.coalesce(F.sum(F.when(F.col("listed") == 1, F.col("n"))), F.lit(0)).alias("n_listed")
    ).select("n_observed", "n_listed", (F.col("n_listed") * 20 >= F.col("n_observed")).alias("passed"))


def _masks(length: int, errors: int) -> list[tuple[int, ...]]:
    return [(i,) for i in range(length)] if errors == 1 else [(i, j) for i in range(length) for j in range(i + 1, length)]


def _masked(seq: Column, at: tuple[int, ...]) -> Column:
    for i in at:
        seq = F.overlay(seq, F.lit("."), F.lit(i + 1), F.lit(1))
    return seq


def correct(observed: DataFrame, whitelist: DataFrame, counts: DataFrame, length: int, errors: int = 1, probability: float = 0.9, barcode: str = "barcode", quality: str = "quality", key: str = "record_id") -> DataFrame:
    """``observed`` with ``corrected`` (null if rejected) and ``outcome``: listed, corrected or rejected.

    A barcode of N count at or above ``errors`` is rejected (with errors = 0, only exact ones are
    accepted). Others are accepted if listed; else the listed barcodes within ``errors``
    substitutions compete with weight 10^(-q/10) x abundance, q the summed clamped qualities of
    the substituted bases; the best is taken if it is alone or its share of the weights exceeds
    ``probability`` strictly. Ties go to the smaller barcode. Barcodes of another length and
    null ones are rejected; a null quality counts as the lowest. ``key`` must be unique.

    Candidates are found by joining strings with one or two positions masked, once per different
    unlisted barcode; their weights once per different barcode and quality. So the work grows
    with what is spelt differently, not with the rows nor with a product with the whitelist.
    """
    n_count = F.length(barcode) - F.length(F.replace(F.col(barcode), F.lit("N"), F.lit("")))
    listed = whitelist.select(F.col("barcode").alias(barcode), F.lit(True).alias("__listed")).distinct()
    rows = observed.join(listed, barcode, "left").withColumn("__n", n_count)
    exact = F.col("__listed").isNotNull()
    open_ = (~exact) & (F.length(barcode) == length) & (F.col("__n") < errors)
    if errors == 0:
        found = None
    else:
        masks = [m for e in range(1, errors + 1) for m in _masks(length, e)]
        variants = lambda c: F.explode(F.array(*(_masked(F.col(c), m) for m in masks)))
        unlisted = observed.select(F.col(barcode), F.coalesce(quality, F.lit("")).alias("__q")).distinct().join(listed, barcode, "left").withColumn("__n", n_count).filter(open_)
        asked = unlisted.select(F.col(barcode).alias("__seen"), "__q")
        near = whitelist.select("barcode").distinct().filter(F.length("barcode") == length).select("barcode", variants("barcode").alias("__mask"))
        pairs = asked.select("__seen").distinct().select("__seen", variants("__seen").alias("__mask")).join(near, "__mask").select("__seen", "barcode").distinct()
        pairs = asked.join(pairs, "__seen").join(counts.select("barcode", "abundance"), "barcode", "left")
        at = F.sequence(F.lit(1), F.lit(length))
        phred = lambda i: clamped_quality(F.substring(F.col("__q"), i, F.lit(1)))
        changed = F.filter(at, lambda i: F.substring(F.col("__seen"), i, F.lit(1)) != F.substring(F.col("barcode"), i, F.lit(1)))
        q = F.aggregate(changed, F.lit(0), lambda s, i: s + phred(i))
        weighed = pairs.withColumn("__w", F.pow(F.lit(10.0), -q / 10.0) * F.coalesce("abundance", F.lit(0)))
        best = weighed.groupBy("__seen", "__q").agg(F.max(F.struct("__w")).alias("__top"), F.sum("__w").alias("__sum"), F.count("*").alias("__k"), F.min(F.struct((-F.col("__w")).alias("w"), "barcode")).alias("__best"))
        # one expression as key: from "quality = __q" Spark infers a filter on __q, and if quality is made by a
        # lambda over another column, that filter asks for a column that is not there
        one = lambda b, q: F.concat(F.length(b), F.lit(":"), b, q)
        found = best.filter((F.col("__k") == 1) | (F.col("__top.__w") > probability * F.col("__sum"))).select(one("__seen", "__q").alias("__asked"), F.col("__best.barcode").alias("__fixed"))
    joined = rows.join(found, one(barcode, F.coalesce(quality, F.lit(""))) == F.col("__asked"), "left") if found is not None else rows.withColumn("__fixed", F.lit(None).cast("string"))
    return joined.select(
        *[F.col(f"`{c}`") for c in observed.columns],
        F.when(exact, F.col(barcode)).otherwise(F.col("__fixed")).alias("corrected"),
        F.when(exact, "listed").when(F.col("__fixed").isNotNull(), "corrected").otherwise("rejected").alias("outcome"),
    )


def outcome_counts(corrected: DataFrame) -> DataFrame:
    """``outcome, n_barcodes``."""
    return corrected.groupBy("outcome").agg(F.count("*").alias("n_barcodes"))


def translate(barcode: Column, mapping: Column, segment: int) -> Column:
    """Fixed-length segments looked up in a map and joined by ``-``. A segment without entry or a
    rest shorter than a segment raises an error; null stays null."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(barcode) - 1) / segment)), lambda i: F.substring(barcode, (i * segment + 1).cast("int"), F.lit(segment)))
    looked = F.transform(parts, lambda s: F.coalesce(F.try_element_at(mapping, s), F.raise_error(F.concat(F.lit("no translation of "), s)).cast("string")))
    return F.when(F.length(barcode) > 0, F.array_join(looked, "-")).otherwise(barcode)


def dense_ids(df: DataFrame, barcode: str, order: str) -> DataFrame:
    """``barcode, cell_id``: 0-based numbers of distinct barcodes in the order first seen."""
    first = df.filter(F.col(barcode).isNotNull()).groupBy(barcode).agg(F.min(order).alias("first"))
    parts = first.withColumn("block", F.floor(F.col("first") / (1 << 16)))
    ahead = parts.groupBy("block").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(W.partitionBy("block").orderBy("first", barcode)) - 1
    return parts.withColumn("within", within).join(ahead, "block").select(barcode, (F.col("ahead") + F.col("within")).cast("long").alias("cell_id"))
