"""Per-barcode quality summary, distinct-slot sketch and the order-free seed-cache view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.sequence import inverse_logit
from strandloom.params import FRIP_COEFFICIENTS

OTHER = "non-whitelist"


def summarise(rows: DataFrame, barcode: str) -> DataFrame:
    """``barcode, total, mapped, duplicate, lowmapq, cachehit`` from flag columns of the same names.

    ``rows`` has boolean mapped, duplicate, lowmapq and cachehit per read (null is false). Null
    barcodes are summed as one row named non-whitelist, with its total only.
    """
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
    known = F.col(barcode).isNotNull()
    flags = ["mapped", "duplicate", "lowmapq", "cachehit"]
    found = rows.groupBy(barcode).agg(F.count("*").alias("total"), *map(n, flags))
    return found.select(F.coalesce(barcode, F.lit(OTHER)).alias("barcode"), "total", *(F.when(known, F.col(f)).otherwise(0).alias(f) for f in flags))


def halved(summary: DataFrame) -> DataFrame:
    """Counts of paired records written as two lines each, back to pairs."""
    half = lambda c: F.floor(F.col(c) / 2).alias(c)
    return summary.select("barcode", "total", half("mapped"), half("duplicate"), half("lowmapq"), "cachehit")


def estimated_frip(fric: Column, duplicate: Column, unmapped: Column, lowmapq: Column, c: tuple[float, ...] = FRIP_COEFFICIENTS) -> Column:
    """Estimated fraction of reads in peaks; 0 where no read met the cache."""
    return F.when(fric == 0, 0.0).otherwise(inverse_logit(F.lit(c[0]) + c[1] * fric + c[2] * duplicate + c[3] * unmapped + c[4] * lowmapq))


def derived(summary: DataFrame, coefficients: tuple[float, ...] = FRIP_COEFFICIENTS) -> DataFrame:
    """The printed summary: ``barcode, total, duplicate, unmapped, lowmapq, cachehit, fric, estfrip``."""
    fric = F.when(F.col("mapped") > 0, F.col("cachehit") / F.col("mapped")).otherwise(0.0)
    rows = summary.withColumns({"unmapped": F.col("total") - F.col("mapped"), "fric": fric})
    frip = estimated_frip(F.col("fric"), F.col("duplicate"), F.col("unmapped"), F.col("lowmapq"), coefficients)
    return rows.select("barcode", "total", "duplicate", "unmapped", "lowmapq", "cachehit", "fric", frip.alias("estfrip"))


def smallest_values(df: DataFrame, keys: list[str], slot: str, k: int, space: int) -> DataFrame:
    """``keys..., n_kept, cardinality``: distinct slots estimated from the k smallest.

    0 below k distinct slots, else floor(k x space / k-th smallest) - 1. Null slots are ignored.
    Ranks are cut to k before the shuffle where the optimizer can limit groups early.
    """
    distinct = df.filter(F.col(slot).isNotNull()).select(*keys, slot).distinct()
    ranked = distinct.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(slot))).filter(F.col("rank") <= k)
    kept = ranked.groupBy(*keys).agg(F.count("*").alias("n_kept"), F.max(slot).alias("kth"))
    value = F.when((F.col("n_kept") == k) & (F.col("kth") > 0), F.floor(F.lit(k) * F.lit(space) / F.col("kth")) - 1).otherwise(0).cast("long")
    return kept.select(*keys, "n_kept", value.alias("cardinality"))


def cache_slots(signatures: DataFrame, least_seen: int = 10, least_share: float = 0.2) -> DataFrame:
    """``slot, fingerprint, n, total``: slots of the seed cache that would be filled, with their
    modal fingerprint: seen often enough and by one fingerprint mostly. Ties go to the smaller.

    The order-free view of a cache that is filled as reads pass; which reads of a real run meet
    a filled slot depends on their order and is not reproduced.
    """
    n = signatures.filter("slot IS NOT NULL AND fingerprint IS NOT NULL").groupBy("slot", "fingerprint").agg(F.count("*").alias("n"))
    best = n.groupBy("slot").agg(F.max(F.struct("n", (-F.col("fingerprint")).alias("f"))).alias("best"), F.sum("n").alias("total"))
    return best.filter((F.col("total") >= least_seen) & (F.col("best.n") >= least_share * F.col("total"))).select("slot", (-F.col("best.f")).alias("fingerprint"), F.col("best.n").alias("n"), "total")


def with_cache_hits(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows`` (with slot and fingerprint) with ``cachehit``: its fingerprint is its slot's modal one."""
    filled = slots.select("slot", "fingerprint", F.lit(True).alias("cachehit"))
    return rows.join(filled, ["slot", "fingerprint"], "left").withColumn("cachehit", F.coalesce("cachehit", F.lit(False)))
