"""Problems 3 and 6: covered stretches and gaps; per-cell results under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.cells import neighbourhood, normal_barcode
from strandloom.operators import runs
from strandloom.operators.replicate import fragment_replicate_join
from strandloom.storage import table

ENTITY = ["track", "sample_id", "rid"]
#: Share of a library's rows from which a cell counts as holding much of it.
HOT_SHARE = 0.02


def track_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``track, sample_id, rid, a, b`` of unpaired records and of peaks."""
    one = lambda name, start, length: table(spark, sf_dir, name).select(
        F.lit(name).alias("track"), F.trim(F.upper("sample_id")).alias("sample_id"), "rid", F.col(start).alias("a"), (F.col(start) + F.col(length)).alias("b")
    )
    return one("mapping_without_barcode", "fragment_start_position", "fragment_length").unionByName(one("peak", "start_position", "length"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between covered stretches of a track, sample and rid."""
    return runs.gaps(runs.run_bitmaps(track_intervals(spark, sf_dir), ENTITY, "a", "b"), ENTITY)


def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous covered stretches of a track, sample and rid."""
    return runs.periods(runs.run_bitmaps(track_intervals(spark, sf_dir), ENTITY, "a", "b"), ENTITY)


P3_INTERVALS = """
tracks AS (
  SELECT 'mapping_without_barcode' AS track, trim(upper(sample_id)) AS sample_id, rid,
         fragment_start_position AS a, fragment_start_position + fragment_length AS b
  FROM mapping_without_barcode WHERE fragment_length > 0
  UNION ALL
  SELECT 'peak', trim(upper(sample_id)), rid, start_position, start_position + length FROM peak WHERE length > 0),
seen AS (
  SELECT *, max(b) OVER (PARTITION BY track, sample_id, rid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM tracks WHERE a IS NOT NULL AND b IS NOT NULL)
"""
P3_FOUND_SQL = f"WITH {P3_INTERVALS} SELECT track, sample_id, rid, before AS gap_start, a AS gap_end FROM seen WHERE before < a"
P3_PERIODS_SQL = f"""WITH {P3_INTERVALS},
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR before < a THEN 1 ELSE 0 END) OVER (PARTITION BY track, sample_id, rid ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM seen)
SELECT track, sample_id, rid, min(a) AS period_start, max(b) AS period_end FROM marked GROUP BY track, sample_id, rid, island"""


def per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``track, library_id, cell_barcode, n_rows, sum_mapq, n_unique, n_library, share``: per-cell
    results of both barcoded tables.

    Rows meet the spelling-to-cell table by a fragment-replicate join on the barcode, so a
    barcode with a third of all rows is worked on by several tasks; each task aggregates its
    shard before the small per-cell partial results are shuffled. Rows without a barcode are
    left out, repeated rows count each time, nulls in mapq and is_unique add nothing.
    """
    one = lambda name: table(spark, sf_dir, name).filter("cell_barcode IS NOT NULL").select(
        F.lit(name).alias("track"), "library_id", normal_barcode(F.col("cell_barcode")).alias("seen"), "read_id", "mapq", "is_unique"
    )
    rows = one("paired_end_mapping_with_barcode").unionByName(one("mapping_with_barcode"))
    cells = rows.select("seen").distinct().join(neighbourhood(table(spark, sf_dir, "whitelist")), "seen", "left").select("seen", F.coalesce("cell", "seen").alias("cell_barcode"))
    placed = fragment_replicate_join(rows, cells, "seen")
    key = ["track", "library_id", "cell_barcode"]
    sums = lambda n, q, u: [F.sum(n).alias("n_rows"), F.sum(q).alias("sum_mapq"), F.sum(u).alias("n_unique")]
    partial = placed.groupBy("__task", *key).agg(*sums(F.lit(1), "mapq", "is_unique"))
    whole = partial.groupBy(*key).agg(*sums("n_rows", "sum_mapq", "n_unique"))
    library = whole.groupBy("track", "library_id").agg(F.sum("n_rows").alias("n_library")).select(F.col("track").alias("t"), F.col("library_id").alias("l"), "n_library")
    on = (F.col("track") == F.col("t")) & F.col("library_id").eqNullSafe(F.col("l"))
    return whole.join(library, on).select(*key, "n_rows", "sum_mapq", "n_unique", "n_library", (F.col("n_rows") / F.col("n_library")).alias("share"))


def p6_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per library and cell: rows, summed mapq, uniquely mapped rows and share of the library."""
    return per_cell(spark, sf_dir).select("track", "library_id", "cell_barcode", "n_rows", "sum_mapq", "n_unique", F.round("share", 9).alias("share"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with at least HOT_SHARE of the rows of their library."""
    return per_cell(spark, sf_dir).filter(F.col("n_rows") >= HOT_SHARE * F.col("n_library")).select("track", "library_id", "cell_barcode")


#: Spelling and one-base repair as SQL; `{source}` has a column cell_barcode.
CELLS_SQL = """
spelled AS (SELECT *, trim(split_part(upper(cell_barcode), '-', 1)) AS seen FROM {source} WHERE cell_barcode IS NOT NULL),
odd AS (SELECT DISTINCT seen FROM spelled WHERE seen NOT IN (SELECT barcode FROM whitelist)),
near AS (
  SELECT seen, min(barcode) AS barcode FROM (
    SELECT DISTINCT o.seen, w.barcode
    FROM (SELECT seen, i, substr(seen, 1, i - 1) || '.' || substr(seen, i + 1) AS mask, substr(seen, i, 1) AS base FROM odd, generate_series(1, 16) g(i) WHERE i <= length(seen)) o
    JOIN (SELECT barcode, i, substr(barcode, 1, i - 1) || '.' || substr(barcode, i + 1) AS mask FROM whitelist, generate_series(1, 16) g(i)) w ON o.mask = w.mask AND o.i = w.i
    WHERE o.base IN ('A', 'C', 'G', 'T', 'N'))
  GROUP BY seen HAVING count(*) = 1),
celled AS (SELECT s.*, coalesce(n.barcode, s.seen) AS cell FROM spelled s LEFT JOIN near n ON s.seen = n.seen)
"""
_BOTH = """both_tables AS (
  SELECT 'paired_end_mapping_with_barcode' AS track, library_id, cell_barcode, mapq, is_unique FROM paired_end_mapping_with_barcode
  UNION ALL SELECT 'mapping_with_barcode', library_id, cell_barcode, mapq, is_unique FROM mapping_with_barcode),"""
_PER_CELL = f"""WITH {_BOTH} {CELLS_SQL.format(source="both_tables")},
per_cell AS (SELECT track, library_id, cell AS cell_barcode, count(*) AS n_rows, CAST(sum(mapq) AS BIGINT) AS sum_mapq, CAST(sum(is_unique) AS BIGINT) AS n_unique FROM celled GROUP BY 1, 2, 3),
whole AS (SELECT *, CAST(sum(n_rows) OVER (PARTITION BY track, library_id) AS BIGINT) AS n_library FROM per_cell)"""
P6_CELLS_SQL = f"{_PER_CELL} SELECT track, library_id, cell_barcode, n_rows, sum_mapq, n_unique, round(n_rows / n_library, 9) AS share FROM whole"
P6_FOUND_SQL = f"{_PER_CELL} SELECT track, library_id, cell_barcode FROM whole WHERE n_rows >= {HOT_SHARE} * n_library"

QUERIES = {"p3_found": p3_found, "p3_periods": p3_periods, "p6_found": p6_found, "p6_cells": p6_cells}
SQL = {"p3_found": P3_FOUND_SQL, "p3_periods": P3_PERIODS_SQL, "p6_found": P6_FOUND_SQL, "p6_cells": P6_CELLS_SQL}
