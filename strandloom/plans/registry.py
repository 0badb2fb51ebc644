"""All queries of the mapping operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans import records, sequences

QUERIES = {**records.QUERIES, **sequences.QUERIES}
SQL = {**records.SQL, **sequences.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-cell fragments: deduplicated per cell, filtered by mapq, shifted, as file lines."""
    return records.fragments_bed(spark, sf_dir)
