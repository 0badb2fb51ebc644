"""Text and matrix sinks. Every file is written by Spark below a folder, in order of its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators import lines
from strandloom.operators.overlap import bin_table


def write_lines(df: DataFrame, path: str, order: list[str | Column] | None = None, single: bool = False) -> None:
    """The column ``line`` as text, globally ordered by range partitions; ``single`` gives one file,
    for tools that need it and data that one task can write."""
    rows = df.orderBy(*order) if order else df
    rows = rows.select("line")
    (rows.coalesce(1) if single else rows).write.text(path)


def write_with_header(header: DataFrame, body: DataFrame, path: str, order: list[str], single: bool = False) -> None:
    """Header rows (``rank, line``) before body rows (``line`` and the order columns), in the parts of
    one global order: the first part begins with the header."""
    top = header.select(F.lit(0).alias("__part"), F.col("rank").cast("long").alias("__rank"), *(F.lit(None).cast(body.schema[c].dataType).alias(c) for c in order), "line")
    rest = body.select(F.lit(1).alias("__part"), F.lit(0).cast("long").alias("__rank"), *order, "line")
    write_lines(top.unionByName(rest), path, ["__part", "__rank", *order], single)


def write_sam(body: DataFrame, ref_seqs: DataFrame, path: str, order: list[str], single: bool = False) -> None:
    write_with_header(lines.sam_header(ref_seqs), body, path, order, single)


def write_pairs(body: DataFrame, ref_seqs: DataFrame, path: str, order: list[str], single: bool = False) -> None:
    write_with_header(lines.pairs_header(ref_seqs), body, path, order, single)


def write_summary(summary: DataFrame, path: str) -> None:
    """The per-barcode summary as CSV with a header, by barcode."""
    summary.orderBy("barcode").write.option("header", True).csv(path)


def write_matrix(counts: DataFrame, cells: DataFrame, features: DataFrame, path: str) -> None:
    """A sparse matrix as three folders: ``matrix`` (cell, feature, count; 1-based, in order, below a
    size line), ``features`` and ``barcodes``.

    ``counts`` has cell_id, feature_id (0-based) and n; ``cells`` cell_id and barcode; ``features``
    feature_id and line.
    """
    size = counts.agg(F.count("*").alias("n")).crossJoin(cells.agg(F.count("*").alias("c"))).crossJoin(features.agg(F.count("*").alias("f")))
    text = F.concat_ws(" ", "f", "c", "n")
    head = size.select(F.lit(0).cast("long").alias("rank"), F.lit("%%MatrixMarket matrix coordinate integer general").alias("line")).unionByName(size.select(F.lit(1).cast("long").alias("rank"), text.alias("line")))
    body = counts.select("cell_id", "feature_id", F.concat_ws(" ", F.col("feature_id") + 1, F.col("cell_id") + 1, "n").alias("line"))
    write_with_header(head, body, f"{path}/matrix", ["cell_id", "feature_id"])
    write_lines(features, f"{path}/features", ["feature_id"])
    write_lines(cells.withColumn("line", F.col("barcode")), f"{path}/barcodes", ["cell_id"])


def bin_lines(ref_seqs: DataFrame, width: int = 5000) -> DataFrame:
    """``feature_id, line`` of the bin table, starts 1-based as in a feature list."""
    from pyspark.sql import Window as W

    bins = bin_table(ref_seqs, width)
    ahead = bins.groupBy("rid").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(W.orderBy("rid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("rid", "ahead")
    return bins.join(ahead, "rid").select((F.col("ahead") + F.col("bin")).alias("feature_id"), F.concat_ws("\t", "ref_name", F.col("bin_start") + 1, "bin_end").alias("line"))
