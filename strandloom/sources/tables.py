"""Small input files: whitelist, translation table, sequence order; and the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.params import IndexParams

LONGEST_BARCODE = 32
#: Barcodes looked at to learn their length.
SAMPLE = 1000


def barcode_length(barcodes: DataFrame, column: str = "seq") -> int:
    """Common length of the first barcodes; differing or too long ones are an error."""
    least, most = barcodes.select(F.length(column).alias("n")).limit(SAMPLE).agg(F.min("n"), F.max("n")).first()
    if least is None or least != most or not 0 < most <= LONGEST_BARCODE:
        raise ValueError(f"barcodes must share a length of 1..{LONGEST_BARCODE}, not {least}..{most}")
    return most


def read_whitelist(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """``barcode`` per line, gzipped or not. Lines of another length and repeated ones are an error."""
    rows = spark.read.text(path).select(F.trim("value").alias("barcode")).filter("barcode <> ''")
    n, distinct, least, most = rows.agg(F.count("*"), F.count_distinct("barcode"), F.min(F.length("barcode")), F.max(F.length("barcode"))).first()
    if n and (least != most or most > LONGEST_BARCODE or (length is not None and most != length)):
        raise ValueError(f"whitelist barcodes have {least}..{most} bases, not {length or 'one length'}")
    if n != distinct:
        raise ValueError(f"{n - distinct} whitelist lines repeat a barcode")
    return rows


def read_translation(spark: SparkSession, path: str) -> dict[str, str]:
    """Barcode segments and what they become, from lines of ``to`` and ``from`` separated by a tab or
    comma. Segments must share a length."""
    rows = [r["value"].replace("\t", ",").split(",") for r in spark.read.text(path).filter("value <> ''").collect()]
    if bad := next((r for r in rows if len(r) != 2), None):
        raise ValueError(f"not two fields: {bad}")
    if len({len(f) for _, f in rows}) > 1:
        raise ValueError("translated segments differ in length")
    return {f.strip(): t.strip() for t, f in rows}


def read_order(spark: SparkSession, path: str) -> list[str]:
    """Sequence names, one a line, in the order wanted."""
    return [line.strip() for r in spark.read.text(path, wholetext=True).collect() for line in r["value"].splitlines() if line.strip()]


def write_index(index: DataFrame, path: str, params: IndexParams) -> None:
    """The index as Parquet, clustered by hash, beside a row with its k-mer and window size."""
    index.repartitionByRange("hash").sortWithinPartitions("hash").write.parquet(f"{path}/minimizers")
    index.sparkSession.createDataFrame([(params.kmer_size, params.window_size)], "kmer_size int, window_size int").coalesce(1).write.parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, IndexParams]:
    """A stored index and the sizes it was built with, which mapping has to use."""
    meta = spark.read.parquet(f"{path}/meta").first()
    return spark.read.parquet(f"{path}/minimizers"), IndexParams(meta["kmer_size"], meta["window_size"])
