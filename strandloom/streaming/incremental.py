"""Mapping of reads as they arrive, and running summaries of arriving records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.params import IndexParams, MapParams
from strandloom.plans import pipeline


def map_stream(reads: DataFrame, index: DataFrame, references: DataFrame, out: str, checkpoint: str, params: MapParams = MapParams(), ip: IndexParams = IndexParams(), paired: bool = True, once: bool = True) -> StreamingQuery:
    """Starts a query that maps each micro-batch of a read stream and writes its records below ``out``.

    A batch is written to a folder of its own number, overwritten if it is repeated after a
    failure, so records come out exactly once. Duplicates span batches: take them out afterwards
    with ``pipeline.finish`` over the folder. ``once`` handles what is there and stops.
    """
    run = pipeline.map_paired if paired else pipeline.map_single

    def handle(batch: DataFrame, number: int) -> None:
        run(batch, index, references, params, ip).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = reads.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def daily_counts(records: DataFrame, late: str = "14 days", keys: tuple[str, ...] = ("library_id",), at: str = "mapped_at") -> DataFrame:
    """Records per key and day of a stream, with a watermark; a day is final ``late`` after its end."""
    day = F.window(at, "1 day")
    return records.withWatermark(at, late).groupBy(*keys, day.alias("day")).agg(F.count("*").alias("n_records"), F.avg("mapq").alias("mean_mapq")).select(*keys, F.col("day.start").alias("day"), "n_records", "mean_mapq")


def without_redelivery(records: DataFrame, late: str = "14 days", key: tuple[str, ...] = ("read_id",), at: str = "mapped_at") -> DataFrame:
    """A stream without rows delivered again within ``late`` of their first delivery."""
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark(list(key))


def append_parquet(stream: DataFrame, out: str, checkpoint: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Writes what is there of a stream as Parquet and stops."""
    return then(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
