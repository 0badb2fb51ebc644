"""Continuous covered stretches and gaps of intervals, from run-compressed bitmaps.

Positions (time units or bases) are discrete. Each entity's axis is cut into shards of
``SHARD`` units; a shard's covered units are a bitmap kept as runs. Runs are made on every
input partition, united by (entity, shard), and read out as set runs and clear runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.batches import codes, whole_groups

#: Units of one bitmap shard; a run's bounds then fit 17 bits.
SHARD = 1 << 16
#: Shards of an entity that are put in order together.
STRETCH = 1 << 10
#: Buffered runs after which a task unites what it holds.
FLUSH = 1 << 20


def _unite(code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint, non-touching runs per code, sorted. Codes are 0..n-1, 0 <= lo < hi <= SHARD."""
    if not len(code):
        return code, lo, hi
    base = code.astype(np.int64) * (SHARD + 2)  # a distance of two keeps neighbouring codes apart
    a, b = base + lo, base + hi
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(a)] - 1
    k = a[first] // (SHARD + 2)
    return k, a[first] - k * (SHARD + 2), b[last] - k * (SHARD + 2)


class _Runs:
    """Accumulates runs of many (entity, shard) keys, uniting them as they come."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.tables: list[pa.Table] = []
        self.rows = 0

    def add(self, keys: pa.Table, lo: pa.ChunkedArray, hi: pa.ChunkedArray) -> None:
        self.tables.append(keys.append_column("lo", lo).append_column("hi", hi))
        self.rows += len(lo)
        if self.rows >= FLUSH:
            self.flush()

    def flush(self) -> pa.Table | None:
        if not self.tables:
            return None
        t = pa.concat_tables(self.tables)
        coded, seen = codes(t.select(self.keys))
        k, lo, hi = _unite(coded, t["lo"].to_numpy(), t["hi"].to_numpy())
        out = seen.take(pa.array(k)).append_column("lo", pa.chunked_array([pa.array(lo)])).append_column("hi", pa.chunked_array([pa.array(hi)]))
        self.tables, self.rows = [out], 0
        return out


def _packed(runs: pa.Table, keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per key with its runs as two int arrays."""
    coded, seen = codes(runs.select(keys))
    order = np.lexsort((runs["lo"].to_numpy(), coded))
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(coded, minlength=seen.num_rows))].astype(np.int32))
    pack = lambda c: pa.ListArray.from_arrays(offsets, pa.array(runs[c].to_numpy()[order].astype(np.int32)))
    out = pa.table([*(seen[k].combine_chunks() for k in keys), pack("lo"), pack("hi")], names=schema.names).cast(schema)
    yield from out.to_batches(max_chunksize=4096)


def run_bitmaps(intervals: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """``entity..., shard, run_lo, run_hi``: the union of the half-open intervals [start, end) as
    runs per shard, each row one compressed bitmap; runs neither overlap nor touch.

    Rows with a null bound or with end <= start cover nothing. Null entity values are an entity
    of their own. Other columns are ignored. Repeated rows change nothing. An empty input gives
    no rows. Each task first unites the rows of its own input partition, so what is shuffled is
    at most SHARD / 2 runs per shard and task, however many intervals a hot shard has; the final
    union holds some whole shards' united runs at a time, never their intervals.
    """
    keys = [*entity, "__shard"]
    cut_at = F.lit(SHARD)
    rows = (
        intervals.filter(F.col(start) < F.col(end))
        .select(*entity, F.col(start).cast("long").alias("__a"), F.col(end).cast("long").alias("__b"))
        .select(*entity, "__a", "__b", F.explode(F.sequence(F.floor(F.col("__a") / cut_at), F.floor((F.col("__b") - 1) / cut_at))).alias("__shard"))
        .select(
            *keys,
            F.greatest(F.col("__a") - F.col("__shard") * cut_at, F.lit(0)).cast("int").alias("lo"),
            F.least(F.col("__b") - F.col("__shard") * cut_at, cut_at).cast("int").alias("hi"),
        )
    )
    ints = T.ArrayType(T.IntegerType(), False)
    out = T.StructType([*(rows.schema[k] for k in keys), T.StructField("run_lo", ints), T.StructField("run_hi", ints)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, schema = _Runs(keys), None
        for b in batches:
            t = pa.Table.from_batches([b])
            schema = schema or _schema(t.select(keys).schema)
            runs.add(t.select(keys), t["lo"].cast(pa.int64()), t["hi"].cast(pa.int64()))
        if (t := runs.flush()) is not None:
            yield from _packed(t, keys, schema)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            runs = _Runs(keys)
            lo, hi = t["run_lo"].combine_chunks(), t["run_hi"].combine_chunks()
            of = pa.array(np.repeat(np.arange(len(t)), np.diff(lo.offsets.to_numpy())))
            runs.add(t.select(keys).take(of), pa.chunked_array([lo.flatten()]).cast(pa.int64()), pa.chunked_array([hi.flatten()]).cast(pa.int64()))
            yield from _packed(runs.flush(), keys, _schema(t.select(keys).schema))

    return rows.mapInArrow(encode, out).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(unite, out).withColumnRenamed("__shard", "shard")


def _schema(keys: pa.Schema) -> pa.Schema:
    ints = pa.list_(pa.field("element", pa.int32(), False))
    return pa.schema([*keys, pa.field("run_lo", ints), pa.field("run_hi", ints)])


def _equal(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of two aliased tables' keys."""
    return reduce(Column.__and__, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def _set_runs(bitmaps: DataFrame, entity: list[str]) -> DataFrame:
    """``entity..., stretch, before, a, b``: every run in absolute units, with the end of the covered
    part before it (null for an entity's first run).

    Shards are looked at in stretches of STRETCH; from one stretch to the next only its last end
    is handed on, so neither an entity's runs nor its shards meet in one task.
    """
    at = F.col("shard") * SHARD
    rows = bitmaps.withColumn("stretch", F.floor(F.col("shard") / STRETCH))
    ends = rows.groupBy(*entity, "stretch").agg(F.max(at + F.element_at("run_hi", -1)).alias("__end"))
    ends = ends.select(*entity, "stretch", F.lag("__end").over(W.partitionBy(*entity).orderBy("stretch")).alias("__earlier"))
    inside = rows.withColumn("__last", F.lag(at + F.element_at("run_hi", -1)).over(W.partitionBy(*entity, "stretch").orderBy("shard")))
    joined = inside.alias("r").join(ends.alias("e"), _equal("r", "e", [*entity, "stretch"]), "left")
    return (
        joined.select(*(F.col(f"r.{k}") for k in [*entity, "stretch"]), at.alias("__at"), F.coalesce("__last", "__earlier").alias("__last"), "run_hi", F.posexplode("run_lo").alias("__i", "__lo"))
        .select(
            *entity, "stretch",
            F.when(F.col("__i") == 0, F.col("__last")).otherwise(F.col("__at") + F.get("run_hi", F.col("__i") - 1)).alias("before"),
            (F.col("__at") + F.col("__lo")).alias("a"),
            (F.col("__at") + F.get("run_hi", F.col("__i"))).alias("b"),
        )
    )


def gaps(bitmaps: DataFrame, entity: list[str]) -> DataFrame:
    """``entity..., gap_start, gap_end``: the clear runs between covered positions of an entity."""
    return _set_runs(bitmaps, entity).filter("before < a").select(*entity, F.col("before").alias("gap_start"), F.col("a").alias("gap_end"))


def periods(bitmaps: DataFrame, entity: list[str]) -> DataFrame:
    """``entity..., period_start, period_end``: the continuous covered stretches; runs that meet
    at a shard's edge are one stretch. A period ends where the covered part before the next one
    does; the next one is looked for within the stretch first."""
    starts = _set_runs(bitmaps, entity).filter("before IS NULL OR before < a")
    starts = starts.withColumn("__next", F.lead("before").over(W.partitionBy(*entity, "stretch").orderBy("a")))
    by = starts.groupBy(*entity, "stretch").agg(F.min(F.struct("a", "before")).alias("__first"))
    later = by.select(*entity, "stretch", F.lead("__first.before").over(W.partitionBy(*entity).orderBy("stretch")).alias("__later"))
    last = bitmaps.groupBy(*entity).agg(F.max(F.col("shard") * SHARD + F.element_at("run_hi", -1)).alias("__end"))
    joined = starts.alias("s").join(later.alias("n"), _equal("s", "n", [*entity, "stretch"])).join(last.alias("l"), _equal("s", "l", entity))
    return joined.select(*[F.col(f"s.{k}") for k in entity], F.col("s.a").alias("period_start"), F.coalesce("s.__next", "n.__later", "l.__end").alias("period_end"))
