"""Problem 5: most frequent values by a hierarchical count-sketch and a verifying second scan."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.storage import likely_tasks

DEPTH = 5
WIDTH = 1 << 14
#: Bits of a value's hash and of a step down the hierarchy of prefixes.
HASH_BITS, STEP = 48, 8
LEVELS = HASH_BITS // STEP
#: Standard errors of the sketch by which the search goes below the threshold.
SLACK = 4.0


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A seeded 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _cell(prefix: np.ndarray, level: int, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of prefixes in one row of one level."""
    m = _mix(prefix, level * DEPTH + row)
    return (m >> np.uint64(1)) % np.uint64(width), 1 - 2 * (m & np.uint64(1)).astype(np.int64)


def _prefix(h: np.ndarray, level: int) -> np.ndarray:
    return h >> np.uint64(HASH_BITS - STEP * (level + 1))


def sketch(hashes: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """Counters [level, row, bucket] of a column ``h`` of hashes, and the number of rows:
    LEVELS x DEPTH x width numbers, whatever the rows. Tasks' counters are added in two steps,
    about the root of the tasks' number at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((LEVELS, DEPTH, width), np.int64)
        rows = 0
        for b in batches:
            rows += b.num_rows
            h, n = np.unique(b.column("h").to_numpy().astype(np.uint64), return_counts=True)
            for level in range(LEVELS):
                p = _prefix(h, level)
                for row in range(DEPTH):
                    at, sign = _cell(p, level, row, width)
                    held[level, row] += np.bincount(at.astype(np.int64), weights=sign * n, minlength=width).astype(np.int64)
        one = np.zeros(width, np.int64)
        one[0] = rows
        for at, flat in enumerate([*held.reshape(LEVELS * DEPTH, width), one]):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([flat.tobytes()], pa.binary())], names=["at", "counters"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            for c in b.column("counters"):
                total += np.frombuffer(c.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "counters"])

    kind = "at int, counters binary"
    parts = hashes.mapInArrow(count, kind)
    salt = F.pmod(F.spark_partition_id(), F.lit(max(2, math.isqrt(likely_tasks(hashes)))))
    some = parts.select((F.col("at") + 1000 * salt).cast("int").alias("at"), "counters").groupBy("at").applyInArrow(add, kind)
    whole = some.select((F.col("at") % 1000).alias("at"), "counters").groupBy("at").applyInArrow(add, kind)
    out = np.zeros((LEVELS * DEPTH + 1, width), np.int64)
    for r in whole.collect():
        out[r["at"]] = np.frombuffer(r["counters"], np.int64)
    return out[:-1].reshape(LEVELS, DEPTH, width), int(out[-1, 0])


def descend(counters: np.ndarray, threshold: float, slack: float = SLACK) -> np.ndarray:
    """Hashes whose prefixes all look at least as frequent as ``threshold`` less the slack."""
    width = counters.shape[2]
    found = np.zeros(1, np.uint64)
    for level in range(LEVELS):
        error = math.sqrt(np.median((counters[level].astype(float) ** 2).sum(axis=1)) / width)
        children = (found[:, None] << np.uint64(STEP) | np.arange(1 << STEP, dtype=np.uint64)).ravel()
        seen = np.empty((DEPTH, len(children)))
        for row in range(DEPTH):
            at, sign = _cell(children, level, row, width)
            seen[row] = counters[level, row, at.astype(np.int64)] * sign
        # a median of DEPTH rows errs by less than one row; the floor keeps the list finite
        found = children[np.median(seen, axis=0) >= max(threshold - slack * error, threshold / 4, 1)]
    return found


def frequent(df: DataFrame, value: str, share: float, width: int = WIDTH) -> DataFrame:
    """``value, n_rows, n_total``: the values with at least ``share`` of the non-null rows.

    Counts are exact: after the sketch and the descent of heavy hash prefixes, a second scan
    counts the candidates. Nulls are left out, the empty string is a value, repeated rows count
    each time; without rows there is no result. Per task and on the driver memory is
    LEVELS x DEPTH x width counters; candidates number at most about 4 / share a level. A value
    at the threshold is missed only if its estimate falls short by SLACK standard errors.
    Hot values meet in one counter and are shuffled as task totals.
    """
    rows = df.select(F.col(value).alias("v"), F.shiftrightunsigned(F.xxhash64(value), 64 - HASH_BITS).alias("h")).filter("v IS NOT NULL")
    counters, total = sketch(rows.select("h"), width)
    spark = df.sparkSession
    candidates = spark.createDataFrame([(int(h),) for h in descend(counters, share * total)] if total else [], "h long")
    counted = rows.join(F.broadcast(candidates), "h", "left_semi").groupBy("v").agg(F.count("*").alias("n_rows"))
    return counted.filter(F.col("n_rows") >= F.lit(share) * F.lit(total)).select(F.col("v").alias(value), "n_rows", F.lit(total).cast("long").alias("n_total"))
