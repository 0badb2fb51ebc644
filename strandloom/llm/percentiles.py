"""Problem 2: mergeable percentiles by hierarchies of randomised compactors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.batches import codes, whole_groups, within
from strandloom.storage import likely_tasks

#: Values a level holds before it is sorted and halved.
K = 512
#: Probability with which a reported rank error may be exceeded.
DELTA = 1e-3
#: Values buffered by a task between compactions.
FLUSH = 1 << 20


def compact(code: np.ndarray, level: np.ndarray, value: np.ndarray, k: int, rng: np.random.Generator):
    """Levels above ``k`` values are sorted and every other value, from a random first or second,
    moves one level up with doubled weight; a last odd value stays. All groups at once.

    Returns code, level, value and, for each compaction done, its code and level.
    """
    kept, done = [], []
    h = 0
    while len(code):
        here = level == h
        c, v = code[here], value[here]
        code, level, value = code[~here], level[~here], value[~here]
        sizes = np.bincount(c) if len(c) else np.zeros(0, np.int64)
        over = sizes[c] > k if len(c) else np.zeros(0, bool)
        kept.append((c[~over], np.full((~over).sum(), h), v[~over]))
        if over.any():
            c, v = c[over], v[over]
            order = np.lexsort((v, c))
            c, v = c[order], v[order]
            at, size = within(c), sizes[c]
            odd = (size % 2 == 1) & (at == size - 1)
            coin = rng.integers(0, 2, len(sizes))
            up = ~odd & (at % 2 == coin[c])
            kept.append((c[odd], np.full(odd.sum(), h), v[odd]))
            which = np.flatnonzero(sizes > k)
            done.append((which, np.full(len(which), h)))
            code, level, value = np.r_[code, c[up]], np.r_[level, np.full(up.sum(), h + 1)], np.r_[value, v[up]]
        h += 1
    cat = lambda parts, i, kind: np.concatenate([p[i] for p in parts]).astype(kind) if parts else np.zeros(0, kind)
    return cat(kept, 0, np.int64), cat(kept, 1, np.int64), cat(kept, 2, float), cat(done, 0, np.int64), cat(done, 1, np.int64)


class _Hierarchies:
    """Sketches of many groups and fields of one task.

    Its coins follow from the seed, the step, the partition and the values first compacted, so
    they are its own among all tasks and steps, and the same when the task is run again.
    """

    def __init__(self, fields: list[str], k: int, seed: int, step: int):
        self.fields, self.k, self.rng = fields, k, None
        self.seeds = [seed, step, TaskContext.get().partitionId()]
        self.keys: list[pa.Table] = []
        self.n_keys = 0
        self.items = {f: [] for f in fields}  # (row of keys, level, value)
        self.done = {f: [] for f in fields}  # (row of keys, level, times)
        self.fresh = self.base = 0

    def add(self, keys: pa.Table, items: dict, done: dict) -> None:
        for f in self.fields:
            row, level, value = items[f]
            self.items[f].append((row + self.n_keys, level, value))
            row, level, times = done[f]
            self.done[f].append((row + self.n_keys, level, times))
        self.keys.append(keys)
        self.n_keys += keys.num_rows
        self.fresh += keys.num_rows + sum(len(items[f][2]) for f in self.fields)
        if self.fresh > max(FLUSH, self.base):
            self.flush()

    def flush(self) -> pa.Table | None:
        if not self.keys:
            return None
        keys = pa.concat_tables(self.keys)
        code, seen = codes(keys)
        self.fresh, self.base, self.keys, self.n_keys = 0, seen.num_rows, [seen], seen.num_rows
        if self.rng is None:
            bits = sum(int(p[2].astype(float).view(np.uint64).sum()) for f in self.fields for p in self.items[f])
            self.rng = np.random.default_rng([*self.seeds, bits])
        for f in self.fields:
            row, level, value = (np.concatenate([p[i] for p in self.items[f]]) for i in range(3))
            c, h, v, dc, dh = compact(code[row], level.astype(np.int64), value.astype(float), self.k, self.rng)
            drow, dlevel, times = (np.concatenate([p[i] for p in self.done[f]]) for i in range(3))
            at, n = np.unique(np.r_[code[drow], dc] * 64 + np.r_[dlevel.astype(np.int64), dh], return_inverse=True)
            times = np.bincount(n, weights=np.r_[times, np.ones(len(dc))], minlength=len(at)).astype(np.int64)
            self.items[f], self.done[f] = [(c, h, v)], [(at // 64, at % 64, times)]
            self.base += len(v)
        return seen

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        seen = self.flush()
        if seen is None:
            return
        columns = [seen[c].combine_chunks() for c in seen.column_names]
        for f in self.fields:
            (c, h, v), (dc, dh, times) = self.items[f][0], self.done[f][0]
            order = np.lexsort((v, h, c))
            columns += [_lists(c[order], v[order], seen.num_rows, pa.float64()), _lists(c[order], h[order], seen.num_rows, pa.int8())]
            order = np.lexsort((dh, dc))
            columns += [_lists(dc[order], dh[order], seen.num_rows, pa.int8()), _lists(dc[order], times[order], seen.num_rows, pa.int64())]
        yield from pa.table([x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in columns], names=schema.names).cast(schema).to_batches(max_chunksize=8192)


def _lists(code: np.ndarray, value: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(code, minlength=n))].astype(np.int32)), pa.array(value, kind))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    a = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    return np.repeat(np.arange(len(a)), np.diff(a.offsets.to_numpy())), a.flatten().to_numpy(zero_copy_only=False)


def _schema(keys: list[T.StructField], fields: list[str]) -> T.StructType:
    kinds = (("values", T.DoubleType()), ("levels", T.ByteType()), ("halved_levels", T.ByteType()), ("halved", T.LongType()))
    return T.StructType([*keys, *(T.StructField(f"{f}_{name}", T.ArrayType(kind, False)) for f in fields for name, kind in kinds)])


def _arrow(keys: pa.Schema, fields: list[str]) -> pa.Schema:
    kinds = (("values", pa.float64()), ("levels", pa.int8()), ("halved_levels", pa.int8()), ("halved", pa.int64()))
    return pa.schema([*keys, *(pa.field(f"{f}_{name}", pa.list_(pa.field("element", kind, False))) for f in fields for name, kind in kinds)])


def _parts(t: pa.Table, fields: list[str]) -> tuple[dict, dict]:
    """Items and compactions of a table of sketches, as _Hierarchies takes them."""
    items, done = {}, {}
    for f in fields:
        row, value = _flat(t[f"{f}_values"])
        items[f] = (row, _flat(t[f"{f}_levels"])[1], value)
        row, level = _flat(t[f"{f}_halved_levels"])
        done[f] = (row, level, _flat(t[f"{f}_halved"])[1])
    return items, done


def _merged_here(parts: DataFrame, keys: list[str], fields: list[str], schema: T.StructType, k: int, seed: int) -> DataFrame:
    """The sketches of every task united as they come, in any order."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = _Hierarchies(fields, k, seed, 1), None
        for b in batches:
            t = pa.Table.from_batches([b])
            out = out or _arrow(t.select(keys).schema, fields)
            held.add(t.select(keys), *_parts(t, fields))
        if out is not None:
            yield from held.rows(out)

    return parts.mapInArrow(merge, schema)


def _merged(parts: DataFrame, by: list[str], keys: list[str], fields: list[str], schema: T.StructType, k: int, seed: int, step: int) -> DataFrame:
    """The sketches of each group brought together and united; a task holds some whole groups at a
    time, not all of its partition's."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, by):
            held = _Hierarchies(fields, k, seed, step)
            held.add(t.select(keys), *_parts(t, fields))
            yield from held.rows(_arrow(t.select(keys).schema, fields))

    return parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(merge, schema)


def sketch(df: DataFrame, keys: list[str], fields: list[str], k: int = K, seed: int = 11) -> DataFrame:
    """One row per group: the compactor hierarchy of each numeric field.

    Columns: the keys and, per field, ``_values`` and ``_levels`` (a value at level h stands for
    2^h values) and ``_halved_levels``/``_halved`` (compactions so far, for the error bound).
    Null keys are a group; null and NaN values are left out, so a group may hold no value. Ties
    are values like others. Groups of up to ``k`` values are exact. Every input partition makes
    its own sketches first, so a hot group is shuffled as sketches of at most about
    k log2(n / k) values.
    """
    rows = df.select(*keys, *(F.col(f).cast("double").alias(f) for f in fields))
    out = _schema([rows.schema[c] for c in keys], fields)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = _Hierarchies(fields, k, seed, 0), None
        for b in batches:
            t = pa.Table.from_batches([b])
            schema = schema or _arrow(t.select(keys).schema, fields)
            items, nothing = {}, (np.zeros(0, np.int64),) * 3
            for f in fields:
                v = t[f].to_numpy(zero_copy_only=False)
                at = np.flatnonzero(~np.isnan(v))
                items[f] = (at, np.zeros(len(at), np.int8), v[at])
            held.add(t.select(keys), items, dict.fromkeys(fields, nothing))
        if schema is not None:
            yield from held.rows(schema)

    return _united(rows.mapInArrow(make, out), keys, fields, k, seed)


def merge(sketches: DataFrame, keys: list[str], fields: list[str], k: int = K, seed: int = 12) -> DataFrame:
    """Sketches united by ``keys``, levelwise: of other days, files or a finer grouping.

    Every task first unites what it holds, so a group made of very many sketches is shuffled as
    one per task.
    """
    parts = sketches.select(*keys, *(f"{f}_{x}" for f in fields for x in ("values", "levels", "halved_levels", "halved")))
    return _united(_merged_here(parts, keys, fields, _schema([parts.schema[c] for c in keys], fields), k, seed), keys, fields, k, seed)


def _united(parts: DataFrame, keys: list[str], fields: list[str], k: int, seed: int) -> DataFrame:
    """The sketches of all tasks by group, in two steps: about the root of the tasks' number is
    united at a time, so that a group that every task has is no one task's work."""
    schema = _schema([parts.schema[c] for c in keys], fields)
    salts = max(2, math.isqrt(likely_tasks(parts)))
    salted = parts.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return _merged(_merged(salted, [*keys, "__salt"], keys, fields, schema, k, seed, 2), keys, keys, fields, schema, k, seed, 3)


def percentiles(sketches: DataFrame, keys: list[str], fields: list[str], at: list[float], delta: float = DELTA) -> DataFrame:
    """Per field: ``_n``, ``_p50``-like columns and ``_rank_error``.

    A percentile is the smallest held value whose weight below and at it reaches p x n; null if
    the group holds no value. With probability 1 - delta, the true rank of any one answer is
    within rank_error x n: a compaction at level h moves a rank by -2^h, 0 or 2^h with mean 0,
    so Azuma's inequality gives sqrt(2 ln(2 / delta) x sum 4^h). 0 where nothing was halved.
    """
    name = lambda f, p: f"{f}_p{p * 100:g}".replace(".", "_")
    columns = [c for f in fields for c in (f"{f}_n long", *(f"{name(f, p)} double" for p in at), f"{f}_rank_error double")]
    out = T.StructType([*(sketches.schema[c] for c in keys), *T.StructType.fromDDL(", ".join(columns)).fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            answers = [pa.concat_arrays(t[c].chunks) for c in keys]
            for f in fields:
                row, value = _flat(t[f"{f}_values"])
                weight = np.exp2(_flat(t[f"{f}_levels"])[1].astype(float))
                order = np.lexsort((value, row))
                row, value, weight = row[order], value[order], weight[order]
                n = np.bincount(row, weights=weight, minlength=len(t))
                ends = np.cumsum(np.bincount(row, minlength=len(t)))
                total = np.r_[0.0, np.cumsum(weight)]
                before = total[np.r_[0, ends[:-1]]]
                answers.append(pa.array(n.astype(np.int64)))
                for p in at:
                    i = np.searchsorted(total[1:], before + np.maximum(np.ceil(p * n - 1e-9), 1), "left")
                    i = np.minimum(i, np.maximum(ends - 1, 0))
                    answers.append(pa.array(value[i] if len(value) else np.zeros(len(t)), mask=n == 0))
                row, level = _flat(t[f"{f}_halved_levels"])
                times = _flat(t[f"{f}_halved"])[1]
                spread = np.bincount(row, weights=times * np.exp2(2.0 * level), minlength=len(t))
                answers.append(pa.array(np.sqrt(2 * math.log(2 / delta) * spread) / np.maximum(n, 1)))
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in answers], names=out.names)

    return sketches.mapInArrow(read, out)
