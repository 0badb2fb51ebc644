"""Helpers for vectorised Arrow kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # a new worker has no pa.compute otherwise


def codes(keys: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """A number 0..n-1 for each row's key (nulls are a value), and the distinct keys in that order."""
    at = np.zeros(keys.num_rows, np.int64)
    for name in keys.column_names:
        c = keys[name].combine_chunks()
        if isinstance(c, pa.ChunkedArray):
            c = pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
        d = c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        _, at = np.unique(at * (int(d.max(initial=0)) + 1) + d, return_inverse=True)
    _, first, at = np.unique(at, return_index=True, return_inverse=True)
    return at.astype(np.int64), keys.take(pa.array(first))


def within(code: np.ndarray) -> np.ndarray:
    """Position of each row within its run of equal, adjacent codes."""
    if not len(code):
        return code
    new = np.r_[True, code[1:] != code[:-1]]
    first = np.flatnonzero(new)
    return np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 26) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``, each of about ``most`` bytes or one group."""
    held, size, room = [], 0, most
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size < room:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        open_ = np.ones(len(t), bool)  # rows of the last group, of which more may come
        for k in keys:
            c = t[k].combine_chunks()
            c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
            last = c[-1]
            same = c.is_valid() if last.as_py() is None else pa.compute.fill_null(pa.compute.equal(c, last), False)
            open_ &= ~same.to_numpy(zero_copy_only=False) if last.as_py() is None else same.to_numpy(zero_copy_only=False)
        first = len(t) - int(open_[::-1].argmin() if not open_.all() else len(t))
        if first:
            yield t.slice(0, first)
            t = pa.table(t.slice(first))
            held, room = t.to_batches(), most
            size = sum(x.nbytes for x in held)
        room = max(most, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
