"""Minimizers and the reference index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.batches import within
from strandloom.params import IndexParams
from strandloom.storage import cut

#: Bases per piece of a reference sequence when it is indexed.
PIECE = 1 << 20
#: Bases of many sequences that are strung together for one pass: what it makes of them stays in the cache.
STRING = 1 << 17
#: Hash of a k-mer without a strand, above all others.
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    CODE[ord(_b)] = CODE[ord(_b.lower())] = _i


def codes_of(seq: str) -> np.ndarray:
    """0..3 for A, C, G and T in either case, 4 for others."""
    return CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def hash64(key: np.ndarray, bits: int) -> np.ndarray:
    """The integer mix of functions.sequence.hash64, on arrays of uint64."""
    mask = np.uint64((1 << bits) - 1)
    u = np.uint64
    with np.errstate(over="ignore"):
        x = (~key + (key << u(21))) & mask
        x ^= x >> u(24)
        x = (x + (x << u(3)) + (x << u(8))) & mask
        x ^= x >> u(14)
        x = (x + (x << u(2)) + (x << u(4))) & mask
        x ^= x >> u(28)
        return (x + (x << u(31))) & mask


def packed(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two-bit numbers of the ``k`` bases from every position on, and of their reverse complement,
    put together from numbers of 1, 2, 4 ... bases."""
    f = c.astype(np.uint64) & np.uint64(3)
    r = np.uint64(3) - f
    forward, backward, have, size = None, None, 0, 1
    while True:
        if k & size:
            if forward is None:
                forward, backward = f, r
            else:
                n = min(len(forward), len(f) - have)
                forward = forward[:n] << np.uint64(2 * size) | f[have : have + n]
                backward = backward[:n] | r[have : have + n] << np.uint64(2 * have)
            have += size
        if have == k:
            n = max(0, len(c) - k + 1)
            return forward[:n], backward[:n]
        n = max(0, len(f) - size)
        f, r = f[:n] << np.uint64(2 * size) | f[size : size + n], r[:n] | r[size : size + n] << np.uint64(2 * size)
        size *= 2


def kmer_hashes(seq: str | np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and strand (0 forward) of the k-mer starting at every position of bases or base codes; NONE
    where it holds an ambiguous base or equals its reverse complement. The strand of smaller hash is
    taken and hashed once more."""
    c = codes_of(seq) if isinstance(seq, str) else seq
    if len(c) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)
    forward, backward = packed(c, k)
    a, b = hash64(forward, 2 * k), hash64(backward, 2 * k)
    strand = (a >= b).astype(np.int8)
    odd = np.r_[0, np.cumsum(c > 3)]
    h = hash64(np.minimum(a, b), 2 * k)
    h[(odd[k:] > odd[:-k]) | (forward == backward)] = NONE
    return h, strand


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """The least or greatest of every ``w`` neighbours."""
    out = x[: len(x) - w + 1]
    for i in range(1, w):
        out = pick(out, x[i : len(x) - w + 1 + i])
    return out


def sequence_minimizers(seq: str | np.ndarray, k: int, w: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position of the last base and strand of the minimizers, by position.

    A k-mer is one if it is the least of some window of ``w`` k-mers without ambiguous base; all
    of equal rank count. A ``whole`` sequence with fewer than w k-mers gives its last least one.
    """
    h, strand = kmer_hashes(seq, k)
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int64), strand
    if n < w:
        if not whole or h.min() == NONE:
            return h[:0], np.zeros(0, np.int64), strand[:0]
        at = np.array([n - 1 - int(h[::-1].argmin())])
        return h[at], at + k - 1, strand[at]
    least = _slide(h, w, np.minimum)
    full = _slide(h, w, np.maximum) != NONE
    # greatest window minimum over the windows that hold a k-mer; 0 stands for no window
    held = np.where(full, least + np.uint64(1), np.uint64(0))
    edge = np.zeros(w - 1, np.uint64)
    best = _slide(np.r_[edge, held, edge], w, np.maximum)
    at = np.flatnonzero((h != NONE) & (best == h + np.uint64(1)))
    return h[at], at + k - 1, strand[at]


def batch_minimizers(seqs: list[str], k: int, w: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the sequence, hash, position and strand of the minimizers of many sequences: those
    of w k-mers and more are strung together with an ambiguous base between them."""
    long_ = [i for i, s in enumerate(seqs) if len(s) >= k + w - 1]
    sizes = np.array([len(seqs[i]) + 1 for i in long_], np.int64)
    starts = np.cumsum(sizes) - sizes
    h, at, strand = sequence_minimizers("N".join(seqs[i] for i in long_), k, w, False)
    of = np.searchsorted(starts, at, "right") - 1
    parts = [(np.array(long_, np.int64)[of] if len(long_) else of, h, at - starts[of] if len(long_) else at, strand)]
    for i, s in enumerate(seqs):
        if k <= len(s) < k + w - 1:
            h, at, strand = sequence_minimizers(s, k, w, whole)
            parts.append((np.full(len(h), i), h, at, strand))
    of, h, at, strand = (np.concatenate([p[j] for p in parts]) for j in range(4))
    order = np.argsort(of, kind="stable")
    return of[order], h[order], at[order], strand[order]


def minimizers(sequences: DataFrame, keys: list[str], params: IndexParams, seq: str = "seq", start: str | None = None) -> DataFrame:
    """``keys..., ordinal, hash, pos, strand, n_minimizers`` of every sequence.

    ``start`` names a column with the offset of a piece of a longer sequence, added to
    positions. Null and too short sequences give no rows.
    """
    k, w = params.kmer_size, params.window_size
    fields = ", ".join(f"`{c}` {sequences.schema[c].dataType.simpleString()}" for c in keys)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            texts = [t or "" for t in b.column(len(keys)).to_pylist()]
            starts = b.column(len(keys) + 1).to_numpy() if start else np.zeros(b.num_rows, np.int64)
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < STRING):
                    size += len(texts[hi])
                    hi += 1
                of, h, at, strand = batch_minimizers(texts[lo:hi], k, w, start is None)
                n = np.bincount(of, minlength=hi - lo)
                taken = [b.column(c).take(pa.array(lo + of)) for c in range(len(keys))]
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array(within(of), pa.int32()), pa.array(h.astype(np.int64)), pa.array(at + starts[lo + of]), pa.array(strand), pa.array(n[of], pa.int32())],
                    names=[*keys, "ordinal", "hash", "pos", "strand", "n_minimizers"],
                )
                lo = hi

    chosen = sequences.select(*keys, seq, *([start] if start else []))
    return chosen.mapInArrow(make, f"{fields}, ordinal int, hash long, pos long, strand byte, n_minimizers int")


def pieces(references: DataFrame, params: IndexParams) -> DataFrame:
    """``rid, start, piece``: reference sequences cut so that every window of k-mers is in a piece."""
    overlap = params.kmer_size + params.window_size - 2
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.length("seq") - overlap - 1, F.lit(0)).cast("long"), F.lit(PIECE).cast("long")))
    return references.filter("length(seq) > 0").select("rid", "seq", starts.alias("start")).select("rid", "start", F.substring("seq", (F.col("start") + 1).cast("int"), F.lit(PIECE + overlap)).alias("piece"))


def build_index(references: DataFrame, params: IndexParams) -> DataFrame:
    """``hash, rid, pos, strand, freq``: all minimizers of ``references(rid, seq)`` with the number of
    places of their hash. Sequences longer than PIECE are worked on in overlapping pieces."""
    columns = ["hash", "rid", "pos", "strand"]
    parts = pieces(references.filter(F.length("seq") > PIECE), params)
    found = minimizers(parts, ["rid"], params, "piece", "start").select(*columns).distinct().unionByName(minimizers(references.filter(F.length("seq") <= PIECE).select("rid", "seq"), ["rid"], params).select(*columns))
    found = cut(found)  # counted and given out
    return found.join(found.groupBy("hash").agg(F.count("*").alias("freq")), "hash")


def index_statistics(index: DataFrame, references: DataFrame) -> DataFrame:
    """``n_minimizers, n_distinct, n_singletons, mean_occurrence, mean_spacing``."""
    by = index.groupBy("hash").agg(F.count("*").alias("n"))
    total = references.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("n_bases"))
    counts = by.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_minimizers"), F.count("*").alias("n_distinct"), F.count_if(F.col("n") == 1).alias("n_singletons"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return counts.crossJoin(total).select("n_minimizers", "n_distinct", "n_singletons", ratio("n_minimizers", "n_distinct").alias("mean_occurrence"), ratio("n_bases", "n_minimizers").alias("mean_spacing"))


def check_index(index: DataFrame, references: DataFrame, params: IndexParams) -> DataFrame:
    """Rows of the index that the references do not give, and the other way round; empty if sound."""
    again = build_index(references, params)
    columns = ["hash", "rid", "pos", "strand", "freq"]
    a, b = index.select(*columns), again.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("index only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("reference only")))
