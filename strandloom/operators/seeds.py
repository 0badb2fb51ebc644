"""Seeds, repetitive-seed statistics, candidates, mate rescue and mate filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # a new worker has no pa.compute otherwise
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.params import IndexParams
from strandloom.storage import broadcast_if

#: Candidate positions are counted modulo this, so one before a sequence's start is large.
WRAP = 1 << 32
#: Candidates kept without a partner, their least support, and mates too ambiguous for a rescue.
UNPAIRED, LEAST_UNPAIRED, TOO_MANY_BEST, TOO_MANY_WEAK = 5, 6, 300, 200
END = ["read_id", "mate"]
#: Memory of an index entry in a broadcast table.
PLACE_BYTES = 24
#: Seed hits that a task clusters at once.
HITS = 1 << 22


def seed_position(ref_pos: Column, read_pos: Column, same: Column, k: int) -> Column:
    """Candidate position: on the same strand the read's first base, on the other one its last."""
    return F.pmod(F.when(same, ref_pos - read_pos).otherwise(ref_pos + read_pos - (k - 1)), F.lit(WRAP))


def seed_hits(reads: DataFrame, index: DataFrame, below: int, k: int) -> DataFrame:
    """``read_id, mate, ordinal, plus, rid, pos``: places of the reads' minimizers that occur fewer
    than ``below`` times. The limit is applied to the index before the join, so repetitive
    hashes are never shuffled or matched."""
    few = index.filter(F.col("freq") < below).select("hash", "rid", F.col("pos").alias("ref_pos"), F.col("strand").alias("ref_strand"))
    same = F.col("strand") == F.col("ref_strand")
    return reads.join(few, "hash").select(*END, "ordinal", same.alias("plus"), "rid", seed_position(F.col("ref_pos"), F.col("pos"), same, k).alias("pos"))


def repetitive_seeds(reads: DataFrame, index: DataFrame, from_: int, params: IndexParams) -> DataFrame:
    """``read_id, mate, repetitive_length, n_repetitive`` of minimizers that occur at least ``from_``
    times: the first adds k bases, a later one its distance from the previous if that is below
    k + w - 1, else k."""
    k, reach = params.kmer_size, params.kmer_size + params.window_size - 1
    often = index.filter(F.col("freq") >= from_).select("hash").distinct()
    step = F.col("pos") - F.lag("pos").over(W.partitionBy(*END).orderBy("ordinal"))
    rows = reads.join(often, "hash", "left_semi").withColumn("step", step)
    return rows.groupBy(*END).agg(F.sum(F.when(F.col("step") < reach, F.col("step")).otherwise(k)).alias("repetitive_length"), F.count("*").alias("n_repetitive"))


def two_round_hits(reads: DataFrame, index: DataFrame, frequencies: tuple[int, int], k: int) -> DataFrame:
    """Seed hits with the first frequency limit, and with the second for ends that have none;
    ``round`` tells which."""
    first = seed_hits(reads, index, frequencies[0], k)
    bare = reads.join(first.select(*END).distinct(), END, "left_anti")
    second = seed_hits(bare, index, frequencies[1], k)
    return first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))


def required_seeds(n_minimizers: Column, n_repetitive: Column, round_: Column, both_strands: Column, least: int) -> Column:
    """Hits an island needs: minimizers that are not repetitive, within 1..least; least itself if
    the second round found hits on both strands."""
    usual = F.least(F.lit(least), F.greatest(F.lit(1), n_minimizers - n_repetitive))
    return F.when((round_ == 2) & both_strands, F.lit(least)).otherwise(usual)


def islands(end: np.ndarray, spot: np.ndarray, reach: int, required: np.ndarray, n_minimizers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``cluster`` for many ends at once: end, position and support of the islands among hits sorted
    by ``end, spot``; ``required`` and ``n_minimizers`` are per end. Only islands of more hits than
    their end has minimizers are gone through hit by hit."""
    if not len(spot):
        return end, spot, spot
    first = np.flatnonzero(np.r_[True, (end[1:] != end[:-1]) | (spot[1:] != spot[:-1])])
    e, s, n = end[first], spot[first], np.diff(np.r_[first, len(spot)])
    at = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (s[1:] - s[:-1] > reach) | (s[1:] // WRAP != s[:-1] // WRAP)])
    size, top = np.add.reduceat(n, at), np.maximum.reduceat(n, at)
    of = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(s)]))
    tops = np.flatnonzero(n == top[of])
    best = tops[np.unique(of[tops], return_index=True)[1]]
    ends = e[at]
    short = size <= n_minimizers[ends]
    good = short & (size >= required[ends])
    out = [ends[good], s[best[good]], top[good]]
    long_ = np.flatnonzero(~short)
    if len(long_):
        stop = np.r_[at[1:], len(s)]
        extra = [(int(ends[k]), p, c) for k in long_.tolist() for p, c in cluster(np.repeat(s[at[k] : stop[k]], n[at[k] : stop[k]]), reach, int(required[ends[k]]), int(n_minimizers[ends[k]]))]
        if extra:
            out = [np.r_[a, np.array(b, np.int64)] for a, b in zip(out, zip(*extra))]
            order = np.lexsort((out[1], out[0]))
            out = [a[order] for a in out]
    return tuple(out)


def cluster(hits: np.ndarray, reach: int, required: int, n_minimizers: int) -> list[tuple[int, int]]:
    """``(position, support)`` of the islands among sorted hits (rid * WRAP + pos).

    A hit starts a new island if it is on another sequence, more than ``reach`` behind the hit
    before, or, in an island of n_minimizers hits or more, more than ``reach`` behind its best.
    An island's best is its most repeated position, the first of equals; islands with fewer than
    ``required`` hits are dropped.
    """
    if not len(hits):
        return []
    spots, counts = np.unique(hits, return_counts=True)
    found: list[tuple[int, int]] = []
    breaks = np.flatnonzero((np.diff(spots) > reach) | (np.diff(spots // WRAP) > 0)) + 1
    for part in np.split(np.arange(len(spots)), breaks):
        n = counts[part]
        if n.sum() <= n_minimizers:  # too few hits to begin anew within the island
            if n.sum() >= required:
                found.append((int(spots[part[n.argmax()]]), int(n.max())))
            continue
        size, best, most, here, same = 0, 0, 0, -1, 0
        for spot in np.repeat(spots[part], n).tolist():
            if size and size >= n_minimizers and spot > best + reach:
                if size >= required:
                    found.append((best, most))
                size, most, here = 0, 0, -1
            size += 1
            same = same + 1 if spot == here else 1
            here = spot
            if same > most:
                best, most = spot, same
        if size >= required:
            found.append((best, most))
    return found


def merged(row_a: np.ndarray, spot_a: np.ndarray, n_a: np.ndarray, row_b: np.ndarray, spot_b: np.ndarray, n_b: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sets of candidates by row and position without those within ``reach`` of the last kept one;
    of equal positions the better supported stays. A row that only one of them has is left as it is."""
    if not len(row_b):
        return row_a, spot_a, n_a
    row, spot, n = np.r_[row_a, row_b], np.r_[spot_a, spot_b], np.r_[n_a, n_b]
    order = np.lexsort((-n, spot, row))
    row, spot, n = row[order], spot[order], n[order]
    mixed = np.intersect1d(row_a, row_b)
    both = np.isin(row, mixed)
    keep = np.ones(len(row), bool)
    last_row, last = -1, 0
    for i in np.flatnonzero(both).tolist():
        if row[i] == last_row and spot[i] <= last + reach:
            keep[i] = False
        else:
            last_row, last = row[i], spot[i]
    return row[keep], spot[keep], n[keep]


def merge_candidates(a: list[tuple[int, int]], b: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """``merged`` for lists of (position, support) of one row."""
    x, y = (np.array(v, np.int64).reshape(-1, 2) for v in (a, b))
    row = lambda v: np.zeros(len(v), np.int64)
    _, spot, n = merged(row(x), x[:, 0], x[:, 1], row(y), y[:, 0], y[:, 1], reach)
    return sorted(zip(spot.tolist(), n.tolist()))


def with_partner(xs: np.ndarray, nx: np.ndarray, ys: np.ndarray, ny: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates of two mates (opposite strands, sorted positions and support) are kept:
    those with a partner within ``distance``.

    Candidates are also kept without a partner, a few on each side, if they are passed over
    while the other side still has one on the same sequence and are as well supported as the
    best paired one so far (at least LEAST_UNPAIRED).
    """
    keep_x, keep_y = np.zeros(len(xs), bool), np.zeros(len(ys), bool)
    if not len(xs) or not len(ys):
        return keep_x, keep_y
    lo = np.searchsorted(ys, xs - distance, "left")
    hi = np.searchsorted(ys, xs + distance, "right")
    keep_x = lo < hi
    cover = np.zeros(len(ys) + 1, np.int64)
    np.add.at(cover, lo[keep_x], 1)
    np.add.at(cover, hi[keep_x], -1)
    keep_y = np.cumsum(cover)[:-1] > 0
    lone_x, lone_y = np.flatnonzero(~keep_x & (nx >= LEAST_UNPAIRED)), np.flatnonzero(~keep_y & (ny >= LEAST_UNPAIRED))
    if not len(lone_x) and not len(lone_y):
        return keep_x, keep_y
    # only here does the order in which candidates are met matter
    kept_x, kept_y = keep_x.copy(), keep_y.copy()
    top_x = top_y = LEAST_UNPAIRED
    left_x = left_y = UNPAIRED
    seen = passed = 0  # partners already kept; candidates of y already passed over
    for i in range(len(xs)):
        for j in range(passed, int(lo[i])):
            if j >= seen and left_y and ys[j] // WRAP == xs[i] // WRAP and ny[j] >= top_y:
                kept_y[j] = True
                left_y -= 1
        passed = max(passed, int(lo[i]))
        if passed == len(ys):
            break
        if keep_x[i]:
            top_x = max(top_x, int(nx[i]))
            top_y = max(top_y, int(ny[max(seen, int(lo[i])) : int(hi[i])].max(initial=0)))
            seen = int(hi[i])
        elif left_x and ys[passed] // WRAP == xs[i] // WRAP and nx[i] >= top_x:
            kept_x[i] = True
            left_x -= 1
    return kept_x, kept_y


def pair_candidates(a: list[tuple[int, int]], b: list[tuple[int, int]], distance: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """``with_partner`` on lists of (position, support)."""
    x, y = (np.array(v, np.int64).reshape(-1, 2) for v in (a, b))
    keep = with_partner(x[:, 0], x[:, 1], y[:, 0], y[:, 1], distance)
    return tuple([v[i] for i in np.flatnonzero(k)] for v, k in zip((a, b), keep))


def rescue_windows(spot: np.ndarray, n: np.ndarray, search: int, least: int, most: int) -> tuple[int, list[tuple[int, int]]]:
    """Merged search windows around a mate's best candidates, and their support; the support is
    negative and there is no window if the mate is too ambiguous to help."""
    if not len(spot):
        return 0, []
    top = int(n.max())
    best = np.sort(spot[n == top])
    if len(best) >= TOO_MANY_BEST or len(spot) > most or (top <= least and len(best) >= TOO_MANY_WEAK):
        return -top, []
    lo, hi = np.maximum(0, best - search), best + search
    first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return top, list(zip(lo[first].tolist(), hi[np.r_[first[1:], len(hi)] - 1].tolist()))


CANDIDATES = "array<struct<spot: long, n: int>>"
_PAIR = pa.struct([("spot", pa.int64()), ("n", pa.int32())])


def candidate_lists(row: np.ndarray, spot: np.ndarray, n: np.ndarray, rows: int) -> pa.ListArray:
    """One list of candidates per row, from candidates sorted by row."""
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=rows))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(spot, pa.int64()), pa.array(n, pa.int32())], fields=list(_PAIR)))


def flat_candidates(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and support of all candidates of a column of lists; a null is an empty list."""
    size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    if not len(flat):
        return (np.zeros(0, np.int64),) * 3
    return np.repeat(np.arange(len(lists)), size), flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64)


def sorted_hits(row: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positions in order of both; in one number where that has the room."""
    if len(spot):
        bits = int(spot.max()).bit_length()
        if bits + int(row.max()).bit_length() <= 62:
            both = np.sort(row << bits | spot)
            return both >> bits, both & ((1 << bits) - 1)
    order = np.lexsort((spot, row))
    return row[order], spot[order]


def places_by_hash(index: DataFrame, below: int) -> DataFrame:
    """``hash, places``: a hash's places as numbers (rid, pos, strand), for hashes that occur fewer
    than ``below`` times; a list is no longer than that."""
    place = F.shiftleft(F.col("rid").cast("long"), 33).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 1)).bitwiseOR(F.col("strand").cast("long"))
    return index.filter(F.col("freq") < below).groupBy("hash").agg(F.collect_list(place).alias("places"))


def read_candidates(found: DataFrame, index: DataFrame, frequencies: tuple[int, int], ip: IndexParams, reach: int, least: int, mates: int) -> DataFrame:
    """One row per read that has minimizers: for each mate m the columns ``n_minimizers{m},
    repetitive_length{m}, required{m}, plus{m}, minus{m}`` (lists of candidates by position) and
    ``weak{m}``, true if no candidate has half of its minimizers.

    ``found`` are the minimizers of the ends. An end's seeds are those rarer than the first
    frequency or, if there is none, than the second. Minimizers meet first the frequencies and then the
    packed places of their hashes, and places stay packed until they are clustered: a hit is
    8 bytes on its way. Both tables are broadcast while the index is below the bound of
    ``broadcast_if``, else joined by shuffle; ends without seeds keep their row.
    """
    k, gap = ip.kmer_size, ip.kmer_size + ip.window_size - 1
    n_places = index.count()
    freqs = broadcast_if(index.groupBy("hash").agg(F.first("freq").alias("freq")), n_places, PLACE_BYTES)
    places = broadcast_if(places_by_hash(index, frequencies[1]), n_places, PLACE_BYTES)
    # by read alone, so that both groupings below find their rows together
    rows = found.join(freqs, "hash", "left").repartition("read_id")
    ends = rows.groupBy(*END).agg(F.sort_array(F.collect_list(F.struct("pos", "strand", "hash", "freq"))).alias("s"), F.min("freq").alias("rarest"), F.first("n_minimizers").alias("n_minimizers"))
    often = F.filter("s", lambda x: x["freq"] >= frequencies[0])
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("sum"))
    long_ = F.aggregate(often, zero, lambda a, x: F.struct(x["pos"].cast("long").alias("last"), (a["sum"] + F.when(x["pos"] - a["last"] < gap, x["pos"] - a["last"]).otherwise(k)).cast("long").alias("sum")), lambda a: a["sum"])
    round_ = F.when(F.col("rarest") < frequencies[0], 1).when(F.col("rarest") < frequencies[1], 2).otherwise(0)
    limit = F.when(F.col("round") == 1, frequencies[0]).otherwise(frequencies[1])
    ends = ends.select(*END, "n_minimizers", "s", F.size(often).alias("n_repetitive"), long_.cast("int").alias("repetitive_length"), round_.alias("round"))
    ends = ends.withColumn("s", F.filter("s", lambda x: x["freq"] < limit))
    info = F.struct("mate", "n_minimizers", "n_repetitive", "repetitive_length", "round").alias("end")
    each = ends.select("read_id", info, F.explode_outer("s").alias("x")).select("read_id", "end", F.col("x.hash").alias("hash"), F.col("x.pos").cast("int").alias("pos"), F.col("x.strand").alias("strand"))
    gathered = each.join(places, "hash", "left").groupBy("read_id").agg(
        F.collect_set("end").alias("ends"), F.collect_list(F.struct(F.col("end.mate").alias("mate"), "pos", "strand", "places")).alias("seeds")
    )
    scalars = [("n_minimizers", "int"), ("repetitive_length", "int"), ("required", "int"), ("plus", CANDIDATES), ("minus", CANDIDATES), ("weak", "boolean")]
    out = "read_id long, " + ", ".join(f"{c}{m} {t}" for m in range(1, mates + 1) for c, t in scalars)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.list_value_length(b.column("seeds")).to_numpy().astype(np.int64)
            hits = pa.compute.fill_null(pa.compute.list_value_length(b.column("seeds").flatten().field("places")), 0).to_numpy().astype(np.int64)
            per_row = np.add.reduceat(hits, np.cumsum(sizes) - sizes)
            lo, total = 0, np.cumsum(per_row)
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HITS, "right")))
                yield clustered(b.slice(lo, hi - lo))
                lo = hi

    def clustered(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        ends, seeds = b.column("ends"), b.column("seeds")
        x = ends.flatten()
        row = np.repeat(np.arange(n), pa.compute.list_value_length(ends).to_numpy())
        end = row * 2 + x.field("mate").to_numpy() - 1
        number = {}
        for c in ("n_minimizers", "n_repetitive", "repetitive_length", "round"):
            number[c] = np.zeros(2 * n, np.int64)
            number[c][end] = x.field(c).to_numpy()
        present = np.zeros(2 * n, bool)
        present[end] = True
        y = seeds.flatten()
        of = np.repeat(np.arange(n), pa.compute.list_value_length(seeds).to_numpy()) * 2 + y.field("mate").to_numpy() - 1
        lists = y.field("places")
        size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
        place = lists.flatten().to_numpy()
        seed = np.repeat(np.arange(len(size)), size)
        pos, strand = (pa.compute.fill_null(y.field(c), 0).to_numpy().astype(np.int64) for c in ("pos", "strand"))
        same = (place & 1) == strand[seed]
        ref = (place >> 1) & (WRAP - 1)
        at = np.where(same, ref - pos[seed], ref + pos[seed] - (k - 1)) % WRAP
        code, spot = sorted_hits(of[seed] * 2 + ~same, (place >> 33) * WRAP + at)
        both = np.bincount(code, minlength=4 * n).reshape(-1, 2).min(axis=1) > 0
        need = np.minimum(least, np.maximum(1, number["n_minimizers"] - number["n_repetitive"]))
        need = np.where((number["round"] == 2) & both, least, need)
        code, spot, support = islands(code, spot, reach, np.repeat(need, 2), np.repeat(number["n_minimizers"], 2))
        arrays = [b.column("read_id")]
        strongest = np.zeros(2 * n, np.int64)
        np.maximum.at(strongest, code // 2, support)
        for m in range(mates):
            mine = slice(m, None, 2)
            missing = ~present[mine]
            for c in (number["n_minimizers"], number["repetitive_length"], need):
                arrays.append(pa.array(c[mine], pa.int32(), mask=missing))
            for side in range(2):
                own = code % 4 == 2 * m + side
                arrays.append(candidate_lists(code[own] // 4, spot[own], support[own], n))
            arrays.append(pa.array((strongest[mine] == 0) | (strongest[mine] < number["n_minimizers"][mine] // 2)))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["read_id", *(f"{c}{m}" for m in range(1, mates + 1) for c, _ in scalars)]
    return gathered.mapInArrow(make, out)


def candidates(hits: DataFrame, ends: DataFrame, reach: int) -> DataFrame:
    """``read_id, mate, plus, minus``: candidates on both strands, by position, of hits given one by one.

    ``ends`` has read_id, mate, n_minimizers, required; an end's hits are gathered, at most its
    minimizers times the frequency limit.
    """
    spot = F.col("rid").cast("long") * F.lit(WRAP) + F.col("pos")
    gathered = hits.groupBy(*END).agg(F.collect_list(F.when(F.col("plus"), spot)).alias("up"), F.collect_list(F.when(~F.col("plus"), spot)).alias("down"))
    rows = gathered.join(ends.select(*END, "n_minimizers", "required"), END)
    out = f"read_id long, mate int, plus {CANDIDATES}, minus {CANDIDATES}"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, required = (b.column(c).to_numpy().astype(np.int64) for c in ("n_minimizers", "required"))
            sides = []
            for c in ("up", "down"):
                row = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(b.column(c)).to_numpy())
                sides.append(candidate_lists(*islands(*sorted_hits(row, b.column(c).flatten().to_numpy()), reach, required, n), b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("read_id"), b.column("mate"), *sides], names=["read_id", "mate", "plus", "minus"])

    return rows.mapInArrow(make, out)


def signatures(reads: DataFrame) -> DataFrame:
    """``read_id, mate, signature``: the minimizers' hashes, strands and spacings, the same for a
    read and its reverse complement, by which equal seeding work is recognised."""
    over = W.partitionBy(*END).orderBy("ordinal")
    rows = reads.withColumn("gap", F.coalesce(F.col("pos") - F.lag("pos").over(over), F.lit(0)))
    seq = F.sort_array(F.collect_list(F.struct("ordinal", "hash", "strand", "gap")))
    whole = rows.groupBy(*END).agg(seq.alias("s"))
    n = F.size("s")
    forward = F.transform("s", lambda x: F.struct(x["hash"].alias("hash"), x["strand"].cast("int").alias("strand"), x["gap"].alias("gap")))
    backward = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.element_at("s", n - i + 1)["hash"].alias("hash"), (1 - F.element_at("s", n - i + 1)["strand"]).cast("int").alias("strand"),
        F.when(i == 1, F.lit(0).cast("long")).otherwise(F.element_at("s", F.least(n, n - i + 2))["gap"]).alias("gap"),
    ))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["hash"], x["strand"], x["gap"])), ",")
    return whole.select(*END, F.least(text(forward), text(backward)).alias("signature"))
