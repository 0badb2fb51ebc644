"""Connected components over edge tables, and near-equal 2-D points, without pairs of all with all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.batches import codes, whole_groups
from strandloom.storage import cut

#: Positions per tile of the start axis; a tile and key are one unit of work.
TILE = 4096


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``; root is the component's smallest node and
    has no row of its own.

    Alternating large-star and small-star steps; each step joins edges with the minimum per
    node, so a hub's edges can be split over tasks (AQE skew join) and no task holds a node's
    whole neighbourhood. Null ends and loops are ignored. Each round is written to the shared
    folder.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    for _ in range(most_rounds):
        role = now.select(F.col("v").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("m").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if role.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            return now.select(F.col("v").alias("node"), F.col("m").alias("root"))
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("least")).select("u", F.least("u", "least").alias("m"))
        large = both.filter("w > u").join(least, "u").select(F.col("w").alias("v"), "m").filter("v <> m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        down = large.join(least, "v")
        now = cut(down.filter("m > least").select(F.col("m").alias("v"), F.col("least").alias("m")).unionByName(least.select("v", F.col("least").alias("m"))).distinct())
    raise RuntimeError(f"components need more than {most_rounds} rounds")


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each of n nodes' component, for edges held in memory."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def steps(v: np.ndarray) -> np.ndarray:
    """Numbers from 1 to at most 2 len(v) in the order of ``v``, one apart where the values are."""
    seen, at = np.unique(v, return_inverse=True)
    return np.cumsum(np.r_[1, np.minimum(np.diff(seen), 2)])[at]


def close_points(code: np.ndarray, x: np.ndarray, y: np.ndarray, reach: int) -> np.ndarray:
    """Smallest index of each point's cluster: same code, both coordinates at most ``reach``
    apart, closed transitively.

    Points share a square of a grid of side reach + 1 only if they are close. Squares beside or
    above each other need their extreme points only; diagonal ones hold at most (reach + 1)^2
    distinct points each.
    """
    n, side = len(code), reach + 1
    if n < 2:
        return np.arange(n)
    gx, gy = steps(x // side), steps(y // side)
    gx = steps(code.astype(np.int64) * (2 * n + 2) + gx)
    high = int(gy.max()) + 2
    square = gx * high + gy
    order = np.lexsort((x, square))
    s = square[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    at, ends = s[first], np.r_[first[1:], n]
    of = np.repeat(np.arange(len(at)), ends - first)
    low = lambda v: np.minimum.reduceat(v[order], first)
    top = lambda v: np.maximum.reduceat(v[order], first)
    links: list[tuple[np.ndarray, np.ndarray]] = []

    def beside(step: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(at, at + step)
        ok = (i < len(at)) & (at[np.minimum(i, len(at) - 1)] == at + step)
        return np.flatnonzero(ok), i[ok]

    for step, v in ((high, x), (1, y)):
        a, b = beside(step)
        near = low(v)[b] - top(v)[a] <= reach
        links.append((a[near], b[near]))
    px, py = x[order], y[order]
    size = ends - first
    for step in (high + 1, high - 1):
        a, b = beside(step)
        for chunk in np.array_split(np.arange(len(a)), max(1, int((size[a] * size[b]).sum()) // (1 << 22))):
            ca, cb = a[chunk], b[chunk]
            pairs = size[ca] * size[cb]
            which = np.repeat(np.arange(len(ca)), pairs)
            k = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            i, j = first[ca[which]] + k // size[cb[which]], first[cb[which]] + k % size[cb[which]]
            near = (np.abs(px[i] - px[j]) <= reach) & (np.abs(py[i] - py[j]) <= reach)
            links.append((ca[which[near]], cb[which[near]]))
    group = labels(len(at), np.concatenate([p[0] for p in links]), np.concatenate([p[1] for p in links]))[of]
    smallest = np.full(len(at), n)
    np.minimum.at(smallest, group, order)
    out = np.empty(n, np.int64)
    out[order] = smallest[group]
    return out


def crowded_points(points: DataFrame, reach: int) -> DataFrame:
    """``h, x, y, first_id, n, root, own``: the points of ``points(h, x, y, id)`` that are repeated
    or close to another of the same ``h``.

    first_id is the smallest id at the point, root the smallest first_id of its cluster within
    the tile. Points near a tile's end are looked at in the next tile too; such rows have
    own = false, and a point that is alone in its own tile has no other row. Clusters over several
    tiles are united by following first_id and root as edges.

    Every input task merges equal points before the shuffle, so a point with a third of all
    rows arrives as one row per task; work is spread by h and TILE positions of x, and a task
    holds some whole tiles at a time.
    """

    def merged(t: pa.Table) -> pa.Table:
        h, x, y, i, n = (t[c].to_numpy() for c in ("h", "x", "y", "id", "n"))
        order = np.lexsort((y, x, h))
        h, x, y = h[order], x[order], y[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(h) else np.zeros(0, np.int64)
        if len(h):
            i, n = np.minimum.reduceat(i[order], first), np.add.reduceat(n[order], first)
        return pa.table({"h": h[first], "x": x[first], "y": y[first], "id": i, "n": n})

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows > 1 << 20:
                yield from merged(pa.concat_tables(held)).to_batches(max_chunksize=1 << 16)
                held, rows = [], 0
        if held:
            yield from merged(pa.concat_tables(held)).to_batches(max_chunksize=1 << 16)

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["h", "tile"]):
            yield from clustered(t)

    def clustered(t: pa.Table) -> Iterator[pa.RecordBatch]:
        code, tiles = codes(t.select(["h", "tile"]))
        t = merged(t.select(["x", "y", "id", "n"]).append_column("h", pa.chunked_array([pa.array(code)])))
        code, x, y, i, n = (t[c].to_numpy() for c in ("h", "x", "y", "id", "n"))
        near = close_points(code, x, y, reach)
        root = np.full(len(i), np.iinfo(np.int64).max)
        np.minimum.at(root, near, i)
        root = root[near]
        own = x // TILE == tiles["tile"].to_numpy()[code]
        many = np.bincount(near, minlength=len(i))[near] > 1
        keep = np.flatnonzero(many | own & (n > 1))
        out = pa.table({"h": tiles["h"].to_numpy()[code[keep]], "x": x[keep], "y": y[keep], "first_id": i[keep], "n": n[keep], "root": root[keep], "own": own[keep]})
        yield from out.to_batches(max_chunksize=1 << 16)

    kind = "h long, x long, y long, id long, n long"
    here = F.floor(F.col("x") / TILE)
    tiles = F.explode(F.when(F.pmod("x", F.lit(TILE)) >= TILE - reach, F.array(here, here + 1)).otherwise(F.array(here)))
    spread = points.select("h", "x", "y", "id", F.lit(1).cast("long").alias("n")).mapInArrow(shrink, kind).withColumn("tile", tiles)
    return spread.repartition("h", "tile").sortWithinPartitions("h", "tile").mapInArrow(cluster, "h long, x long, y long, first_id long, n long, root long, own boolean")
