import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from oracle import same

from pyspark.sql import functions as F

from strandloom.llm import components, survivors
from strandloom.llm.queries import QUERIES, SQL

KIND = (
    "record_id long, read_id long, library_id string, rid int, cell_barcode string, fragment_start_position long, fragment_length int, mapq int, num_dups int, "
    "mapped_at timestamp, loaded_at timestamp, cell string, h string, g int, rank string, value string"
)
WHITE = ["ACGTACGTACGTACGT", "TTTTCCCCAAAAGGGG"]


def brute(rows):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    spell = lambda b: None if b is None else b.upper().split("-")[0].strip()

    def cell(b):
        s = spell(b)
        if s is None or s in WHITE:
            return s
        near = [w for w in WHITE if len(w) == len(s) and sum(x != y for x, y in zip(w, s)) == 1]
        return near[0] if len(near) == 1 else s

    for a, b in itertools.combinations(rows, 2):
        near = all(v is not None for v in (*a[2:7], *b[2:7])) and a[2:4] == b[2:4] and cell(a[4]) == cell(b[4]) and abs(a[5] - b[5]) <= 8 and abs(a[5] + a[6] - b[5] - b[6]) <= 8
        if near or (a[1] is not None and a[1] == b[1]):
            x, y = sorted((root(a[0]), root(b[0])))
            parent[y] = x
    groups = defaultdict(list)
    for r in rows:
        groups[root(r[0])].append(r)
    best = lambda r: (-sum(v is None for v in (*r[4:9],)), spell(r[4]) in WHITE, -1 if r[7] is None else r[7], -1 if r[8] is None else r[8], r[9], -r[0])
    return {(min(r[0] for r in g), max(g, key=best)[0]) for g in groups.values() if len(g) > 1}


def made(n, seed, dense):
    import datetime

    rng = random.Random(seed)
    day = datetime.datetime(2025, 1, 1)
    maybe = lambda v, p=0.1: None if rng.random() < p else v
    rows = []
    for i in range(n):
        w = rng.choice(WHITE)
        bc = rng.choice([w, w.lower(), w + "-1", f" {w} ", "N" + w[1:], "G" * 16])
        start = rng.randrange(0, dense) + rng.choice([0, components.TILE - 10])
        rows.append((i + 1, maybe(rng.randrange(n)), maybe("L"), maybe(0), maybe(bc), maybe(start), maybe(rng.choice([30, 33, 60, 0])), maybe(rng.randrange(3)), maybe(rng.randrange(3)), day, maybe(day), "x", "x", 1, "x", "x"))
    return rows


@pytest.mark.parametrize("n, seed, dense", [(120, 1, 400), (150, 2, 3000), (200, 3, 60), (1, 4, 10), (0, 5, 10)])
def test_groups_equal_all_pairs_taken_together(spark, n, seed, dense):
    rows = made(n, seed, dense)
    df = spark.createDataFrame(rows, KIND)
    out = survivors.survivors(survivors.duplicate_members(df, spark.createDataFrame([(w,) for w in WHITE], "barcode string")))
    assert {(r["first_record_id"], r["best_record_id"]) for r in out.collect()} == brute(rows)


def test_query_equals_sql(spark, small):
    same(QUERIES["p1_found"](spark, small), SQL["p1_found"], small)


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert {got[i] for i in range(2, 201)} == {1} and {got[1000 + i] for i in range(1, 300)} == {1000} and len(got) == 498
    assert components.components(df.limit(0)).count() == 0


def test_close_points_equal_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(1, 120))
        code, x, y = rng.integers(0, 2, n), rng.integers(-40, 60, n), rng.integers(0, 60, n)
        label = components.close_points(code, x, y, 8)
        parent = list(range(n))
        for i in range(n):
            for j in range(i):
                if code[i] == code[j] and abs(x[i] - x[j]) <= 8 and abs(y[i] - y[j]) <= 8:
                    a, b = parent[i], parent[j]
                    parent = [min(a, b) if p in (a, b) else p for p in parent]
        assert list(label) == parent


def test_fused_values_follow_accurate_independent_sources(spark):
    """Good sources of which one or two err outvote four copies of a worse one."""
    rows = []
    rng = random.Random(2)
    for g in range(400):
        true = rng.randrange(20, 40)
        for s in range(5):
            rows.append((g, true if rng.random() < 0.9 else rng.randrange(40, 60), s))
        bad = true if rng.random() < 0.7 else rng.randrange(60, 80)
        rows += [(g, bad, s) for s in range(5, 9)]
    df = spark.createDataFrame([(g * 10, g * 10 + s, None, None, None, v, None, s, (0, 0, v, 0, None, -(g * 10 + s))) for g, v, s in rows], "g long, record_id long, cell string, start long, length int, mapq int, num_dups int, source int, rank struct<full: int, listed: int, mapq: int, num_dups: int, mapped_at: timestamp, id: long>")
    out = survivors.survivors(df).collect()
    right = sum(20 <= r["mapq"] < 40 for r in out)
    assert len(out) == 400 and right > 388
    assert all(r["cell_barcode"] is None and r["cell_barcode_confidence"] is None for r in out)
    assert all(0 < r["mapq_confidence"] <= 1 for r in out)


def test_copiers_are_found():
    a = np.full(18, 0.8)
    same, false, both = (np.zeros((18, 18)) for _ in range(3))
    both[:] = 100
    same[0, 1] = same[1, 0] = 64  # as independent ones would agree
    same[2, 3] = same[3, 2] = 95
    false[2, 3] = false[3, 2] = 18
    d = survivors._dependence(a, same, false, both)
    assert d[2, 3] > 0.99 and d[0, 1] < 0.01 and d[0, 0] == 0


def test_sources_may_be_named(spark):
    import datetime

    day = datetime.datetime(2025, 1, 1)
    rows = [(i, 7, "L", 0, WHITE[0], 100, 60, 10 + i, 1, day, day, "x", "x", 1, "x", "x") for i in (1, 2, 3)]
    df, white = spark.createDataFrame(rows, KIND), spark.createDataFrame([(w,) for w in WHITE], "barcode string")
    members = survivors.duplicate_members(df, white, source=F.col("record_id") + 58)
    assert sorted(r["source"] for r in members.collect()) == [59, 60, 61]
    assert survivors.survivors(members).first()["n_records"] == 3
    with pytest.raises(Exception, match="outside"):
        survivors.duplicate_members(df, white, source=F.col("record_id") + 60).collect()


def test_lone_records_beside_a_tile_end_keep_their_group(spark):
    """The first of each group is alone in its tile, with and without company behind it."""
    import datetime

    day, at = datetime.datetime(2025, 1, 1), components.TILE
    starts = {1: at - 1, 2: at, 12: 3 * at + 2, 11: 3 * at - 6, 21: 5 * at - 8, 22: 5 * at, 23: 5 * at + 8, 31: 7 * at - 1, 32: 7 * at + 8}
    rows = [(i, i, "L", 0, WHITE[0], s, 60, 1, 1, day, day, "x", "x", 1, "x", "x") for i, s in starts.items()]
    members = survivors.duplicate_members(spark.createDataFrame(rows, KIND), spark.createDataFrame([(w,) for w in WHITE], "barcode string"))
    groups = defaultdict(list)
    for r in members.select("g", "record_id").collect():
        groups[r["g"]].append(r["record_id"])
    assert {g: sorted(m) for g, m in groups.items()} == {1: [1, 2], 11: [11, 12], 21: [21, 22, 23]}


def test_close_points_of_many_codes_far_apart():
    """Pairs of near points in 300 000 keys over a whole chromosome, and single points elsewhere."""
    n = 300_000
    x = np.random.default_rng(1).integers(0, 250_000_000, n)
    code = np.tile(np.arange(n), 2)
    label = components.close_points(code, np.r_[x, x + np.where(np.arange(n) % 3 == 0, 30, 8)], np.r_[x + 60, x + 64], 8)
    assert (label[:n] == np.arange(n)).all()
    assert (label[n:] == np.arange(n) + np.where(np.arange(n) % 3 == 0, n, 0)).all()
