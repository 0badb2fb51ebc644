import random

import pytest

from strandloom.operators import runs

ENTITY = ["track", "sample_id", "rid"]
KIND = "track string, sample_id string, rid int, a long, b long, lo string, shard string"


def brute(rows):
    by = {}
    for t, s, r, a, b, *_ in rows:
        if a is not None and b is not None and a < b:
            by.setdefault((t, s, r), []).append((a, b))
    gaps, periods = set(), set()
    for k, v in by.items():
        v.sort()
        a, b = v[0]
        for c, d in v[1:]:
            if c > b:
                periods.add((*k, a, b))
                gaps.add((*k, b, c))
                a, b = c, d
            else:
                b = max(b, d)
        periods.add((*k, a, b))
    return gaps, periods


def check(spark, rows):
    maps = runs.run_bitmaps(spark.createDataFrame(rows, KIND), ENTITY, "a", "b")
    gaps, periods = brute(rows)
    assert {tuple(r) for r in runs.gaps(maps, ENTITY).collect()} == gaps
    assert {tuple(r) for r in runs.periods(maps, ENTITY).collect()} == periods


def test_random_intervals_touch_nest_repeat_and_cross_shards(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        a = rng.choice([rng.randrange(0, 400), rng.randrange(65000, 66500), rng.randrange(0, 500000)])
        rows.append((rng.choice("xy"), rng.choice(["s", "t", None]), rng.choice([0, 1, None]), a, a + rng.choice([0, 1, 3, 40, -5]), "z", "z"))
    rows += rows[:50] + [("x", "s", 0, 7, 300007, "z", "z"), ("x", "s", 0, None, 4, "z", "z"), ("x", "s", 0, 4, None, "z", "z"), ("q", "s", 0, 0, 65536, "z", "z"), ("q", "s", 0, 65536, 131072, "z", "z"), ("q", "s", 0, 131073, 131074, "z", "z")]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])


def test_repeated_flushes(spark, monkeypatch):
    rows = [("x", "s", 0, i * 3, i * 3 + 2, "z", "z") for i in range(500)]
    monkeypatch.setattr(runs, "FLUSH", 40)
    check(spark, rows)


def test_stretches_of_few_shards_hand_on_their_ends(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(runs, "STRETCH", 2)
    rows = [("x", s, 0, a, a + rng.choice([5, 70000, 400000]), "z", "z") for s in ("s", None) for a in (rng.randrange(0, 5_000_000) for _ in range(40))]
    check(spark, rows + [("y", "s", 0, 10, 20, "z", "z"), ("y", "s", 0, 4_000_000, 4_000_001, "z", "z"), ("y", "s", 0, 131071, 131073, "z", "z")])


def test_units_of_one_base():
    import numpy as np

    k, lo, hi = runs._unite(np.array([0, 1, 0, 1]), np.array([0, 0, 1, 5]), np.array([1, 2, 2, 6]))
    assert list(zip(k, lo, hi)) == [(0, 0, 2), (1, 0, 2), (1, 5, 6)]


@pytest.mark.parametrize("n", [0, 1])
def test_bitmap_rows_are_one_per_entity_and_shard(spark, n):
    maps = runs.run_bitmaps(spark.createDataFrame([("x", "s", 0, 0, 200000, "z", "z")] * n, KIND), ENTITY, "a", "b")
    assert maps.count() == 4 * n
