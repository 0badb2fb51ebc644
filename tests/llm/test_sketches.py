import math

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from strandloom.llm import distinct, frequent, percentiles
from strandloom.llm.queries import QUERIES, SQL


def rank_errors(values, answers, at):
    v = np.sort(values)
    return [max(0.0, np.searchsorted(v, x, "left") / len(v) - p, p - np.searchsorted(v, x, "right") / len(v)) for x, p in zip(answers, at)]


def test_percentiles_stay_within_the_reported_bound(spark):
    at = [0.01, 0.25, 0.5, 0.9, 0.99]
    rows = spark.range(300000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 100003).cast("int").alias("v"), F.when(F.col("id") % 2 == 0, F.col("id") % 61).alias("w"))
    s = percentiles.sketch(rows.repartition(9), ["g"], ["v", "w"], k=128)
    out = percentiles.percentiles(s, ["g"], ["v", "w"], at).toPandas()
    data = rows.toPandas()
    for _, r in out.iterrows():
        mine = data[data.g == r.g]
        for f in ("v", "w"):
            x = mine[f].dropna().to_numpy()
            assert r[f"{f}_n"] == len(x) and 0 < r[f"{f}_rank_error"] < 0.06
            assert max(rank_errors(x, [r[f"{f}_p{p * 100:g}"] for p in at], at)) <= r[f"{f}_rank_error"] + 1 / len(x)


def test_merged_days_equal_a_sketch_of_all_in_count_and_bound(spark):
    rows = spark.range(200000).select((F.col("id") % 10).alias("day"), F.lit("a").alias("g"), (F.col("id") % 5000).cast("double").alias("v"))
    daily = percentiles.sketch(rows, ["g", "day"], ["v"], k=64)
    r = percentiles.percentiles(percentiles.merge(daily, ["g"], ["v"], k=64), ["g"], ["v"], [0.5]).first()
    assert r["v_n"] == 200000 and abs(r["v_p50"] / 5000 - 0.5) <= r["v_rank_error"] < 0.1


def test_salted_merge_gives_the_same_counts(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "FLUSH", 500)
    rows = spark.range(50000).select(F.lit(None).cast("string").alias("g"), F.col("id").alias("v")).repartition(12)
    r = percentiles.percentiles(percentiles.sketch(rows, ["g"], ["v"], k=64), ["g"], ["v"], [0.5]).first()
    assert r["v_n"] == 50000 and abs(r["v_p50"] / 50000 - 0.5) <= r["v_rank_error"]


def test_very_many_groups_in_one_partition(spark):
    rows = spark.range(400000).select(F.col("id").alias("g"), (F.col("id") % 5).alias("v")).coalesce(1)
    many = percentiles.percentiles(percentiles.sketch(rows, ["g"], ["v"]), ["g"], ["v"], [0.5])
    assert many.agg(F.count("*"), F.sum("v_n"), F.sum((F.col("v_p50") == F.col("g") % 5).cast("int")), F.max("v_rank_error")).first()[:] == (400000, 400000, 400000, 0.0)


def test_small_groups_are_exact_and_nulls_left_out(spark):
    rows = [("a", 1.0), ("a", None), ("a", 5.0), ("a", 5.0), ("b", None), (None, 7.0), ("c", float("nan"))]
    out = percentiles.percentiles(percentiles.sketch(spark.createDataFrame(rows, "g string, v double"), ["g"], ["v"]), ["g"], ["v"], [0.25, 0.5, 1.0])
    got = {r["g"]: tuple(r)[1:] for r in out.collect()}
    assert got == {"a": (3, 1.0, 5.0, 5.0, 0.0), "b": (0, None, None, None, 0.0), None: (1, 7.0, 7.0, 7.0, 0.0), "c": (0, None, None, None, 0.0)}
    none = spark.createDataFrame([], "g string, v double")
    assert percentiles.percentiles(percentiles.sketch(none, ["g"], ["v"]), ["g"], ["v"], [0.5]).count() == 0


@pytest.mark.parametrize("n", [1, 40, 3000, 60000, 700000])
def test_distinct_counts_are_within_three_errors(spark, n):
    rows = spark.range(n * 2).select(F.lit("d").alias("k"), (F.col("id") % n).alias("v"), F.concat(F.lit("x"), F.col("id") % (n // 2 + 1)).alias("s"))
    for r in distinct.estimate(distinct.bitmaps(rows, ["k"], ["v", "s"]), ["k"]).collect():
        true = n if r["field"] == "v" else n // 2 + 1
        assert abs(r["n_distinct"] - true) <= max(1, 3.5 * r["std_error"] * true) and r["std_error"] < 0.02


def test_partial_bitmaps_combine_to_the_whole(spark):
    rows = spark.range(100000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("lib"), (F.col("id") % 40000).alias("v"))
    whole = distinct.bitmaps(rows, [], ["v"])
    parts = distinct.merge(distinct.bitmaps(rows, ["day", "lib"], ["v"]), [])
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in parts.collect()}
    scopes = distinct.rollups(distinct.bitmaps(rows, ["day", "lib"], ["v"]), [["day", "lib"], ["day"], ["lib"], []], ["day", "lib"])
    assert {r["scope"]: r["count"] for r in scopes.groupBy("scope").count().collect()} == {"day+lib": 21, "day": 7, "lib": 3, "all": 1}


def test_distinct_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("a", "x"), (None, "")], "k string, v string")
    assert {r["k"]: r["n_distinct"] for r in distinct.estimate(distinct.bitmaps(df, ["k"], ["v"]), ["k"]).collect()} == {"a": 1, None: 1}
    assert distinct.estimate(distinct.bitmaps(df.limit(0), ["k"], ["v"]), ["k"]).count() == 0


def test_query_4_against_exact_counts(spark, small):
    exact = spark.read.parquet(f"{small}/mapping_with_barcode.parquet").agg(F.count_distinct("cell_barcode").alias("cell_barcode"), F.count_distinct("read_id").alias("read_id")).first().asDict()
    for r in QUERIES["p4_distinct"](spark, small).filter("scope = 'all'").collect():
        assert abs(r["n_distinct"] / exact[r["field"]] - 1) <= 4 * r["std_error"]


def test_frequent_values_are_all_found_with_exact_counts(spark):
    heavy = F.when(F.col("id") % 100 < 30, "top").when(F.col("id") % 1000 == 555, F.lit("edge")).when(F.col("id") % 200 == 90, "").when(F.col("id") % 50 == 41, None)
    rows = spark.range(200000).select(heavy.otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("v")).repartition(20)
    got = {r["v"]: r["n_rows"] for r in frequent.frequent(rows, "v", 0.004).collect()}
    assert got == {"top": 60000, "": 1000}
    assert {r["v"]: r["n_rows"] for r in frequent.frequent(rows, "v", 0.001).collect()} == {"top": 60000, "": 1000, "edge": 200}


def test_frequent_of_little(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "v string")
    assert {(r["v"], r["n_rows"], r["n_total"]) for r in frequent.frequent(df, "v", 0.5).collect()} == {("a", 2, 3)}
    assert frequent.frequent(df.limit(0), "v", 0.5).count() == 0
    assert frequent.frequent(df.filter("v IS NULL"), "v", 0.5).count() == 0


def test_estimates_of_a_skewed_stream_are_near(spark):
    rng = np.random.default_rng(4)
    h = spark.createDataFrame([(int(x),) for x in (rng.zipf(1.3, 50000) * 2654435761) % (1 << 48)], "h long")
    counters, total = frequent.sketch(h)
    assert total == 50000 and counters.shape == (frequent.LEVELS, frequent.DEPTH, frequent.WIDTH)
    found = set(frequent.descend(counters, 500).tolist())
    want = {r["h"] for r in h.groupBy("h").count().filter("count >= 500").collect()}
    assert want <= found and len(found) < 4 * len(want) + 20


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_5_equals_sql(spark, small, name):
    same(QUERIES[name](spark, small), SQL[name], small)


def test_rank_bound_formula():
    assert math.isclose(percentiles.DELTA, 1e-3)


def test_tasks_draw_their_own_coins_and_the_bound_holds_over_them(spark):
    """Tasks with the same values: with the same coins, their errors would add up."""
    tasks, size, k = 100, 2000, 128
    rows = spark.range(0, tasks * size, 1, tasks).select(F.floor(F.col("id") / size).alias("g"), (F.col("id") % size).cast("double").alias("v"))
    made = percentiles.sketch(rows, ["g"], ["v"], k=k)
    held = [tuple(tuple(c) for c in r) for r in made.drop("g").collect()]
    assert len(held) == tasks and len({v for v, *_ in held}) > 10
    rank, spread = np.zeros(size), 0.0
    for values, levels, halved_levels, halved in held:
        rank += np.cumsum(np.bincount(np.array(values, int), weights=np.exp2(levels), minlength=size))
        spread += sum(n * 4.0**h for h, n in zip(halved_levels, halved))
    assert np.abs(rank - tasks * np.arange(1, size + 1)).max() <= math.sqrt(2 * math.log(2 / percentiles.DELTA) * spread)
    assert sorted(held) == sorted(tuple(tuple(c) for c in r) for r in made.drop("g").collect())
