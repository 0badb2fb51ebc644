import pytest
from oracle import same
from pyspark.sql import functions as F

from strandloom.operators import barcodes, overlap, summary
from strandloom.plans import records


def test_correction_thresholds(spark):
    white = spark.createDataFrame([("AAAA",), ("AAAC",), ("GGGG",)], "barcode string")
    counts = spark.createDataFrame([("AAAA", 90), ("AAAC", 1), ("GGGG", 5)], "barcode string, abundance long")
    seen = ["AAAA", "AAAT", "GGGT", "GGTT", "GGGN", "GGNN", None, "GG", "TTTT"]
    df = spark.createDataFrame([(i, b, None if i == 2 else "IIII") for i, b in enumerate(seen)], "record_id int, barcode string, quality string")
    got = {e: [r["corrected"] for r in barcodes.correct(df, white, counts, 4, e).orderBy("record_id").collect()] for e in (0, 1, 2)}
    assert got[0] == ["AAAA"] + [None] * 8
    assert got[1] == ["AAAA", "AAAA", "GGGG", None, None, None, None, None, None]
    assert got[2][3] == "GGGG" and got[2][4] == "GGGG" and got[2][5] is None
    assert barcodes.correct(df.limit(0), white, counts, 4).count() == 0


@pytest.mark.parametrize("errors", (1, 2))
def test_correction_where_small_tables_are_not_broadcast(spark, small, tmp_path, errors):
    """The registered queries make their quality by a lambda over another column."""
    name = f"barcode_correct_{errors}"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        records.QUERIES[name](spark, small).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    same(spark.read.parquet(f"{tmp_path}/out"), records.SQL[name], small)


def test_overlap_join_gives_each_pair_once(spark):
    left = spark.createDataFrame([(1, 0, 10, 20000), (2, 0, 5, 5), (3, 0, 30000, 30001), (4, None, 0, 9)], "i int, rid int, a long, b long")
    right = spark.createDataFrame([(7, 0, 15, 16), (8, 0, 0, 40000), (9, 0, 20000, 20001), (6, 0, None, 5)], "j int, rid int, c long, d long")
    got = sorted((r["i"], r["j"]) for r in overlap.overlap_join(left, right, ["rid"], 100).collect())
    assert got == [(1, 7), (1, 8), (3, 8)]
    n = {r["i"]: r["n_overlaps"] for r in overlap.count_overlaps(left, right, ["rid"], "i").collect()}
    assert n == {1: 2, 2: 0, 3: 1, 4: 0}


def test_band_join_equals_all_pairs(spark):
    x = [(i, (i * 7919) % 5000) for i in range(200)]
    y = [(i, (i * 104729) % 5000) for i in range(200)]
    a = spark.createDataFrame([(i, 0, v) for i, v in x], "i int, rid int, x long")
    b = spark.createDataFrame([(i, 0, v) for i, v in y], "j int, rid int, y long")
    assert overlap.band_join(a, b, ["rid"], 60).count() == sum(abs(v - w) <= 60 for _, v in x for _, w in y)


def test_pileup_and_peaks_across_stretches(spark):
    rows = [("s", i * 100000, i * 100000 + 150000) for i in range(20)] + [("s", 5, 5), ("t", 1, 3)]
    depth = overlap.pileup(spark.createDataFrame(rows, "s string, a long, b long"), ["s"])
    got = {(r["s"], r["seg_start"]): (r["seg_end"], r["depth"]) for r in depth.collect()}
    assert got[("s", 100000)] == (150000, 2) and got[("s", 150000)] == (200000, 1) and got[("t", 1)] == (3, 1)
    assert overlap.call_peaks(depth, ["s"], 2).filter("s = 's'").count() == 19
    assert overlap.pileup(spark.createDataFrame([], "s string, a long, b long"), ["s"]).count() == 0


def test_peaks_equal_those_of_one_pass(spark):
    import random

    rng = random.Random(4)
    rows = [("s", a, a + rng.choice([40, 3000, 300000])) for a in (rng.randrange(0, 3_000_000) for _ in range(400))] + [(None, 1, 9), ("u", 262143, 262145), ("u", 262144, 600000)]
    depth = overlap.pileup(spark.createDataFrame(rows, "s string, a long, b long"), ["s"])
    for cutoff in (1, 2, 30):
        want = []
        for r in sorted(depth.collect(), key=lambda r: (str(r["s"]), r["seg_start"])):
            if r["depth"] < cutoff:
                continue
            if want and want[-1][0] == r["s"] and want[-1][2] == r["seg_start"]:
                want[-1] = (r["s"], want[-1][1], r["seg_end"], max(want[-1][3], r["depth"]))
            else:
                want.append((r["s"], r["seg_start"], r["seg_end"], r["depth"]))
        got = sorted((tuple(r) for r in overlap.call_peaks(depth, ["s"], cutoff).collect()), key=lambda r: (str(r[0]), r[1]))
        assert got == want


def test_summary_of_unlisted_and_empty(spark):
    df = spark.createDataFrame([("A", True, False, True, True), (None, True, True, True, True), ("A", None, None, None, None)], "bc string, mapped boolean, duplicate boolean, lowmapq boolean, cachehit boolean")
    got = {r["barcode"]: tuple(r)[1:] for r in summary.summarise(df, "bc").collect()}
    assert got == {"A": (2, 1, 0, 1, 1), "non-whitelist": (1, 0, 0, 0, 0)}
    assert summary.derived(summary.summarise(df.limit(0), "bc")).count() == 0
    assert summary.smallest_values(spark.range(1000).select(F.lit("g").alias("g"), (F.col("id") * 10).alias("slot")), ["g"], "slot", 100, 10000).first()["cardinality"] == 1009


def test_translation(spark):
    df = spark.createDataFrame([("AACC",), ("",), (None,)], "b string")
    m = F.create_map(F.lit("AA"), F.lit("x"), F.lit("CC"), F.lit("y"))
    assert [r[0] for r in df.select(barcodes.translate(F.col("b"), m, 2)).collect()] == ["x-y", "", None]
