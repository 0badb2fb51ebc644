from strandloom.functions import cells

WHITE = ["ACGTACGTACGTACGT", "TTTTCCCCAAAAGGGG", "ACGTACGTACGTACGA"]


def found(spark, seen, whitelist=WHITE):
    df = spark.createDataFrame([(i, b, "old") for i, b in enumerate(seen)], "i int, cell_barcode string, cell string")
    white = spark.createDataFrame([(w,) for w in whitelist], "barcode string")
    return [(r["cell"], r["cell_listed"]) for r in cells.with_cell(df, white).orderBy("i").collect()]


def test_spelling_and_repair(spark):
    seen = ["acgtACGTACGTACGT-1", " TTTTCCCCAAAAGGGG ", "TTTTCCCCAAAAGGGN", "TTTTCCCCAAAAGGNN", "ACGTACGTACGTACGC", None, "", "GATTACA"]
    assert found(spark, seen) == [
        (WHITE[0], True), (WHITE[1], True), (WHITE[1], False), ("TTTTCCCCAAAAGGNN", False),
        ("ACGTACGTACGTACGC", False),  # near two barcodes
        (None, False), ("", False), ("GATTACA", False),
    ]


def test_empty_whitelist_and_table(spark):
    assert found(spark, ["ACGT"], []) == [("ACGT", False)]
    assert found(spark, []) == []


def test_large_whitelists_are_joined_by_shuffle(spark, monkeypatch):
    seen = ["TTTTCCCCAAAAGGGN"] * 100 + [WHITE[0], None]
    want = found(spark, seen)
    monkeypatch.setattr(cells, "BROADCAST_WHITELIST_ROWS", 0)
    assert found(spark, seen) == want
