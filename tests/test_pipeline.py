import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import dedup, lines
from strandloom.operators.minimizers import build_index, check_index
from strandloom.params import IndexParams, MapParams, preset
from strandloom.plans import pipeline
from strandloom.sources import fastx, sinks, tables
from strandloom.storage import cut
from strandloom.streaming import incremental

RNG = random.Random(9)
TURN = str.maketrans("ACGT", "TGCA")


def dna(n):
    return "".join(RNG.choice("ACGT") for _ in range(n))


def wrong(s, n):
    s = list(s)
    for i in RNG.sample(range(len(s)), n):
        s[i] = RNG.choice([x for x in "ACGT" if x != s[i]])
    return "".join(s)


@pytest.fixture(scope="module")
def genome(spark):
    parts = [dna(20000), dna(9000)]
    parts.append(parts[0][5000:9000] + dna(1000))
    refs = spark.createDataFrame(list(enumerate(parts)), "rid int, seq string")
    return parts, refs, cut(build_index(refs, IndexParams()))


def made(parts, n):
    single, pairs = [], []
    for i in range(n):
        rid = RNG.randrange(2)
        pos = RNG.randrange(50, len(parts[rid]) - 500)
        plus = RNG.random() < 0.5
        s = parts[rid][pos : pos + 80]
        single.append((i, wrong(s if plus else s.translate(TURN)[::-1], RNG.randrange(4)), rid, pos, plus))
        size = RNG.randrange(120, 400)
        f = parts[rid][pos : pos + size]
        a, b = f[:60], f[-60:].translate(TURN)[::-1]
        pairs.append((i, *((a, b) if plus else (b, a)), rid, pos, size, plus))
    return single, pairs


def test_reads_come_back_to_where_they_were_taken(spark, genome):
    parts, refs, index = genome
    assert check_index(index, refs, IndexParams()).count() == 0
    single, pairs = made(parts, 300)
    rows = pipeline.map_single(spark.createDataFrame(single + [(9999, None, 0, 0, True), (9998, dna(80), 0, 0, True), (9997, "ACGT", 0, 0, True)], "read_id long, seq string, t_rid int, t_pos int, t_plus boolean"), index, refs).collect()
    assert len(rows) >= 298 and all(r["read_id"] < 9990 for r in rows)
    sure = [r for r in rows if r["mapq"] >= 30]
    assert len(sure) > 200
    assert all(r["t_rid"] == r["rid"] and abs(r["t_pos"] - r["fragment_start_position"]) <= 2 and r["t_plus"] == (r["direction"] == 1) for r in sure)
    # reads of the repeated stretch have two equal places
    assert all(r["mapq"] == 0 for r in rows if r["t_rid"] == 0 and 5000 <= r["t_pos"] <= 8900)
    df = spark.createDataFrame(pairs, "read_id long, seq1 string, seq2 string, t_rid int, t_pos int, t_size int, t_plus boolean")
    rows = pipeline.map_paired(df, index, refs).collect()
    sure = [r for r in rows if r["mapq"] >= 30]
    assert len(rows) == 300 and len(sure) > 200
    assert all((r["t_rid"], r["t_pos"], r["t_size"], int(r["t_plus"])) == (r["rid"], r["fragment_start_position"], r["fragment_length"], r["direction"]) for r in sure)


def test_split_reads_become_contacts(spark, genome):
    parts, refs, index = genome
    rows = []
    for i in range(60):
        a, b = RNG.randrange(100, 4000), RNG.randrange(100, 8000)
        rows.append((i, parts[0][a : a + 70] + parts[1][b : b + 30], parts[1][b + 30 - 70 : b + 30].translate(TURN)[::-1], a, b + 29))
    out = pipeline.map_paired(spark.createDataFrame(rows, "read_id long, seq1 string, seq2 string, a int, b int"), index, refs, preset("hic")).collect()
    good = [r for r in out if (r["rid1"], r["rid2"]) == (0, 1) and abs(r["pos1"] - r["a"]) <= 2 and abs(r["pos2"] - r["b"]) <= 2]
    assert len(good) >= 50


def test_shuffled_joins_give_what_broadcast_ones_give(spark, genome, monkeypatch):
    from strandloom import storage

    parts, refs, index = genome
    single, pairs = made(parts, 120)
    reads = spark.createDataFrame(single, "read_id long, seq string, t_rid int, t_pos int, t_plus boolean")
    both = spark.createDataFrame(pairs, "read_id long, seq1 string, seq2 string, t_rid int, t_pos int, t_size int, t_plus boolean")
    run = lambda: [sorted(tuple(r) for r in df.collect()) for df in (pipeline.map_single(reads, index, refs), pipeline.map_paired(both, index, refs))]
    want = run()
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    assert run() == want and len(want[0]) > 100


@pytest.mark.parametrize("size", [1009, 3000, 8000])
def test_reads_of_any_length_map(spark, genome, size):
    parts, refs, index = genome
    rows = [(1, parts[0][9500 : 9500 + size]), (2, wrong(parts[0][9100 : 9100 + size], 5).translate(TURN)[::-1]), (3, parts[1][300:360])]
    found = {r["read_id"]: r for r in pipeline.map_single(spark.createDataFrame(rows, "read_id long, seq string"), index, refs).collect()}
    assert [(found[i]["rid"], found[i]["fragment_start_position"], found[i]["fragment_length"], found[i]["direction"]) for i in (1, 2, 3)] == [(0, 9500, size, 1), (0, 9100, size, 0), (1, 300, 60, 1)]


def test_further_placements_of_a_read_are_secondary(spark, genome):
    parts, refs, index = genome
    reads = spark.createDataFrame([(1, parts[0][6000:6080])], "read_id long, seq string")
    found = pipeline.map_single(reads.withColumn("bases", F.col("seq")), index, refs, MapParams(max_best_mappings=5)).withColumnRenamed("bases", "seq")
    flags = [r["line"].split("\t")[1] for r in lines.sam_lines(pipeline.sam_records(found, refs, MapParams())).collect()]
    assert sorted(flags) == ["0", "256"]
    pair = spark.createDataFrame([(1, parts[0][6000:6080], parts[0][6120:6200].translate(TURN)[::-1])], "read_id long, seq1 string, seq2 string")
    both = pipeline.map_paired(pair.withColumns({"bases1": F.col("seq1"), "bases2": F.col("seq2")}), index, refs, MapParams(max_best_mappings=5)).withColumns({"read_name": F.lit("x"), "ref_name": F.lit("d")})
    flags = sorted(int(r["line"].split("\t")[1]) for r in lines.sam_lines(pipeline.sam_pair_records(both, refs, MapParams())).collect())
    assert flags == [99, 147, 355, 403]


def test_draw_on_arrays_equals_the_draw_on_rows(spark):
    import numpy as np

    from strandloom.operators import pairing

    rows = [(RNG.randrange(30), RNG.randrange(10**9)) for _ in range(400)]
    of = np.array([r[0] for r in rows])
    at = pairing.drawn_first(of, of, [np.array([r[1] for r in rows])], 3, 11)
    want = pairing.top_n(spark.createDataFrame(rows, "k long, x long"), ["k"], "k", ["x"], 3).collect()
    assert sorted(rows[i] for i in at) == sorted((r["k"], r["x"]) for r in want)


def test_sam_lines(spark, genome):
    parts, refs, index = genome
    reads = spark.createDataFrame([(1, parts[1][100:160]), (2, wrong(parts[1][300:360].translate(TURN)[::-1], 1))], "read_id long, seq string")
    found = pipeline.map_single(reads.withColumn("bases", F.col("seq")), index, refs).withColumnRenamed("bases", "seq")
    got = {x[0]: x for x in (r["line"].split("\t") for r in lines.sam_lines(pipeline.sam_records(found, refs, MapParams())).collect())}
    assert got["r1"][1:6] == ["0", "d1", "101", "60", "60M"] and got["r1"][11:] == ["NM:i:0", "MD:Z:60"]
    assert got["r2"][1] == "16" and got["r2"][3] == "301" and got["r2"][11] == "NM:i:1"


@pytest.mark.parametrize("low_memory", [True, False])
def test_both_modes_agree_on_paired_cells(spark, low_memory):
    rows = [(i, 0, 100 + i % 3, 50, "A" if i % 2 else "C", 20 + i % 41, 1, 1, 30, 30) for i in range(60)]
    df = spark.createDataFrame(rows, "read_id long, rid int, fragment_start_position long, fragment_length int, bc string, mapq int, direction int, is_unique int, positive_alignment_length int, negative_alignment_length int")
    out = pipeline.finish(df, preset("atac").but(low_memory=low_memory), paired=True, barcode="bc").collect()
    assert {(r["fragment_start_position"], r["bc"], r["n_copies"], r["mapq"]) for r in out} == {(104 + k, c, 10, max(20 + i % 41 for i in range(60) if i % 3 == k and (i % 2 == 1) == (c == "A"))) for k in range(3) for c in "AC"}
    again = dedup.mark_duplicates(df, ["rid", "fragment_start_position", "fragment_length", "bc"], dedup.PAIRED_TIES)
    assert dedup.mark_duplicates(again.drop("n_copies"), ["rid", "fragment_start_position", "fragment_length", "bc"], dedup.PAIRED_TIES).count() == again.count()


def test_files(spark, tmp_path):
    import gzip

    (tmp_path / "a.fa").write_text(">chr1 first\nACGT\nACGT\n>empty\n\n>chr2\nGG\n")
    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write("@x/1 c\nACGT\n+\n@@II\n@y\nAC\nGT\n+y\nII\nII\n")
    refs = fastx.read_references(spark, str(tmp_path / "a.fa")).orderBy("rid").collect()
    assert [(r["rid"], r["ref_name"], r["seq"]) for r in refs] == [(0, "chr1", "ACGTACGT"), (1, "chr2", "GG")]
    reads = fastx.read_fastx(spark, str(tmp_path / "*.gz"))
    assert [(r["name"], r["comment"], r["seq"], r["qual"]) for r in reads.orderBy("read_id").collect()] == [("x/1", "c", "ACGT", "@@II"), ("y", None, "ACGT", "IIII")]
    assert fastx.zip_reads(reads, reads, reads).count() == 2
    with pytest.raises(Exception, match="differ"):
        fastx.zip_reads(reads, reads.limit(1)).collect()
    with pytest.raises(FileNotFoundError):
        fastx.expand(str(tmp_path / "nothing*"))
    (tmp_path / "bad.fq").write_text("@x\nACGT\n+\nII")
    with pytest.raises(Exception, match="breaks off"):
        fastx.read_fastx(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "w.txt").write_text("ACGT\nGGGG\n")
    assert tables.read_whitelist(spark, str(tmp_path / "w.txt"), 4).count() == 2
    with pytest.raises(ValueError):
        tables.read_whitelist(spark, str(tmp_path / "w.txt"), 5)
    (tmp_path / "t.csv").write_text("AA,CC\nGG\tTT\n")
    assert tables.read_translation(spark, str(tmp_path / "t.csv")) == {"CC": "AA", "TT": "GG"}
    assert tables.barcode_length(reads) == 4
    refs = spark.createDataFrame([(0, "chr1", 9000), (1, "chr2", 100)], "rid int, ref_name string, length int")
    assert [r["new_rid"] for r in lines.reference_ranks(refs, ["chr2"]).orderBy("rid").collect()] == [1, 0]
    with pytest.raises(ValueError):
        lines.reference_ranks(refs, ["chrX"])
    body = spark.createDataFrame([(2, "b"), (1, "a")], "k int, line string")
    sinks.write_sam(body, refs, str(tmp_path / "sam"), ["k"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "sam")).collect()] == ["@SQ\tSN:chr1\tLN:9000", "@SQ\tSN:chr2\tLN:100", "a", "b"]
    sinks.write_pairs(body, refs, str(tmp_path / "pairs"), ["k"])
    assert spark.read.text(str(tmp_path / "pairs")).count() == 7
    counts = spark.createDataFrame([(0, 1, 5), (1, 0, 2)], "cell_id int, feature_id int, n int")
    cells = spark.createDataFrame([(0, "AC"), (1, "GT")], "cell_id int, barcode string")
    sinks.write_matrix(counts, cells, sinks.bin_lines(refs), str(tmp_path / "m"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m/matrix")).collect()] == ["%%MatrixMarket matrix coordinate integer general", "3 2 2", "2 1 5", "1 2 2"]


@pytest.mark.parametrize("kind", ["fastq", "fasta"])
def test_a_file_read_in_ranges_gives_the_rows_of_one_task(spark, tmp_path, kind):
    lines = []
    for i in range(300):
        seq = dna(RNG.randrange(1, 60))
        if kind == "fastq":
            qual = "".join(RNG.choice("@+>I") for _ in seq)
            lines += [f"@r{i} c{i}", seq, "+" if i % 2 else f"+r{i}", qual]
        else:
            lines += [f">r{i}", *(seq[k : k + 20] for k in range(0, len(seq), 20))]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n" * (kind == "fastq"))
    (tmp_path / "b.txt").write_text("\n".join(lines[:4] if kind == "fastq" else lines[:2]))
    both = f"{tmp_path}/a.txt,{tmp_path}/b.txt"
    want = fastx.read_fastx(spark, both).orderBy("read_id").collect()
    for size in (400, 1500, 10**6):
        got = fastx.read_fastx(spark, both, size)
        assert got.orderBy("read_id").collect() == want, size
    assert len(want) == 301 and fastx.read_fastx(spark, both, 1000).rdd.getNumPartitions() > 5


def test_index_is_read_back(spark, genome, tmp_path):
    _, _, index = genome
    tables.write_index(index, str(tmp_path / "i"), IndexParams())
    again, ip = tables.read_index(spark, str(tmp_path / "i"))
    assert ip == IndexParams() and again.count() == index.count()


def test_stream_of_reads_maps_like_a_batch(spark, genome, tmp_path):
    parts, refs, index = genome
    _, pairs = made(parts, 40)
    kind = "read_id long, seq1 string, seq2 string, t_rid int, t_pos int, t_size int, t_plus boolean"
    spark.createDataFrame(pairs, kind).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    incremental.map_stream(stream, index, refs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_stream_without_redelivery_and_daily_counts(spark, small, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{small}/mapping_with_barcode.parquet", tmp_path / "in/a.parquet")
    batch = spark.read.parquet(f"{small}/mapping_with_barcode.parquet")
    stream = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    incremental.append_parquet(stream(), str(tmp_path / "o"), str(tmp_path / "c"), incremental.without_redelivery).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == batch.select("read_id").distinct().count()
    q = incremental.daily_counts(stream()).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").agg(F.sum("n_records")).first()[0] == batch.count()
