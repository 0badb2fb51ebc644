import random

import pytest

from strandloom.params import MapParams, preset
from strandloom.plans import workflow

RNG = random.Random(21)
TURN = str.maketrans("ACGT", "TGCA")
CELLS = ["ACGTACGT", "GGTTCCAA", "TTTTACGG"]


def dna(n):
    return "".join(RNG.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    parts = [dna(12000), dna(6000)]
    (d / "ref.fa").write_text("".join(f">c{i}\n{p}\n" for i, p in enumerate(parts)))
    lines = {"r1.fq": "", "r2.fq": "", "bc.fq": ""}
    truth = []
    for i in range(120):
        rid = i % 2
        pos = RNG.randrange(50, 5000)
        copies = 3 if i % 10 == 0 else 1
        f = parts[rid][pos : pos + 180]
        a, b = f[:60], f[-60:].translate(TURN)[::-1]
        cell = CELLS[i % 3]
        for _ in range(copies):
            seen = "C" + cell[1:] if i % 5 == 0 else cell
            for name, seq in (("r1.fq", a), ("r2.fq", b), ("bc.fq", "AA" + seen)):
                lines[name] += f"@r{len(truth)}\n{seq}\n+\n{'I' * len(seq)}\n"
            truth.append((rid, pos, cell, copies))
    for name, text in lines.items():
        (d / name).write_text(text)
    (d / "white.txt").write_text("\n".join(CELLS) + "\n")
    (d / "to.tsv").write_text("x1\tACGTACGT\nx2\tGGTTCCAA\nx3\tTTTTACGG\n")
    (d / "order.txt").write_text("c1\n")
    workflow.index_files(spark, str(d / "ref.fa"), str(d / "index"))
    return d, truth


def run(spark, d, out, params, **more):
    workflow.map_files(spark, str(d / "ref.fa"), str(d / "index"), str(d / out), str(d / "r1.fq"), **{k: str(d / v) for k, v in more.items()}, params=params)
    return [r["value"] for r in spark.read.text(str(d / out)).collect()]


def test_single_cell_fragments_with_summary(spark, files):
    d, truth = files
    params = preset("atac").but(read_format="bc:2:-1")
    got = run(spark, d, "frag", params, read2="r2.fq", barcode="bc.fq", whitelist="white.txt", translation="to.tsv", order="order.txt", summary_out="summary")
    name = {c: f"x{i + 1}" for i, c in enumerate(CELLS)}
    want = {f"c{rid}\t{pos + 4}\t{pos + 175}\t{name[cell]}\t{copies}" for rid, pos, cell, copies in truth}
    assert set(got) == want and len(got) == len(want)
    assert [x.split("\t")[0] for x in got] == sorted((x.split("\t")[0] for x in got), reverse=True)
    rows = {r["barcode"]: r for r in spark.read.option("header", True).csv(str(d / "summary")).collect()}
    assert set(rows) == set(CELLS)
    assert sum(int(r["total"]) for r in rows.values()) == len(truth) and sum(int(r["duplicate"]) for r in rows.values()) == len(truth) - len(want)
    assert all(int(r["unmapped"]) == 0 for r in rows.values())


@pytest.mark.parametrize("kind, fields, per", [("BED", 7, 1), ("TagAlign", None, 2), ("PAF", 12, 2), ("SAM", 13, 2)])
def test_bulk_formats(spark, files, kind, fields, per):
    d, truth = files
    got = run(spark, d, f"out_{kind}", MapParams(output_format=kind, trim_adapters=kind == "SAM"), read2="r2.fq")
    body = [x for x in got if not x.startswith("@SQ")]
    assert len(body) == per * len(truth) and len(got) - len(body) == (2 if kind == "SAM" else 0)
    assert fields is None or {len(x.split("\t")) for x in body} == {fields}
    if kind == "SAM":
        assert {x.split("\t")[5] for x in body} == {"60M"} and {x.split("\t")[11] for x in body} == {"NM:i:0"}


def test_contacts_and_single_reads(spark, files):
    d, truth = files
    got = run(spark, d, "pairs", preset("hic"), read2="r2.fq", order="order.txt")
    assert [x for x in got if x.startswith("#chromsize")] == ["#chromsize: c1 6000", "#chromsize: c0 12000"]
    assert sum(not x.startswith("#") for x in got) >= 0.95 * len(truth)
    assert len(run(spark, d, "se", preset("chip"))) == len({t[:2] for t in truth})
    with pytest.raises(ValueError):
        run(spark, d, "none", preset("hic"))
    (d / "other.txt").write_text("CCCCCCCC\n")
    with pytest.raises(ValueError, match="whitelist"):
        run(spark, d, "none", preset("atac").but(read_format="bc:2:-1"), read2="r2.fq", barcode="bc.fq", whitelist="other.txt")


def test_command_line_options():
    from strandloom import __main__ as cli

    args = cli.parser().parse_args("map --reference r --index i --out o --read1 a --preset atac --mapq-threshold 5 --duplicates-at-bulk-level --max-seed-frequencies 10,20 --frip-coefficients 1;2;3;4;5".split())
    p = cli.map_params(args)
    assert p.tn5_shift and p.mapq_threshold == 5 and p.duplicates_at_bulk_level and p.max_seed_frequencies == (10, 20) and p.frip_coefficients[4] == 5
    args = cli.parser().parse_args("index --reference r --out o --min-frag-length 80 --window-size 9".split())
    assert cli.index_params(args).kmer_size == 19 and cli.index_params(args).window_size == 9
