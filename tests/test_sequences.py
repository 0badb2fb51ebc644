import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions import mapq, sequence
from strandloom.operators import align, minimizers, seeds
from strandloom.operators.adapters import overlap_lengths
from strandloom.params import IndexParams, MapParams, parse_frip, parse_read_format, preset

RNG = random.Random(3)


def dna(n):
    return "".join(RNG.choice("ACGT") for _ in range(n))


def turned(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def brute_minimizers(seq, k, w):
    h, _ = minimizers.kmer_hashes(seq, k)
    out = set()
    for i in range(len(h) - w + 1):
        window = h[i : i + w]
        if (window != minimizers.NONE).all():
            out |= {i + j + k - 1 for j in range(w) if window[j] == window.min()}
    return sorted(out)


@pytest.mark.parametrize("seq", [dna(300), dna(40) + "N" + dna(60), dna(23), dna(22), dna(17), dna(16), "", "A" * 80])
def test_minimizers_are_the_window_minima(seq):
    _, at, _ = minimizers.sequence_minimizers(seq, 17, 7)
    want = brute_minimizers(seq, 17, 7)
    if 17 <= len(seq) < 23:
        assert len(at) == 1
    else:
        assert list(at) == want


def test_many_sequences_at_once_equal_each_alone():
    seqs = [dna(RNG.choice([0, 5, 17, 20, 22, 23, 60, 300])) for _ in range(80)] + [dna(30) + "N" + dna(30)]
    of, h, at, strand = minimizers.batch_minimizers(seqs, 17, 7)
    for i, s in enumerate(seqs):
        for got, want in zip((h, at, strand), minimizers.sequence_minimizers(s, 17, 7)):
            assert list(got[of == i]) == list(want)


@pytest.mark.parametrize("k", [1, 2, 5, 11, 16, 17, 23, 28])
def test_packed_bases(k):
    s = dna(60)
    forward, backward = minimizers.packed(minimizers.codes_of(s), k)
    number = lambda t: int("".join(str("ACGT".index(x)) for x in t), 4)
    assert forward.tolist() == [number(s[i : i + k]) for i in range(61 - k)]
    assert backward.tolist() == [number(turned(s[i : i + k])) for i in range(61 - k)]


def test_reverse_complement_has_the_same_minimizers():
    s = dna(500)
    a, b = (set(minimizers.sequence_minimizers(x, 17, 7)[0].tolist()) for x in (s, turned(s)))
    assert a == b


def test_hash_is_invertible_and_equals_the_column(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 34, 2000).astype(np.uint64)
    h = minimizers.hash64(keys.copy(), 34)
    assert len(set(h.tolist())) == len(set(keys.tolist()))
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").select(sequence.hash64(F.col("k"), 34).alias("h"))
    assert [r["h"] for r in df.collect()] == h.tolist()


def test_pieces_give_the_whole_index(spark, monkeypatch):
    refs = spark.createDataFrame([(0, dna(5000)), (1, dna(20)), (2, ""), (3, None)], "rid int, seq string")
    whole = minimizers.build_index(refs, IndexParams())
    want = {tuple(r) for r in whole.select("hash", "rid", "pos", "strand", "freq").collect()}
    monkeypatch.setattr(minimizers, "PIECE", 97)
    assert {tuple(r) for r in minimizers.build_index(refs, IndexParams()).select("hash", "rid", "pos", "strand", "freq").collect()} == want


def plain_distance(read, window, e):
    """All cells of the band by the textbook recurrence."""
    inf = 10**6
    prev = [0] * (2 * e + 1)
    for i, c in enumerate(read):
        cur = []
        for d in range(2 * e + 1):
            best = prev[d] + (window[i + d] != c)
            if d < 2 * e:
                best = min(best, prev[d + 1] + 1)
            if d:
                best = min(best, cur[d - 1] + 1)
            cur.append(min(best, inf))
        prev = cur
    low = min(prev)
    return low, len(read) - 1 + (e if prev[e] == low else prev.index(low))


def changed(s, n):
    s = list(s)
    for _ in range(n):
        i = RNG.randrange(len(s))
        s[i] = RNG.choice(["", RNG.choice("ACGT"), s[i] + RNG.choice("ACGT")])
    return "".join(s)


def test_band_distance_equals_the_recurrence():
    e, reads, windows = 8, [], []
    for _ in range(300):
        ref = dna(150)
        read = changed(ref[8 : 8 + RNG.randrange(40, 90)], RNG.randrange(0, 7))
        reads.append(read)
        windows.append(ref[: len(read) + 2 * e])
    codes, sizes = align.padded(reads)
    got, first, last = align.band_distance(codes, sizes, align.padded(windows)[0], e)
    for i, (r, w) in enumerate(zip(reads, windows)):
        assert (got[i], last[i]) == plain_distance(r, w, e)
        assert 0 <= first[i] <= 2 * e
        if got[i] == 0:
            assert w[first[i] : last[i] + 1] == r


def test_gapped_alignment_accounts_for_every_base():
    for _ in range(60):
        ref = dna(60)
        read = changed(ref, RNG.randrange(0, 4))
        cigar, nm, md = align.gapped([read], [ref])[0]
        import re

        ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MID])", cigar)]
        assert sum(n for n, op in ops if op in "MI") == len(read) and sum(n for n, op in ops if op in "MD") == len(ref)
        matched = sum(int(x) for x in re.findall(r"\d+", md))
        wrong = len(re.findall(r"(?<![A-Z^])[A-Z]", md))
        assert nm >= 0 and matched <= len(ref)
        x = y = same = 0
        for n, op in ops:
            if op == "M":
                same += sum(a == b for a, b in zip(read[x : x + n], ref[y : y + n]))
            x += n * (op != "D")
            y += n * (op != "I")
        assert matched == same and wrong >= 0


def prefixes(read, window, e):
    codes, sizes = align.padded([read])
    return [int(x[0]) for x in align.prefix_matches(codes, sizes, align.padded([window])[0], e)]


def test_split_prefix_stops_where_the_read_leaves_the_reference():
    ref, e = dna(200), 4
    read = ref[e : e + 60] + dna(40)
    n, wrong, first, end = prefixes(read, ref[: 100 + 2 * e], e)
    assert 58 <= n <= 70 and wrong <= e and first == e and abs(end - (e + n - 1)) <= e
    assert prefixes(dna(100), ref[: 100 + 2 * e], e)[0] == 0


def test_split_read_with_a_damaged_five_prime_end_is_tried_again():
    ref, e = dna(200), 4
    spoilt = "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[x] for x in ref[e : e + 12])
    n, wrong, first, end = prefixes(spoilt + ref[e + 12 : e + 100], ref[: 100 + 2 * e], e)
    assert n == 100 and wrong == 0 and first == e + 12 and end == e + 99


def test_prefixes_of_many_reads_equal_each_alone():
    e, reads, windows = 4, [], []
    for _ in range(200):
        ref = dna(180)
        k = RNG.randrange(5, 90)
        reads.append(changed(ref[e : e + k], RNG.randrange(3)) + dna(RNG.randrange(1, 60)))
        windows.append((ref + dna(200))[: len(reads[-1]) + 2 * e])
    codes, sizes = align.padded(reads)
    got = align.prefix_matches(codes, sizes, align.padded(windows)[0], e)
    assert [tuple(int(x[i]) for x in got) for i in range(200)] == [tuple(prefixes(r, w, e)) for r, w in zip(reads, windows)]


def score(read, ref, p):
    """Best end-to-end affine score by the textbook recurrence."""
    low = -(10**9)
    M, I, D = ([[low] * (len(ref) + 1) for _ in range(len(read) + 1)] for _ in range(3))
    M[0][0] = 0
    for i in range(len(read) + 1):
        for j in range(len(ref) + 1):
            if i and j:
                M[i][j] = max(x[i - 1][j - 1] for x in (M, I, D)) + (p.match if read[i - 1] == ref[j - 1] else -p.mismatch)
            if i:
                I[i][j] = max(max(M[i - 1][j], D[i - 1][j]) - p.gap_open[1] - p.gap_extend[1], I[i - 1][j] - p.gap_extend[1])
            if j:
                D[i][j] = max(max(M[i][j - 1], I[i][j - 1]) - p.gap_open[0] - p.gap_extend[0], D[i][j - 1] - p.gap_extend[0])
    return max(x[-1][-1] for x in (M, I, D))


@pytest.mark.parametrize("params", [MapParams(), MapParams(gap_open=(1, 1)), MapParams(match=2, mismatch=1, gap_open=(9, 2), gap_extend=(3, 1))])
def test_gapped_alignment_is_best_under_the_scores(params):
    import re

    refs = [dna(RNG.randrange(20, 50)) for _ in range(40)]
    reads = [changed(r, RNG.randrange(0, 6)) for r in refs]
    for read, ref, (cigar, nm, _) in zip(reads, refs, align.gapped(reads, refs, params)):
        x = y = total = 0
        for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MID])", cigar)):
            if op == "M":
                total += sum(params.match if a == b else -params.mismatch for a, b in zip(read[x : x + n], ref[y : y + n]))
            else:
                k = op == "I"
                total -= params.gap_open[k] + params.gap_extend[k] * n
            x, y = x + n * (op != "D"), y + n * (op != "I")
        assert (x, y) == (len(read), len(ref)) and total == score(read, ref, params)


def test_gap_scores_change_a_cigar():
    ref = dna(40)
    read = ref[:10] + ref[11:30] + "ACGT"["TGCA".index(ref[30])] + ref[30:]
    assert align.gapped([read], [ref], MapParams(gap_open=(0, 0), mismatch=9))[0][0] != align.gapped([read], [ref], MapParams(gap_open=(60, 60)))[0][0]


def clusters_one_by_one(hits, reach, required, n):
    """The islands hit by hit."""
    out, size, counts, order = [], 0, {}, []

    def best():
        top = max(counts.values())
        return next((p, top) for p in order if counts[p] == top)

    def close():
        if size >= required and counts:
            out.append(best())

    last = None
    for h in hits:
        if last is not None and (h // seeds.WRAP != last // seeds.WRAP or h > last + reach or (size >= n and h > best()[0] + reach)):
            close()
            size, counts, order = 0, {}, []
        size += 1
        if h not in counts:
            order.append(h)
        counts[h] = counts.get(h, 0) + 1
        last = h
    if last is not None:
        close()
    return out


def test_clusters_equal_hits_taken_one_by_one():
    for _ in range(400):
        n = RNG.randrange(1, 6)
        hits = sorted(RNG.randrange(0, 60) + RNG.choice([0, seeds.WRAP]) for _ in range(RNG.randrange(0, 40)))
        assert seeds.cluster(np.array(hits, np.int64), 4, 2, n) == clusters_one_by_one(hits, 4, 2, n)


def test_islands_of_many_ends_equal_each_alone():
    n = np.array([RNG.randrange(1, 6) for _ in range(300)])
    need = np.array([RNG.randrange(1, 3) for _ in range(300)])
    hits = [sorted(RNG.randrange(0, 60) + RNG.choice([0, seeds.WRAP]) for _ in range(RNG.randrange(0, 30))) for _ in range(300)]
    row, spot = np.repeat(np.arange(300), [len(h) for h in hits]), np.array([x for h in hits for x in h])
    back = RNG.sample(range(len(row)), len(row))
    end, at, support = seeds.islands(*seeds.sorted_hits(row[back], spot[back]), 4, need, n)
    for i, h in enumerate(hits):
        assert list(zip(at[end == i].tolist(), support[end == i].tolist())) == clusters_one_by_one(h, 4, need[i], n[i])


def test_paired_candidates_have_partners():
    a = [(100, 3), (5000, 9), (9000, 2)]
    b = [(150, 2), (9900, 3), (seeds.WRAP + 90, 8)]
    left, right = seeds.pair_candidates(a, b, 1000)
    assert left == [(100, 3), (5000, 9), (9000, 2)] and right == [(150, 2), (9900, 3)]
    assert seeds.pair_candidates([], b, 1000) == ([], [])


def test_merge_keeps_the_better_supported():
    assert seeds.merge_candidates([(10, 2), (100, 1)], [(10, 5), (14, 9), (200, 1)], 8) == [(10, 5), (100, 1), (200, 1)]
    assert seeds.rescue_windows(np.array([100, 150, 9000, 500]), np.array([3, 3, 3, 1]), 100, 2, 500) == (3, [(0, 250), (8900, 9100)])
    assert seeds.rescue_windows(np.arange(250), np.full(250, 2), 10, 2, 500) == (-2, [])


def test_signature_of_a_read_and_its_reverse_complement(spark):
    s = dna(80)
    df = spark.createDataFrame([(1, 1, s), (2, 1, turned(s)), (3, 1, dna(80))], "read_id long, mate int, seq string")
    got = {r["read_id"]: r["signature"] for r in seeds.signatures(minimizers.minimizers(df, seeds.END, IndexParams())).collect()}
    assert got[1] == got[2] != got[3]


def overlap_one_by_one(seq1, seq2, least):
    """Every occurrence of either half, tried in order."""
    short, long_ = (seq1, seq2) if len(seq1) <= len(seq2) else (seq2, seq1)
    back, half = turned(long_), least // 2
    for offset in (0, half):
        for begin in range(len(back) - least + 1):
            seed = short[offset : offset + half]
            if len(seed) == half and back[begin + offset : begin + offset + half] == seed and sum(x != y for x, y in zip(back[begin:], short)) <= 1:
                kept = min(len(back) - begin, len(short))
                return (kept, len(back) - begin) if len(seq1) <= len(seq2) else (len(back) - begin, kept)
    return len(seq1), len(seq2)


def test_adapters(spark):
    from strandloom.operators.adapters import trim_pairs

    piece, a, b = dna(40), dna(60), dna(60)
    wrong = piece[:20] + ("A" if piece[20] != "A" else "C") + piece[21:]
    pairs = [(piece + "CTGTCTCTTATACACA", turned(piece) + "CTGTCTCTTATACACA"), (wrong + "CTGTCTCTTATACACA", turned(piece) + "CTGTCTCTTATACACA"), (a, b), ("", b), (piece[:35], turned(piece))]
    for _ in range(300):
        f = dna(RNG.randrange(25, 70))
        pairs.append((changed(f, RNG.randrange(3)) + dna(RNG.randrange(20)), changed(turned(f), RNG.randrange(2)) + dna(RNG.randrange(20))))
    got = overlap_lengths([p[0] for p in pairs], [p[1] for p in pairs], 30)
    assert list(zip(got[0].tolist(), got[1].tolist())) == [overlap_one_by_one(x, y, 30) for x, y in pairs]
    rows = trim_pairs(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)] + [(-1, None, a), (-2, None, None)], "i int, seq1 string, seq2 string")).collect()
    want = {i: (x[: got[0][i]], y[: got[1][i]]) for i, (x, y) in enumerate(pairs)} | {-1: (None, a), -2: (None, None)}
    assert {r["i"]: (r["seq1"], r["seq2"]) for r in rows} == want


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ACGTN",), ("",), (None,), ("ACGTACGTACGTACGTACGT",)], "s string")
    s = F.col("s")
    rows = df.select(sequence.reverse_complement(s), sequence.seed_encode(s, 4), sequence.seed_decode(sequence.seed_encode(s, 4), 4), sequence.n_positions(s), sequence.gc_fraction(s), sequence.cigar_length(F.lit("5M2I3D1M"), "MD"), sequence.longest_match(F.lit("AACGT"), F.lit("AATGT"))).collect()
    assert list(rows[0])[:4] == ["NACGT", 27, "ACGT", [4]] and list(rows[1])[:3] == ["", 0, "AAAA"] and rows[2][0] is None and rows[2][3] is None
    assert rows[0][5] == 9 and rows[0][6] == 2 and rows[3][4] == 0.5


def test_parameters():
    assert preset("atac").tn5_shift and preset("hic").split_alignment and not preset("chip").tn5_shift
    assert IndexParams.for_fragments(80) == IndexParams(19, 10) and len(parse_frip("1;2;3;4;5")) == 5
    bc = parse_read_format("bc:0:15,r1:0:-1,bc:20:25:-").of("bc")
    assert bc.ranges == ((0, 15), (20, 25)) and bc.strand == "-"
    for bad in ("xx:0:1", "bc:5:2", "bc:1"):
        with pytest.raises(ValueError):
            parse_read_format(bad)
    with pytest.raises(ValueError):
        MapParams(error_threshold=16)
    with pytest.raises(ValueError):
        preset("rna")


def test_quality_falls_with_rivals_and_repeats(spark):
    c = F.lit
    df = spark.range(1).select(
        mapq.single(c(0), c(60), c(60), c(1), c(9), c(0), c(0), 8).alias("best"), mapq.single(c(0), c(60), c(60), c(2), c(9), c(0), c(0), 8).alias("tied"),
        mapq.single(c(0), c(60), c(60), c(1), c(1), c(3), c(0), 8).alias("rival"), mapq.single(c(3), c(60), c(60), c(1), c(9), c(0), c(50), 8).alias("repeat"),
    )
    r = df.first()
    assert r["best"] == 60 and r["tied"] == 0 and r["rival"] < 60 and r["repeat"] < 60


def test_registered_frequencies_keep_the_seeds_of_repeated_text(spark):
    """A text that occurs 20 times gives a read all its 20 places, as counted by brute force."""
    from strandloom.plans.sequences import IP, PARAMS

    text = dna(200)
    refs = {i: dna(i) + text for i in range(20)}
    index = minimizers.build_index(spark.createDataFrame(list(refs.items()), "rid int, seq string"), IP)
    ends = minimizers.minimizers(spark.createDataFrame([(1, 1, text[50:110])], "read_id long, mate int, seq string"), seeds.END, IP)
    got = {(r["rid"], r["pos"]) for r in seeds.two_round_hits(ends, index, PARAMS.max_seed_frequencies, IP.kmer_size).filter("plus").collect()}
    assert {(i, s.index(text[50:110])) for i, s in refs.items()} <= got


def test_reads_leave_no_base_between_them(spark, small):
    from strandloom.plans import sequences

    found = sequences.reads(spark, small).select("true_rid", "true_pos").toPandas().sort_values(["true_rid", "true_pos"])
    steps = found.groupby("true_rid").true_pos.diff().dropna()
    assert len(steps) > 1000 and steps.max() <= sequences.READ
    assert abs((found.true_pos % 3 == 0).mean() - 1 / 3) < 0.02 and found.true_pos.mod(sequences.READ).nunique() == sequences.READ


def test_a_worker_that_has_loaded_nothing_else_verifies_reads():
    """A new worker gets its batches as a stream, so that nothing loads parts of pyarrow on the way."""
    ref = "".join(random.Random(1).choices("ACGT", k=76))
    sent = pa.BufferOutputStream()
    batch = pa.record_batch({"seq": [ref[8:68], ref[8:30] + ref[31:69], None, ref[8:68]], "window": [ref, ref, ref, ref[:70]]})
    with pa.ipc.new_stream(sent, batch.schema) as stream:
        stream.write_batch(batch)
    code = """
import sys
import pyarrow as pa
from strandloom.operators import align
for t in align.held(pa.ipc.open_stream(sys.stdin.buffer), 0):
    good, errors, _, _ = align.verified(align.one(t.column(0)), align.one(t.column(1)), 8)
    print(good.tolist(), errors.tolist())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], input=sent.getvalue().to_pybytes(), capture_output=True, cwd=root, timeout=120)
    assert done.returncode == 0, done.stderr.decode()
    assert done.stdout.decode().strip() == "[0, 1] [0, 1]"


@pytest.mark.parametrize("module, call", (("seeds", "seeds.flat_candidates(b.column(0))[0]"), ("pairing", "pairing.drafts_of(b.column(1))[0]")))
def test_a_worker_that_has_loaded_nothing_else_reads_lists(module, call):
    drafts = [[{"mate": 1, "plus": True, "rid": 0, "errors": 0, "start": 1, "last": 2}] * n for n in (2, 0, 1)]
    batch = pa.record_batch({"candidates": [[{"spot": 5, "n": 1}] * n for n in (2, 0, 1)], "drafts": drafts})
    sent = pa.BufferOutputStream()
    with pa.ipc.new_stream(sent, batch.schema) as stream:
        stream.write_batch(batch)
    code = f"import sys\nimport pyarrow as pa\nfrom strandloom.operators import {module}\nfor b in pa.ipc.open_stream(sys.stdin.buffer):\n    print({call}.tolist())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], input=sent.getvalue().to_pybytes(), capture_output=True, cwd=root, timeout=120)
    assert done.returncode == 0, done.stderr.decode()
    assert done.stdout.decode().strip() == "[0, 0, 2]"
