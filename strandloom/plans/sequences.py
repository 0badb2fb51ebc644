"""Queries over sequences: scalar functions, minimizers, seeds, verification, pairing and whole mapping runs.

The test tables hold no bases. A document's letters, folded to A, C, G and T, stand for a
reference sequence, and stretches of it at regular distances for reads with a known origin.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import mapq, sequence
from strandloom.functions.cells import normal_barcode
from strandloom.operators import align, lines, minimizers, overlap, pairing, seeds, store
from strandloom.operators.adapters import trim_pairs
from strandloom.params import EffectiveRange, IndexParams, MapParams
from strandloom.plans import pipeline
from strandloom.plans.records import PAIRED
from strandloom.storage import cut, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
IP = IndexParams()
#: The engine's own seed frequencies; inserts as short as the made fragments.
PARAMS = MapParams(max_insert_size=400)
#: Length of made reads and fragments, and the distance of one read's start to the next: short
#: enough to leave no base between two reads, and prime to 60, so that changed bases vary.
READ, FRAGMENT, STRIDE = 60, 200, 59
_FROM, _TO = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC"


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its name or another, with its SQL twin."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rid, seq``: every document with text."""
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).filter("text IS NOT NULL")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = bytes.maketrans(_FROM[: len(_TO)].encode(), _TO.encode())
        other = bytes(set(range(256)) - set(_FROM[: len(_TO)].encode()))
        for b in batches:
            seq = [t.encode("utf-8", "replace").translate(to, other).decode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(seq, pa.string())], names=["rid", "seq"])

    return texts.select(F.col("doc_id").cast("int").alias("rid"), "text").mapInArrow(fold, "rid int, seq string")


SEQS = f"seqs AS (SELECT doc_id::INT AS rid, regexp_replace(translate(text, '{_FROM}', '{_TO}'), '[^ACGT]', '', 'g') AS seq FROM documents WHERE text IS NOT NULL)"


BAND = 8


def _part(start: Column, size: int) -> Column:
    """Bases of a sequence given as bytes; in a string every character before them would be gone through."""
    return F.substring("seq", start, F.lit(size)).cast("string")


def reads(spark: SparkSession, sf_dir: str, windows: bool = False) -> DataFrame:
    """``read_id, seq, true_rid, true_pos``; every third read has one base changed. With
    ``windows``, also the stretch a read was taken from and BAND bases on either side."""
    at = F.explode(F.sequence(F.lit(8), F.length("seq") - READ - 10, F.lit(STRIDE)))
    rows = references(spark, sf_dir).filter(F.length("seq") >= READ + 18).select("rid", F.col("seq").cast("binary").alias("seq"), at.alias("pos"))
    rows = rows.select(
        (F.col("rid").cast("long") * 1_000_000 + F.col("pos")).alias("read_id"), _part(F.col("pos") + 1, READ).alias("seq"), F.col("rid").alias("true_rid"), F.col("pos").cast("long").alias("true_pos"),
        *([_part(F.col("pos") + 1 - BAND, READ + 2 * BAND).alias("window")] if windows else []),
    )
    spot = (F.col("true_pos") % READ).cast("int")
    other = F.translate(F.substring("seq", spot + 1, F.lit(1)), "ACGT", "CGTA")
    return rows.withColumn("seq", F.when(F.col("true_pos") % 3 == 0, sequence.replace_base(F.col("seq"), spot, other)).otherwise(F.col("seq")))


READS = f"""reads AS (
  SELECT read_id, rid AS true_rid, pos AS true_pos, CASE WHEN pos % 3 = 0 THEN substr(s, 1, pos % {READ}) || translate(substr(s, pos % {READ} + 1, 1), 'ACGT', 'CGTA') || substr(s, pos % {READ} + 2) ELSE s END AS seq
  FROM (SELECT rid, pos, rid::BIGINT * 1000000 + pos AS read_id, substr(seq, pos + 1, {READ}) AS s
        FROM (SELECT rid, seq, unnest(generate_series(8, length(seq) - {READ + 10}, {STRIDE})) AS pos FROM seqs WHERE length(seq) >= {READ + 18})))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``read_id, seq1, seq2, true_rid, true_pos``: both ends of fragments, facing each other."""
    at = F.explode(F.sequence(F.lit(8), F.length("seq") - FRAGMENT - 10, F.lit(STRIDE)))
    rows = references(spark, sf_dir).filter(F.length("seq") >= FRAGMENT + 18).select("rid", F.col("seq").cast("binary").alias("seq"), at.alias("pos"))
    end = sequence.reverse_complement(_part(F.col("pos") + 1 + FRAGMENT - READ, READ))
    return rows.select((F.col("rid").cast("long") * 1_000_000 + F.col("pos")).alias("read_id"), _part(F.col("pos") + 1, READ).alias("seq1"), end.alias("seq2"), F.col("rid").alias("true_rid"), F.col("pos").cast("long").alias("true_pos"))


def hash_sql(x: str, bits: int) -> str:
    """The integer mix in BIGINT arithmetic, over a list; factors are reduced before they shift."""
    m = (1 << bits) - 1
    left = lambda n: f"(v % {1 << max(0, bits - n)}) * {1 << n}"
    steps = [
        f"({m} - v + {left(21)}) % {m + 1}",
        "xor(v, v >> 24)",
        f"(v + {left(3)} + {left(8)}) % {m + 1}",
        "xor(v, v >> 14)",
        f"(v + {left(2)} + {left(4)}) % {m + 1}",
        "xor(v, v >> 28)",
        f"(v + {left(31)}) % {m + 1}",
    ]
    for step in steps:
        x = f"list_transform({x}, lambda v: {step})"
    return x


@query(f"WITH {SEQS} SELECT rid, length(seq) AS n_bases, md5(seq) AS digest FROM seqs")
def load_references(spark, sf_dir):
    """Reference sequences."""
    return references(spark, sf_dir).select("rid", F.length("seq").cast("long").alias("n_bases"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(f"WITH {SEQS} SELECT rid, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS digest FROM seqs")
def revcomp(spark, sf_dir):
    """P2."""
    return references(spark, sf_dir).select("rid", F.md5(sequence.reverse_complement(F.col("seq")).cast("binary")).alias("digest"))


_SEED = " + ".join(f"(strpos('ACGT', substr(rpad(translate(substr(seq, 1, 16), 'N', 'A'), 16, 'A'), {i + 1}, 1)) - 1) * {4 ** (15 - i)}" for i in range(16))


@query(f"WITH {SEQS} SELECT rid, CAST({_SEED} AS BIGINT) AS seed FROM seqs")
def seed_encode(spark, sf_dir):
    """P3."""
    return references(spark, sf_dir).select("rid", sequence.seed_encode(F.col("seq"), 16).alias("seed"))


@query(f"WITH {SEQS} SELECT rid, rpad(substr(seq, 1, 16), 16, 'A') AS bases FROM seqs")
def seed_decode(spark, sf_dir):
    """Seeds read back."""
    return references(spark, sf_dir).select("rid", sequence.seed_decode(sequence.seed_encode(F.col("seq"), 16), 16).alias("bases"))


def _barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, PAIRED).filter("cell_barcode IS NOT NULL").select("record_id", normal_barcode(F.col("cell_barcode")).alias("barcode"))


_BC = f"bc AS (SELECT record_id, trim(split_part(upper(cell_barcode), '-', 1)) AS barcode FROM {PAIRED} WHERE cell_barcode IS NOT NULL)"


@query(f"WITH {_BC} SELECT record_id, array_to_string(list_filter(generate_series(0, length(barcode) - 1), lambda i: substr(barcode, i::INT + 1, 1) = 'N'), ',') AS positions FROM bc")
def n_positions(spark, sf_dir):
    """P5."""
    return _barcodes(spark, sf_dir).select("record_id", F.array_join(sequence.n_positions(F.col("barcode")).cast("array<string>"), ",").alias("positions"))


@query(f"WITH {SEQS} SELECT rid, md5(translate(reverse(substr(seq, 1, 8) || substr(seq, 13)), 'ACGT', 'TGCA')) AS digest FROM seqs")
def effective_range(spark, sf_dir):
    """Two ranges joined, on the minus strand."""
    used = EffectiveRange(((0, 7), (12, -1)), "-")
    return references(spark, sf_dir).select("rid", F.md5(sequence.effective_range(F.col("seq"), used).cast("binary")).alias("digest"))


@query(f"WITH {_BC} SELECT record_id, substr(barcode, 1, 10) AS trimmed, substr(barcode, 1, 3) || 'G' || substr(barcode, 5) AS replaced FROM bc")
def trim_and_replace(spark, sf_dir):
    """P6 and P7."""
    b = F.col("barcode")
    return _barcodes(spark, sf_dir).select("record_id", sequence.trim(b, 10).alias("trimmed"), sequence.replace_base(b, F.lit(3), F.lit("G")).alias("replaced"))


@query(f"WITH {SEQS} SELECT rid, round((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq), 9) AS gc FROM seqs WHERE length(seq) > 0")
def gc_fraction(spark, sf_dir):
    """Share of G and C."""
    return references(spark, sf_dir).filter("length(seq) > 0").select("rid", F.round(sequence.gc_fraction(F.col("seq")), 9).alias("gc"))


@query(f"SELECT record_id, CAST({hash_sql('[(record_id * 7919 + coalesce(fragment_start_position, 0)) % 17179869184]', 34)}[1] AS BIGINT) AS h FROM {PAIRED}")
def hash64(spark, sf_dir):
    """The integer mix of 17-mers."""
    key = F.col("record_id") * 7919 + F.coalesce("fragment_start_position", F.lit(0))
    return table(spark, sf_dir, PAIRED).select("record_id", sequence.hash64(key, 34).alias("h"))


KMERS = f"""{SEQS},
b0 AS (SELECT rid, pos, strpos('ACGT', base) - 1 AS f FROM (SELECT rid, unnest(generate_series(0, length(seq) - 1)) AS pos, unnest(string_split(seq, '')) AS base FROM seqs WHERE seq <> '')),
b1 AS (SELECT *, 3 - f AS r FROM b0),
b2 AS (SELECT *, f * 4 + lead(f, 1) OVER w AS f2, r + 4 * lead(r, 1) OVER w AS r2 FROM b1 WINDOW w AS (PARTITION BY rid ORDER BY pos)),
b4 AS (SELECT *, f2 * 16 + lead(f2, 2) OVER w AS f4, r2 + 16 * lead(r2, 2) OVER w AS r4 FROM b2 WINDOW w AS (PARTITION BY rid ORDER BY pos)),
b8 AS (SELECT *, f4 * 256 + lead(f4, 4) OVER w AS f8, r4 + 256 * lead(r4, 4) OVER w AS r8 FROM b4 WINDOW w AS (PARTITION BY rid ORDER BY pos)),
b17 AS (SELECT rid, pos, (f8 * 65536 + lead(f8, 8) OVER w) * 4 + lead(f, 16) OVER w AS f17, r8 + 65536 * lead(r8, 8) OVER w + 4294967296 * lead(r, 16) OVER w AS r17
  FROM b8 WINDOW w AS (PARTITION BY rid ORDER BY pos)),
once AS (SELECT rid, pos, {hash_sql('[f17, r17]', 34)} AS h FROM b17 WHERE f17 IS NOT NULL),
kmers AS (SELECT rid, pos + 16 AS pos, (h[1] >= h[2])::INT AS strand, CAST({hash_sql('[least(h[1], h[2])]', 34)}[1] AS BIGINT) AS hash FROM once)"""
_FINGERPRINT = "CAST(sum((hash % 1000003) * (pos % 9973 + 1) + strand) AS BIGINT) AS fingerprint"


@query(f"WITH {KMERS} SELECT rid, count(*) AS n_kmers, min(hash) AS least, {_FINGERPRINT} FROM kmers GROUP BY rid")
def kmers(spark, sf_dir):
    """P10: canonical k-mers of every reference, summed up per sequence."""
    every = minimizers.minimizers(references(spark, sf_dir), ["rid"], IndexParams(17, 1))
    return every.groupBy("rid").agg(F.count("*").alias("n_kmers"), F.min("hash").alias("least"), F.sum((F.col("hash") % 1000003) * (F.col("pos") % 9973 + 1) + F.col("strand")).alias("fingerprint"))


MINIMIZERS = f"""{KMERS},
w1 AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN min(hash) OVER w END AS m FROM kmers WINDOW w AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
w2 AS (SELECT *, max(m) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS held FROM w1),
minimizers AS (SELECT rid, pos, strand, hash FROM w2 WHERE held = hash)"""


@query(f"WITH {MINIMIZERS} SELECT rid, count(*) AS n_minimizers, {_FINGERPRINT} FROM minimizers GROUP BY rid", "minimizers")
def minimizers_of_references(spark, sf_dir):
    """K1, summed up per sequence."""
    found = minimizers.minimizers(references(spark, sf_dir), ["rid"], IP)
    return found.groupBy("rid").agg(F.count("*").alias("n_minimizers"), F.sum((F.col("hash") % 1000003) * (F.col("pos") % 9973 + 1) + F.col("strand")).alias("fingerprint"))


@query(f"WITH {MINIMIZERS} SELECT hash, count(*) AS freq, min(rid) AS first_rid, max(pos) AS last_pos FROM minimizers GROUP BY hash")
def index_build(spark, sf_dir):
    """K2, one row per hash."""
    return minimizers.build_index(references(spark, sf_dir), IP).groupBy("hash").agg(F.max("freq").alias("freq"), F.min("rid").alias("first_rid"), F.max("pos").alias("last_pos"))


@query(f"""WITH {MINIMIZERS}, by_hash AS (SELECT hash, count(*) AS n FROM minimizers GROUP BY hash)
SELECT CAST(sum(n) AS BIGINT) AS n_minimizers, count(*) AS n_distinct, count(*) FILTER (n = 1) AS n_singletons, round(sum(n) / count(*), 6) AS mean_occurrence,
  round((SELECT sum(length(seq)) FROM seqs) / sum(n), 6) AS mean_spacing FROM by_hash""")
def index_stats(spark, sf_dir):
    """K3."""
    refs = references(spark, sf_dir)
    return minimizers.index_statistics(minimizers.build_index(refs, IP), refs)


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs = cut(references(spark, sf_dir))
    return refs, cut(minimizers.build_index(refs, IP))


def _store(spark: SparkSession, sf_dir: str) -> store.Store:
    return store.build_store(references(spark, sf_dir), IP, PARAMS.max_seed_frequencies[1])


def _read_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimizers.minimizers(reads(spark, sf_dir).withColumn("mate", F.lit(1)), seeds.END, IP)


def _read_sql(columns: str, of: str) -> str:
    """The minimizer chain once more over the reads, under other names."""
    chain = MINIMIZERS.split("),\n", 1)[1]
    for name in ("b0", "b1", "b2", "b4", "b8", "b17", "once", "kmers", "w1", "w2", "minimizers"):
        for before, after in ((f"{name} AS (", f"r_{name} AS ("), (f"FROM {name} ", f"FROM r_{name} "), (f"FROM {name})", f"FROM r_{name})"), (f"FROM {name}\n", f"FROM r_{name}\n")):
            chain = chain.replace(before, after)
    chain = chain.replace("FROM seqs", "FROM read_seqs").replace("rid", "read_id")
    return f"WITH {MINIMIZERS}, {READS}, read_seqs AS (SELECT read_id AS rid, seq FROM reads), {chain.replace('SELECT read_id, unnest', 'SELECT rid AS read_id, unnest')}, {columns} {of}"


_INDEX = "freqs AS (SELECT hash, count(*) AS freq FROM minimizers GROUP BY hash)"
_HITS = """hits AS (SELECT r.read_id, m.rid, r.strand = m.strand AS plus, (CASE WHEN r.strand = m.strand THEN m.pos - r.pos ELSE m.pos + r.pos - 16 END + 4294967296) % 4294967296 AS pos, f.freq
  FROM r_minimizers r JOIN minimizers m ON r.hash = m.hash JOIN freqs f ON r.hash = f.hash)"""


@query(_read_sql(f"{_INDEX}, {_HITS}", f"SELECT read_id, plus, count(*) AS n_hits, count(DISTINCT rid * 4294967296 + pos) AS n_places, CAST(sum((rid * 7919 + pos) % 1000003) AS BIGINT) AS fingerprint FROM hits WHERE freq < {PARAMS.max_seed_frequencies[0]} GROUP BY ALL"))
def seed_hits(spark, sf_dir):
    """K5: candidate positions of the reads' seeds, summed up per read and strand."""
    return store.hit_sums(reads(spark, sf_dir), _store(spark, sf_dir), PARAMS.max_seed_frequencies[0])


@query(_read_sql(f"{_INDEX}, often AS (SELECT r.read_id, r.pos, r.pos - lag(r.pos) OVER (PARTITION BY r.read_id ORDER BY r.pos) AS step FROM r_minimizers r JOIN freqs f ON r.hash = f.hash WHERE f.freq >= {PARAMS.max_seed_frequencies[0]})",
                 "SELECT read_id, CAST(sum(CASE WHEN step < 23 THEN step ELSE 17 END) AS BIGINT) AS repetitive_length, count(*) AS n_repetitive FROM often GROUP BY read_id"))
def repetitive_seeds(spark, sf_dir):
    """K6."""
    _, index = _index(spark, sf_dir)
    return seeds.repetitive_seeds(_read_minimizers(spark, sf_dir), index, PARAMS.max_seed_frequencies[0], IP).drop("mate")


@query(_read_sql(f"{_INDEX}, {_HITS}, first_round AS (SELECT DISTINCT read_id FROM hits WHERE freq < {PARAMS.max_seed_frequencies[0]})",
                 f"SELECT read_id, count(*) AS n_hits FROM hits WHERE freq < {PARAMS.max_seed_frequencies[1]} AND read_id NOT IN (SELECT read_id FROM first_round) GROUP BY read_id"))
def seed_fallback(spark, sf_dir):
    """K7: reads without rare seeds, seeded with more frequent ones."""
    _, index = _index(spark, sf_dir)
    hits = seeds.two_round_hits(_read_minimizers(spark, sf_dir), index, PARAMS.max_seed_frequencies, IP.kmer_size)
    return hits.filter("round = 2").groupBy("read_id").agg(F.count("*").alias("n_hits"))


_FOLD = """list_reduce(list_prepend({'p': -1, 'size': 0, 'best': 0, 'most': 0, 'here': -1, 'same': 0, 'out': []::STRUCT(p BIGINT, n BIGINT)[]}::STRUCT(p BIGINT, size BIGINT, best BIGINT, most BIGINT, here BIGINT, same BIGINT, "out" STRUCT(p BIGINT, n BIGINT)[]), steps), lambda a, x: {
    'p': x.p,
    'size': CASE WHEN a.size >= n_min AND x.p > a.best + 8 THEN 1 ELSE a.size + 1 END,
    'best': CASE WHEN a.size >= n_min AND x.p > a.best + 8 THEN x.p WHEN (CASE WHEN x.p = a.here THEN a.same + 1 ELSE 1 END) > a.most THEN x.p ELSE a.best END,
    'most': CASE WHEN a.size >= n_min AND x.p > a.best + 8 THEN 1 ELSE greatest(a.most, CASE WHEN x.p = a.here THEN a.same + 1 ELSE 1 END) END,
    'here': x.p,
    'same': CASE WHEN NOT (a.size >= n_min AND x.p > a.best + 8) AND x.p = a.here THEN a.same + 1 ELSE 1 END,
    'out': CASE WHEN a.size >= n_min AND x.p > a.best + 8 AND a.size >= need THEN list_append(a.out, {'p': a.best, 'n': a.most}) ELSE a.out END})"""
_LOW, _HIGH = PARAMS.max_seed_frequencies
_CLUSTERS = f"""{_INDEX}, {_HITS},
marked AS (SELECT r.read_id, r.pos, f.freq FROM r_minimizers r LEFT JOIN freqs f ON r.hash = f.hash),
often AS (SELECT read_id, pos - lag(pos) OVER (PARTITION BY read_id ORDER BY pos) AS step FROM marked WHERE freq >= {_LOW}),
per_read AS (SELECT read_id, count(*) AS n_min, count(*) FILTER (freq >= {_LOW}) AS n_rep, min(freq) AS rarest FROM marked GROUP BY read_id),
rep AS (SELECT read_id, sum(CASE WHEN step < 23 THEN step ELSE 17 END) AS repetitive_length FROM often GROUP BY read_id),
taken AS (SELECT h.* FROM hits h JOIN per_read p ON h.read_id = p.read_id WHERE h.freq < CASE WHEN p.rarest < {_LOW} THEN {_LOW} ELSE {_HIGH} END),
sides AS (SELECT read_id, count(DISTINCT plus) AS n_sides FROM taken GROUP BY read_id),
needs AS (SELECT p.read_id, n_min, coalesce(repetitive_length, 0) AS repetitive_length, CASE WHEN rarest >= {_LOW} AND rarest < {_HIGH} AND n_sides = 2 THEN 2 ELSE least(2, greatest(1, n_min - n_rep)) END AS need
  FROM per_read p LEFT JOIN rep USING (read_id) LEFT JOIN sides USING (read_id)),
spots AS (SELECT read_id, plus, rid, pos, count(*) AS n FROM taken GROUP BY ALL),
steps AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 8 THEN 0 ELSE 1 END AS new FROM spots WINDOW w AS (PARTITION BY read_id, plus, rid ORDER BY pos)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY read_id, plus, rid ORDER BY pos) AS island FROM steps),
islands AS (SELECT read_id, plus, rid, sum(n) AS size, first(pos ORDER BY n DESC, pos) AS best, max(n) AS top, list({{'pos': pos, 'n': n}} ORDER BY pos) AS held FROM numbered GROUP BY read_id, plus, rid, island),
known AS (SELECT i.*, n_min, need FROM islands i JOIN needs USING (read_id)),
long_ones AS (SELECT read_id, plus, rid, n_min, need, {_FOLD} AS f FROM (SELECT *, flatten(list_transform(held, lambda h: list_transform(generate_series(1, h.n), lambda i: {{'p': h.pos, 'size': 0, 'best': 0, 'most': 0, 'here': -1, 'same': 0, 'out': []::STRUCT(p BIGINT, n BIGINT)[]}}::STRUCT(p BIGINT, size BIGINT, best BIGINT, most BIGINT, here BIGINT, same BIGINT, "out" STRUCT(p BIGINT, n BIGINT)[])))) AS steps FROM known WHERE size > n_min)),
found AS (
  SELECT read_id, plus, rid, best AS pos, top AS n FROM known WHERE size <= n_min AND size >= need
  UNION ALL SELECT read_id, plus, rid, c.p, c.n FROM (SELECT read_id, plus, rid, unnest(CASE WHEN f.size >= need THEN list_append(f.out, {{'p': f.best, 'n': f.most}}) ELSE f.out END) AS c FROM long_ones))"""


@query(_read_sql(_CLUSTERS, """SELECT n.read_id, n_min AS n_minimizers, CAST(repetitive_length AS BIGINT) AS repetitive_length, CAST(need AS BIGINT) AS required, count(*) FILTER (plus) AS n_plus, count(*) FILTER (NOT plus) AS n_minus,
  CAST(coalesce(sum(f.n), 0) AS BIGINT) AS support, CAST(coalesce(sum((rid * 7919 + pos) % 1000003 * f.n), 0) AS BIGINT) AS fingerprint FROM needs n LEFT JOIN found f USING (read_id) GROUP BY ALL"""))
def hit_clusters(spark, sf_dir):
    """Candidates of every read on both strands, summed up per read."""
    rows = store.read_candidates(reads(spark, sf_dir), _store(spark, sf_dir), PARAMS, IP)
    each = F.concat("plus1", "minus1")
    weighed = F.aggregate(each, F.lit(0).cast("long"), lambda a, c: a + (F.floor(c["spot"] / seeds.WRAP) * 7919 + c["spot"] % seeds.WRAP) % 1_000_003 * c["n"])
    support = F.aggregate(each, F.lit(0).cast("long"), lambda a, c: a + c["n"])
    return rows.select("read_id", *(F.col(f"{c}1").cast("long").alias(c) for c in ("n_minimizers", "repetitive_length", "required")), *(F.size(f"{c}1").cast("long").alias(f"n_{c}") for c in ("plus", "minus")), support.alias("support"), weighed.alias("fingerprint"))


@query(_read_sql("""gapped AS (SELECT read_id, pos, hash, strand, coalesce(pos - lag(pos) OVER w, 0) AS before, coalesce(lead(pos) OVER w - pos, 0) AS behind FROM r_minimizers WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
texts AS (SELECT read_id, string_agg(hash || ':' || strand || ':' || before, ',' ORDER BY pos) AS forward, string_agg(hash || ':' || (1 - strand) || ':' || behind, ',' ORDER BY pos DESC) AS backward FROM gapped GROUP BY read_id)""",
                 "SELECT least(forward, backward) AS signature, count(*) AS n_reads, min(read_id) AS first_read FROM texts GROUP BY ALL"))
def cache_signatures(spark, sf_dir):
    """Reads that share a seed signature, so that their seeding need be done once."""
    return seeds.signatures(_read_minimizers(spark, sf_dir)).groupBy("signature").agg(F.count("*").alias("n_reads"), F.min("read_id").alias("first_read"))


@query(f"WITH {SEQS}, {READS} SELECT read_id, CASE WHEN true_pos % 3 = 0 THEN 1 ELSE 0 END AS errors, {BAND} AS first, {BAND + READ - 1} AS last FROM reads")
def edit_distance(spark, sf_dir):
    """V1 to V3 and V6: every read against the stretch it was taken from, with a base changed or not."""
    return align.verify(reads(spark, sf_dir, windows=True), ["read_id"], BAND)


_EDITED = f"""edited AS (
  SELECT read_id, CASE true_pos % 5 WHEN 0 THEN seq WHEN 1 THEN substr(seq, 1, k) || substr(seq, k + 2) WHEN 2 THEN substr(seq, 1, k) || 'A' || substr(seq, k + 1)
    WHEN 3 THEN substr(seq, 1, k) || translate(substr(seq, k + 1, 1), 'ACGT', 'CGTA') || substr(seq, k + 3) ELSE substr(seq, 1, k) || 'CG' || substr(seq, k + 1, 12) || substr(seq, k + 14) END AS seq, true_rid, true_pos
  FROM (SELECT *, 10 + true_pos % 30 AS k FROM reads)),
framed AS (SELECT e.read_id, e.seq, length(e.seq) AS n, substr(s.seq, true_pos + 1 - {BAND}, length(e.seq) + {2 * BAND}) AS frame FROM edited e JOIN seqs s ON e.true_rid = s.rid),
tries AS (SELECT read_id, seq, frame, n, unnest(generate_series(0, {2 * BAND})) AS a FROM framed),
spans AS (SELECT *, unnest(generate_series(-3, 3)) AS d FROM tries)"""


@query(f"WITH {SEQS}, {READS}, {_EDITED} SELECT read_id, min(levenshtein(seq, substr(frame, (a + 1)::INT, (n + d)::INT)))::INT AS errors FROM spans WHERE a + n + d <= length(frame) GROUP BY read_id")
def edit_distance_indels(spark, sf_dir):
    """V1 to V3 with up to three inserted, deleted and changed bases, against every stretch of the window
    that can differ by no more."""
    k, seq = (F.col("true_pos") % 30 + 10).cast("int"), F.col("seq")
    part = lambda a, n=None: F.substring(seq, a, F.lit(READ) if n is None else n)
    made = (
        F.when(F.col("true_pos") % 5 == 0, seq).when(F.col("true_pos") % 5 == 1, F.concat(part(F.lit(1), k), part(k + 2))).when(F.col("true_pos") % 5 == 2, F.concat(part(F.lit(1), k), F.lit("A"), part(k + 1)))
        .when(F.col("true_pos") % 5 == 3, F.concat(part(F.lit(1), k), F.translate(part(k + 1, F.lit(1)), "ACGT", "CGTA"), part(k + 3))).otherwise(F.concat(part(F.lit(1), k), F.lit("CG"), part(k + 1, F.lit(12)), part(k + 14)))
    )
    refs = references(spark, sf_dir).select(F.col("rid").alias("true_rid"), F.col("seq").alias("ref"))
    rows = reads(spark, sf_dir).withColumn("seq", made).join(refs, "true_rid")
    window = F.substring("ref", (F.col("true_pos") + 1 - BAND).cast("int"), F.length("seq") + 2 * BAND)
    return align.verify(rows.select("read_id", "seq", window.alias("window")), ["read_id"], BAND).select("read_id", "errors")


@query()
def draft_best(spark, sf_dir):
    """Least errors of every read with the counts behind its quality."""
    return _best(reads(spark, sf_dir), _store(spark, sf_dir))


def _best(made: DataFrame, index: store.Store) -> DataFrame:
    return pipeline.best_of_reads(made, index, PARAMS, IP).select("read_id", F.col("errors").alias("errors_min"), "n_best", "errors_second", "n_second", *(["sure"] if "sure" in made.columns else []))


_PIECES = f"""pieces AS (SELECT rid::BIGINT * 1000000 + pos AS read_id, substr(seq, pos + 1, 40) AS piece FROM (SELECT rid, seq, unnest(generate_series(8, length(seq) - 120, 40)) AS pos FROM seqs WHERE length(seq) >= 140)),
mates AS (SELECT read_id, piece || 'CTGTCTCTTATACACATCTC' AS a, translate(reverse(translate(reverse(piece), 'ACGT', 'TGCA') || 'CTGTCTCTTATACACATCTG'), 'ACGT', 'TGCA') AS b FROM pieces),
tried AS (SELECT read_id, a, b, unnest(generate_series(0, 30)) AS x FROM mates),
fits AS (SELECT read_id, x, substr(b, x + 1, 15) = substr(a, 1, 15) AS one, substr(b, x + 16, 15) = substr(a, 16, 15) AS two, hamming(substr(b, x + 1), substr(a, 1, 60 - x)) <= 1 AS near FROM tried),
chosen AS (SELECT read_id, coalesce(min(x) FILTER (near AND one), min(x) FILTER (near AND two)) AS x FROM fits GROUP BY read_id)"""


@query(f"WITH {SEQS}, {_PIECES} SELECT read_id, (CASE WHEN x IS NULL THEN 60 ELSE 60 - x END)::INT AS kept1, (CASE WHEN x IS NULL THEN 60 ELSE 60 - x END)::INT AS kept2 FROM chosen")
def adapter_trim(spark, sf_dir):
    """Fragments shorter than their reads lose the adapter read behind them."""
    at = F.explode(F.sequence(F.lit(8), F.length("seq") - 120, F.lit(40)))
    rows = references(spark, sf_dir).filter(F.length("seq") >= 140).select("rid", "seq", at.alias("pos"))
    piece = F.substring("seq", F.col("pos") + 1, F.lit(40))
    made = rows.select((F.col("rid").cast("long") * 1_000_000 + F.col("pos")).alias("read_id"), F.concat(piece, F.lit("CTGTCTCTTATACACATCTC")).alias("seq1"), F.concat(sequence.reverse_complement(piece), F.lit("CTGTCTCTTATACACATCTG")).alias("seq2"))
    return trim_pairs(made).select("read_id", F.length("seq1").alias("kept1"), F.length("seq2").alias("kept2"))


def _sure(found: DataFrame) -> DataFrame:
    """What was found of reads of which every seed in the index has one place, where the read was taken from, and two at least."""
    return found.filter("sure").drop("sure")


_SURE = f"""{_INDEX}, {_HITS},
sure AS (SELECT h.read_id, count(*) AS n_met FROM hits h JOIN reads t ON h.read_id = t.read_id GROUP BY h.read_id HAVING bool_and(freq = 1 AND rid = true_rid AND plus AND pos = true_pos) AND count(*) >= 2),
every AS (SELECT read_id, count(*) AS n_min FROM r_minimizers GROUP BY read_id),
placed AS (SELECT t.*, (true_pos % 3 = 0)::INT AS changed, CASE WHEN n_met = n_min THEN 0 ELSE (true_pos % 3 = 0)::INT END AS errors FROM reads t JOIN sure USING (read_id) JOIN every USING (read_id))"""


@query(_read_sql(_SURE, "SELECT read_id, errors AS errors_min, 1 AS n_best, 9 AS errors_second, 0 AS n_second FROM placed"))
def draft_best_sure(spark, sf_dir):
    """V11 to V15 for reads whose one place follows from their seeds; a read all of whose seeds are met
    there counts as free of errors without being looked at."""
    index = _store(spark, sf_dir)
    return _sure(_best(store.sure_reads(reads(spark, sf_dir), index), index))


@query(_read_sql(_SURE, f"SELECT read_id, true_rid, true_pos, true_rid AS rid, true_pos AS fragment_start_position, {READ} AS fragment_length, 60 AS mapq, 1 AS direction, 1 AS is_unique, errors, 0 AS nth FROM placed"))
def map_se_sure(spark, sf_dir):
    """Single-end mapping of every read; given out are those whose one place follows from their seeds."""
    index = _store(spark, sf_dir)
    return _sure(pipeline.map_single(store.sure_reads(reads(spark, sf_dir), index), index, index, PARAMS, IP))


@query(f"WITH {SEQS}, {READS} SELECT count(*) AS n_reads, true AS mapped_0_99, true AS origin_found_0_95 FROM reads")
def map_se_share(spark, sf_dir):
    """Whether 0.99 of all reads map, and 0.95 of those with one best place to where they were taken from
    (the others are reads of which an exact copy lies elsewhere, or nearer than the changed origin)."""
    index, made = _store(spark, sf_dir), reads(spark, sf_dir)
    found = pipeline.map_single(made, index, index, PARAMS, IP)
    counts = found.agg(F.count("*").alias("n"), F.count_if(F.expr("is_unique = 1")).alias("one"), F.count_if(F.expr("is_unique = 1 AND rid = true_rid AND abs(fragment_start_position - true_pos) <= 8")).alias("there"))
    return made.agg(F.count("*").alias("n_reads")).crossJoin(counts).select("n_reads", (F.col("n") >= 0.99 * F.col("n_reads")).alias("mapped_0_99"), (F.col("there") >= 0.95 * F.col("one")).alias("origin_found_0_95"))  # one row each


_LONE = f"""freqs AS (SELECT hash, count(*) AS freq FROM minimizers GROUP BY hash),
often AS (SELECT m.rid, m.pos FROM minimizers m JOIN freqs f ON m.hash = f.hash WHERE freq > 1),
fragments AS (SELECT rid, pos, rid::BIGINT * 1000000 + pos AS read_id FROM (SELECT rid, unnest(generate_series(8, length(seq) - {FRAGMENT + 10}, {STRIDE})) AS pos FROM seqs WHERE length(seq) >= {FRAGMENT + 18})),
spoilt AS (SELECT DISTINCT read_id FROM fragments f JOIN often o ON f.rid = o.rid AND ((o.pos >= f.pos + 16 AND o.pos < f.pos + {READ}) OR (o.pos >= f.pos + {FRAGMENT - READ} + 16 AND o.pos < f.pos + {FRAGMENT})))"""


@query(f"WITH {MINIMIZERS}, {_LONE} SELECT read_id, rid AS true_rid, pos AS true_pos, rid, pos AS fragment_start_position, {FRAGMENT} AS fragment_length, 60 AS mapq, 1 AS direction, 1 AS is_unique, {READ} AS positive_alignment_length, {READ} AS negative_alignment_length, 0 AS nth FROM fragments WHERE read_id NOT IN (SELECT read_id FROM spoilt)")
def map_pe_sure(spark, sf_dir):
    """Paired-end mapping of every pair; given out are those whose stretches hold only minimizers that
    occur once in the reference, so that their one place is where they were taken from."""
    refs, index = _index(spark, sf_dir)
    made = pairs(spark, sf_dir)
    often = index.filter("freq > 1").select("rid", F.col("pos").alias("c"), (F.col("pos") + 1).alias("d"))
    ends = F.explode(F.array(F.lit(0), F.lit(FRAGMENT - READ)))
    spans = made.select("read_id", F.col("true_rid").alias("rid"), "true_pos", ends.alias("shift")).select("read_id", "rid", (F.col("read_id") * 2 + (F.col("shift") > 0).cast("long")).alias("span"), (F.col("true_pos") + F.col("shift") + 16).alias("a"), (F.col("true_pos") + F.col("shift") + READ).alias("b"))
    lone = overlap.count_overlaps(spans, often, ["rid"], "span").groupBy("read_id").agg(F.sum("n_overlaps").alias("n")).filter("n = 0")
    return pipeline.map_paired(made, index, refs, PARAMS, IP).join(lone, "read_id", "left_semi")


@query(_read_sql(_SURE, f"""SELECT concat_ws(chr(9), 'r' || read_id, '0', 'd' || true_rid, true_pos + 1, '60', '{READ}M', '*', '0', '0', p.seq, '*', 'NM:i:' || changed,
  'MD:Z:' || CASE WHEN changed = 0 THEN '{READ}' ELSE (true_pos % {READ}) || substr(s.seq, (true_pos + true_pos % {READ} + 1)::INT, 1) || ({READ - 1} - true_pos % {READ}) END) AS line FROM placed p JOIN seqs s ON p.true_rid = s.rid"""))
def sam_rows_sure(spark, sf_dir):
    """SAM lines of the reads whose one place follows from their seeds."""
    index = _store(spark, sf_dir)
    made = store.sure_reads(reads(spark, sf_dir).withColumn("bases", F.col("seq")), index)
    found = _sure(pipeline.map_single(made, index, index, PARAMS, IP))
    return lines.sam_lines(pipeline.sam_records(found.withColumn("seq", F.col("bases")), index, PARAMS))


@query()
def map_se_end2end(spark, sf_dir):
    """Single-end mapping of every read."""
    index = _store(spark, sf_dir)
    return pipeline.map_single(reads(spark, sf_dir), index, index, PARAMS, IP)


@query()
def map_pe_end2end(spark, sf_dir):
    """Paired-end mapping of every pair, with mate rescue and mate filter."""
    refs, index = _index(spark, sf_dir)
    return pipeline.map_paired(pairs(spark, sf_dir), index, refs, PARAMS, IP)


@query()
def map_hic_end2end(spark, sf_dir):
    """Split mapping of every pair to contacts."""
    refs, index = _index(spark, sf_dir)
    return pipeline.map_paired(pairs(spark, sf_dir), index, refs, PARAMS.but(split_alignment=True, error_threshold=4, mapq_threshold=1, output_format="pairs"), IP)


@query()
def sam_rows(spark, sf_dir):
    """SAM lines of the mapped single reads."""
    index = _store(spark, sf_dir)
    found = pipeline.map_single(reads(spark, sf_dir).withColumn("bases", F.col("seq")), index, index, PARAMS, IP)
    return lines.sam_lines(pipeline.sam_records(found.withColumn("seq", F.col("bases")), index, PARAMS))


_NUMBERS = f"""numbers AS (
  SELECT record_id, record_id % 9 AS errors, record_id * 31 % 9 + 1 AS more, 30 + record_id * 7 % 121 AS aligned, 40 + record_id * 13 % 101 AS size,
    record_id * 17 % 3 + 1 AS best, record_id * 19 % 6 AS rivals, record_id * 23 % 160 AS repetitive, coalesce(mapq, 0) AS m1, coalesce(num_dups, 0) % 61 AS m2, is_unique
  FROM {PAIRED})"""


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic on record numbers that covers the formulas' branches."""
    r = F.col("record_id")
    return table(spark, sf_dir, PAIRED).select(
        "record_id", (r % 9).cast("int").alias("errors"), (r * 31 % 9 + 1).cast("int").alias("more"), (30 + r * 7 % 121).cast("int").alias("aligned"), (40 + r * 13 % 101).cast("int").alias("size"),
        (r * 17 % 3 + 1).cast("int").alias("best"), (r * 19 % 6).cast("int").alias("rivals"), (r * 23 % 160).cast("int").alias("repetitive"), F.coalesce("mapq", F.lit(0)).alias("m1"),
        (F.coalesce("num_dups", F.lit(0)) % 61).alias("m2"), "is_unique",
    )


_KEEP = "CASE WHEN identity <= 0.95 THEN 1 - sqrt(f) WHEN identity <= 0.97 THEN 1 - f WHEN identity >= 0.999 THEN 1 - f * f * f * f ELSE 1 - f * f END"


@query(f"""WITH {_NUMBERS},
a AS (SELECT *, greatest(aligned, size) AS l, errors + more AS second FROM numbers),
b AS (SELECT *, 1 - errors / l AS identity, CASE WHEN l < 50 THEN 1.0::DOUBLE ELSE 3 / ln(l) END * ((1 - errors / l) * (1 - errors / l)) AS t, CASE WHEN repetitive >= size THEN 0.999::DOUBLE ELSE repetitive / size END AS f FROM a),
c AS (SELECT *, greatest(0, least(60, CASE WHEN best > 1 THEN 0 ELSE trunc(5 * 6.02::DOUBLE * (least(second, errors + 8) - errors) * t * t + 0.499) END - CASE WHEN rivals > 0 THEN trunc(4.343::DOUBLE * ln(rivals + 1) + 0.499) ELSE 0 END)) AS q FROM b)
SELECT record_id, CAST(CASE WHEN repetitive > 0 THEN trunc(q * ({_KEEP}) + 0.499) ELSE q END AS INT) AS mapq FROM c""")
def mapq_single(spark, sf_dir):
    """T6 over arithmetic inputs."""
    c = F.col
    return _numbers(spark, sf_dir).select("record_id", mapq.single(c("errors"), c("aligned"), c("size"), c("best"), c("errors") + c("more"), c("rivals"), c("repetitive"), 8).alias("mapq"))


@query(f"""WITH {_NUMBERS},
b AS (SELECT *, 1 - errors / greatest(aligned, size) AS identity, CASE WHEN repetitive >= size THEN 0.999::DOUBLE ELSE repetitive / size END AS f FROM numbers),
c AS (SELECT *, greatest(0, least(60, trunc(5 * 6.02::DOUBLE * (least(errors + more, errors + 3) - errors) + 0.499) - CASE WHEN rivals > 0 THEN trunc(4.343::DOUBLE * ln(rivals + 1) + 0.499) ELSE 0 END)) AS q FROM b),
d AS (SELECT *, CASE WHEN best > 1 THEN 0 WHEN repetitive > 0 THEN trunc(q * ({_KEEP}) + 0.499) ELSE q END AS pe FROM c),
e AS (SELECT *, least(60, trunc(CASE WHEN m1 > pe THEN m1 ELSE trunc(least(pe, m1 + pe * 0.65::DOUBLE)) END * 1.2::DOUBLE)) AS a1, least(60, trunc(CASE WHEN m2 > pe THEN m2 ELSE trunc(least(pe, m2 + pe * 0.65::DOUBLE)) END * 1.2::DOUBLE)) AS a2 FROM d)
SELECT record_id, CAST(CASE WHEN is_unique = 0 AND least(a1, a2) < 60 THEN 0 ELSE least(a1, a2) END AS INT) AS mapq FROM e""")
def mapq_pair(spark, sf_dir):
    """T7 over arithmetic inputs; is_unique = 0 stands for an aggressive rescue."""
    c = F.col
    rows = _numbers(spark, sf_dir).withColumn("identity", 1 - c("errors") / F.greatest("aligned", "size"))
    pe = mapq.of_pair(c("errors"), c("best"), c("errors") + c("more"), c("rivals"), c("errors"), F.lit(0), c("identity"), c("repetitive"), c("size"))
    return rows.withColumn("pe", pe).select("record_id", mapq.joined(c("m1"), c("m2"), c("pe"), c("is_unique") == 0).alias("mapq"))


#: Records that stand for one read's placements, and how far mates may lie apart.
MADE, APART = 8, 2_000_000
_MADE = f"""made AS (SELECT record_id, record_id // {MADE} AS read_id, rid, rid::BIGINT * 4294967296 + fragment_start_position AS spot, direction = 1 AS plus, record_id % 2 = 0 AS first, coalesce(mapq, 0) % 3 AS errors,
  fragment_start_position AS start, fragment_start_position + 59 AS last, 1 + record_id % 5 AS n FROM {PAIRED} WHERE fragment_start_position IS NOT NULL)"""


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as the placements of made-up reads: MADE records in a row are one read."""
    at = F.col("fragment_start_position")
    return table(spark, sf_dir, PAIRED).filter("fragment_start_position IS NOT NULL").select(
        "record_id", F.floor(F.col("record_id") / MADE).alias("read_id"), "rid", (F.col("rid").cast("long") * F.lit(seeds.WRAP) + at).alias("spot"), (F.col("direction") == 1).alias("plus"), (F.col("record_id") % 2 == 0).alias("first"),
        (F.coalesce("mapq", F.lit(0)) % 3).cast("int").alias("errors"), at.alias("start"), (at + 59).alias("last"), (F.col("record_id") % 5 + 1).cast("int").alias("n"),
    )


@query(f"""WITH {_MADE}, sides AS (SELECT DISTINCT read_id, first, plus, spot FROM made),
kept AS (SELECT a.read_id, a.first, a.plus, a.spot FROM sides a WHERE EXISTS (SELECT 1 FROM sides b WHERE b.read_id = a.read_id AND b.first <> a.first AND b.plus <> a.plus
    AND CASE WHEN a.first THEN b.spot >= a.spot - {APART} AND b.spot < a.spot + {APART} ELSE a.spot >= b.spot - {APART} AND a.spot < b.spot + {APART} END)
  UNION ALL SELECT read_id, first, plus, spot FROM sides WHERE read_id NOT IN (SELECT read_id FROM sides GROUP BY read_id HAVING count(DISTINCT first) = 2))
SELECT read_id, count(*) FILTER (first AND plus) AS n_plus1, count(*) FILTER (first AND NOT plus) AS n_minus1, count(*) FILTER (NOT first AND plus) AS n_plus2, count(*) FILTER (NOT first AND NOT plus) AS n_minus2 FROM kept GROUP BY read_id""")
def mate_filter(spark, sf_dir):
    """Candidates with a partner, of reads made of records; their support is below that of candidates
    kept alone. Reads left without any have no row."""
    side = lambda first, plus: F.transform(F.array_sort(F.collect_set(F.when((F.col("first") == first) & (F.col("plus") == plus), F.col("spot")))), lambda x: F.struct(x.alias("spot"), F.lit(1).alias("n")))
    rows = _made(spark, sf_dir).groupBy("read_id").agg(side(True, True).alias("plus1"), side(True, False).alias("minus1"), side(False, True).alias("plus2"), side(False, False).alias("minus2"))
    numbers = {f"{c}{m}": F.lit(1) for m in (1, 2) for c in ("n_minimizers", "repetitive_length")}
    kept = pipeline._paired_candidates(rows.withColumns({**numbers, "aggressive": F.lit(False)}), PARAMS.but(max_insert_size=APART))
    sizes = kept.select("read_id", *(F.size(f"{s}{m}").cast("long").alias(f"n_{s}{m}") for m in (1, 2) for s in ("plus", "minus")))
    return sizes.filter("n_plus1 + n_minus1 + n_plus2 + n_minus2 > 0")


@query(f"""WITH {_MADE}, settled AS (SELECT read_id, first, plus, rid, last, min(errors) AS errors FROM made GROUP BY ALL),
joined AS (SELECT a.read_id, a.errors + b.errors AS total FROM settled a JOIN settled b ON a.read_id = b.read_id AND a.first AND NOT b.first AND a.rid = b.rid AND a.plus <> b.plus
  AND CASE WHEN a.plus THEN b.last BETWEEN a.last - 60 + 30 AND a.last + {APART} - 60 ELSE b.last BETWEEN a.last - {APART} + 60 AND a.last + 60 - 30 END),
least_of AS (SELECT read_id, min(total) AS low FROM joined GROUP BY read_id),
next_of AS (SELECT j.read_id, min(total) AS second FROM joined j JOIN least_of USING (read_id) WHERE total > low GROUP BY j.read_id)
SELECT j.read_id, low::INT AS sum_errors, (count(*) FILTER (total = low))::INT AS sum_best, coalesce(second, 17)::INT AS sum_second, (count(*) FILTER (total = second))::INT AS sum_rivals
FROM joined j JOIN least_of USING (read_id) LEFT JOIN next_of n ON j.read_id = n.read_id GROUP BY j.read_id, low, second""")
def best_pairs(spark, sf_dir):
    """Least sum of errors over mates that fit one fragment, its count, the next sum and its count, of reads
    made of records."""
    draft = F.struct(F.when(F.col("first"), 1).otherwise(2).alias("mate"), "plus", "rid", "errors", "start", "last")
    rows = _made(spark, sf_dir).groupBy("read_id").agg(F.collect_list(draft).alias("drafts")).withColumns({"length1": F.lit(60), "length2": F.lit(60)})
    return pairing.best_pairs(rows, PARAMS.but(max_insert_size=APART)).select("read_id", "sum_errors", "sum_best", "sum_second", "sum_rivals")


@query(f"""WITH placed_at AS (SELECT record_id, library_id, rid, row_number() OVER (PARTITION BY library_id, rid ORDER BY record_id) - 1 AS place FROM {PAIRED}),
drawn AS (SELECT *, ((rid * 2654435761 + (place + 11) * 40503) % 1000003) AS d FROM placed_at)
SELECT record_id, library_id, rid FROM (SELECT *, row_number() OVER (PARTITION BY library_id, rid ORDER BY d, place) AS n FROM drawn) WHERE n <= 3""")
def topn_sample(spark, sf_dir):
    """Three of the placements of each group, drawn by arithmetic."""
    rows = table(spark, sf_dir, PAIRED).select("record_id", "library_id", "rid")
    return pairing.top_n(rows, ["library_id", "rid"], "rid", ["record_id"], 3)
