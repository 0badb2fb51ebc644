"""Queries over mapping records: duplicates, shifts, filters, barcodes, intervals, summaries, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.cells import normal_barcode
from strandloom.operators import barcodes, dedup, lines, overlap, summary
from strandloom.storage import table

PAIRED = "paired_end_mapping_with_barcode"
POSITION = ["library_id", "rid", "fragment_start_position", "fragment_length"]
CELL = ["library_id", "rid", "cell_barcode", "fragment_start_position", "fragment_length"]
KMV, SLOT_SPACE = 250, 4_000_003

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed paired records with spelt-out barcodes."""
    columns = [*POSITION, "cell_barcode", "read_id", "mapq", "direction", "is_unique", "positive_alignment_length", "negative_alignment_length"]
    return dedup.placed(table(spark, sf_dir, PAIRED).select(*columns)).withColumn("cell_barcode", normal_barcode(F.col("cell_barcode")))


def singles(spark: SparkSession, sf_dir: str, name: str, sample: str, *more: str) -> DataFrame:
    columns = [sample, "rid", "fragment_start_position", "fragment_length", "read_id", "mapq", "direction", "is_unique", *more]
    return dedup.placed(table(spark, sf_dir, name).select(*columns))


FRAGMENTS = f"""fragments AS (
  SELECT library_id, rid, fragment_start_position, fragment_length, trim(split_part(upper(cell_barcode), '-', 1)) AS cell_barcode, read_id, mapq, direction, is_unique,
         positive_alignment_length, negative_alignment_length
  FROM {PAIRED} WHERE rid IS NOT NULL AND fragment_start_position IS NOT NULL AND fragment_length IS NOT NULL)"""
_PAIRED_ORDER = "coalesce(mapq, -1) {d}, direction {e}, is_unique {e}, read_id {e}, positive_alignment_length {e}, negative_alignment_length {e}"


def _ranked(key: str, mode: str = "low_mem", source: str = "fragments") -> str:
    order = _PAIRED_ORDER.format(d="DESC", e="" if mode == "low_mem" else "DESC")
    return f"""SELECT * EXCLUDE (n), least(n_copies, 255)::INT AS num_dups FROM (
      SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n, count(*) OVER (PARTITION BY {key}) AS n_copies FROM {source}) WHERE n = 1"""


_CELL, _POSITION = ", ".join(CELL), ", ".join(POSITION)
_DEDUPED = f"deduped AS ({_ranked(_CELL)})"
_SHIFTED = """shifted AS (SELECT * REPLACE (fragment_start_position + 4 AS fragment_start_position, fragment_length - 9 AS fragment_length,
  positive_alignment_length - 4 AS positive_alignment_length, negative_alignment_length - 5 AS negative_alignment_length) FROM deduped WHERE mapq >= 30)"""


def cell_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-cell route: deduplicated per cell, filtered, shifted."""
    kept = dedup.at_least_mapq(dedup.mark_duplicates(fragments(spark, sf_dir), CELL, dedup.PAIRED_TIES))
    return dedup.tn5_shift_paired(kept)


@query(f"WITH {FRAGMENTS} {_ranked(_CELL)}")
def dedup_cell_lowmem(spark, sf_dir):
    """One record per cell and fragment, the first with the highest mapq."""
    return dedup.mark_duplicates(fragments(spark, sf_dir), CELL, dedup.PAIRED_TIES)


@query(f"WITH {FRAGMENTS} {_ranked(_CELL, 'in_memory')}")
def dedup_inmem(spark, sf_dir):
    """D3: one record per cell and fragment, the last in sort order."""
    return dedup.mark_duplicates(fragments(spark, sf_dir), CELL, dedup.PAIRED_TIES, "in_memory")


@query(f"WITH {FRAGMENTS}, bulk AS (SELECT * EXCLUDE (cell_barcode) FROM fragments) {_ranked(_POSITION, source='bulk')}")
def dedup_bulk_pe(spark, sf_dir):
    """D4 on paired records without barcode."""
    return dedup.mark_duplicates(fragments(spark, sf_dir).drop("cell_barcode"), POSITION, dedup.PAIRED_TIES)


_ABUNDANCE = f"""abundance AS (SELECT seen AS barcode, count(*) AS abundance FROM (
  SELECT trim(split_part(upper(cell_barcode), '-', 1)) AS seen FROM {PAIRED}) WHERE seen IN (SELECT barcode FROM whitelist) GROUP BY seen)"""


def _abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, PAIRED).select(normal_barcode(F.col("cell_barcode")).alias("barcode"))
    return barcodes.abundance(seen, table(spark, sf_dir, "whitelist"))


@query(f"""WITH {FRAGMENTS}, {_ABUNDANCE}, cells AS ({_ranked(_CELL)}),
ranked AS (
  SELECT c.* EXCLUDE (num_dups, n_copies), sum(n_copies) OVER (PARTITION BY {_POSITION})::BIGINT AS n_copies,
    row_number() OVER (PARTITION BY {_POSITION} ORDER BY c.n_copies DESC, coalesce(a.abundance, 0) DESC, c.cell_barcode NULLS FIRST) AS n
  FROM cells c LEFT JOIN abundance a ON c.cell_barcode = a.barcode)
SELECT * EXCLUDE (n), least(n_copies, 255)::INT AS num_dups FROM ranked WHERE n = 1""")
def dedup_bulk_level_sc(spark, sf_dir):
    """One record per position of single-cell data; the barcode with most copies wins."""
    return dedup.mark_bulk_duplicates(fragments(spark, sf_dir), POSITION, "cell_barcode", dedup.PAIRED_TIES, _abundance(spark, sf_dir))


def _single_sql(name: str, columns: str, key: str) -> str:
    return f"""SELECT * EXCLUDE (n), least(n_copies, 255)::INT AS num_dups FROM (
      SELECT {columns}, rid, fragment_start_position, fragment_length, read_id, mapq, direction, is_unique,
        row_number() OVER (PARTITION BY {key} ORDER BY coalesce(mapq, -1) DESC, fragment_length, direction, is_unique, read_id) AS n, count(*) OVER (PARTITION BY {key}) AS n_copies
      FROM {name} WHERE rid IS NOT NULL AND fragment_start_position IS NOT NULL AND fragment_length IS NOT NULL) WHERE n = 1"""


@query(_single_sql("(SELECT * REPLACE (trim(upper(sample_id)) AS sample_id) FROM mapping_without_barcode)", "sample_id", "sample_id, rid, fragment_start_position"))
def dedup_se(spark, sf_dir):
    """D4 on single-end records: by start alone, whichever strand."""
    rows = singles(spark, sf_dir, "mapping_without_barcode", "sample_id").withColumn("sample_id", F.trim(F.upper("sample_id")))
    return dedup.mark_duplicates(rows, ["sample_id", "rid", "fragment_start_position"], dedup.SINGLE_TIES)


@query(_single_sql("mapping_with_barcode", "library_id, cell_barcode", "library_id, rid, cell_barcode, fragment_start_position"))
def dedup_se_barcode(spark, sf_dir):
    """D3/D4 on single-end records with barcode, as groups rather than neighbours in sort order."""
    return dedup.mark_duplicates(singles(spark, sf_dir, "mapping_with_barcode", "library_id", "cell_barcode"), ["library_id", "rid", "cell_barcode", "fragment_start_position"], dedup.SINGLE_TIES)


@query(f"WITH {FRAGMENTS} SELECT is_unique, count(*) AS n_mappings FROM fragments GROUP BY is_unique")
def unique_multi_stats(spark, sf_dir):
    """Uniquely and multiply mapped fragments."""
    return dedup.mapping_counts(fragments(spark, sf_dir))


@query(f"WITH {FRAGMENTS} SELECT * FROM fragments ORDER BY rid, fragment_start_position, fragment_length, cell_barcode, mapq, direction, is_unique, read_id")
def sort_rid(spark, sf_dir):
    """Fragments in output order."""
    return dedup.in_order(fragments(spark, sf_dir), ["fragment_length", "cell_barcode", *dedup.PAIRED_TIES])


@query(f"WITH {FRAGMENTS} SELECT * FROM fragments WHERE mapq >= 30")
def mapq_filter(spark, sf_dir):
    """P16."""
    return dedup.at_least_mapq(fragments(spark, sf_dir))


@query(f"WITH {FRAGMENTS}, deduped AS (SELECT * FROM fragments), {_SHIFTED.replace(' WHERE mapq >= 30', '')} SELECT * FROM shifted")
def tn5_shift(spark, sf_dir):
    """P17 on fragments."""
    return dedup.tn5_shift_paired(fragments(spark, sf_dir))


@query("""SELECT sample_id, rid, fragment_start_position + CASE WHEN direction = 1 THEN 4 ELSE 0 END AS fragment_start_position,
  fragment_length - CASE WHEN direction = 1 THEN 0 ELSE 5 END AS fragment_length, read_id, mapq, direction, is_unique
  FROM mapping_without_barcode WHERE rid IS NOT NULL AND fragment_start_position IS NOT NULL AND fragment_length IS NOT NULL""")
def tn5_shift_se(spark, sf_dir):
    """P17 on single reads."""
    return dedup.tn5_shift_single(singles(spark, sf_dir, "mapping_without_barcode", "sample_id"))


_NAMED = "named AS (SELECT s.*, r.ref_name FROM shifted s JOIN ref_seqs r ON s.rid = r.rid)"
_CHAIN = f"WITH {FRAGMENTS}, {_DEDUPED}, {_SHIFTED}, {_NAMED}"


def _named(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    return df.join(table(spark, sf_dir, "ref_seqs").select("rid", "ref_name"), "rid")


@query(f"{_CHAIN} SELECT concat_ws(chr(9), ref_name, fragment_start_position, fragment_start_position + fragment_length, coalesce(cell_barcode, ''), num_dups) AS line FROM named")
def fragments_bed(spark, sf_dir):
    """Lines of a single-cell fragment file."""
    return _named(spark, sf_dir, cell_fragments(spark, sf_dir)).select(lines.fragment_line())


@query(f"""{_CHAIN} SELECT concat_ws(chr(9), ref_name, fragment_start_position, fragment_start_position + fragment_length, 'N', mapq,
  CASE WHEN direction = 1 THEN '+' ELSE '-' END, num_dups) AS line FROM named""")
def bed_bulk_rows(spark, sf_dir):
    """Lines of a bulk BED file."""
    return _named(spark, sf_dir, cell_fragments(spark, sf_dir)).select(lines.bed_line())


@query(f"""{_CHAIN},
mates AS (
  SELECT ref_name, fragment_start_position AS a, fragment_start_position + positive_alignment_length AS b, mapq, '+' AS strand, read_id, direction = 1 AS leads, num_dups FROM named
  UNION ALL SELECT ref_name, fragment_start_position + fragment_length - negative_alignment_length, fragment_start_position + fragment_length, mapq, '-', read_id, direction <> 1, num_dups FROM named)
SELECT concat_ws(chr(9), ref_name, a, b, 'N', mapq, strand) || CASE WHEN leads THEN '' ELSE chr(9) || num_dups END AS line FROM mates""")
def tagalign_rows(spark, sf_dir):
    """Two lines per pair, read 1 first, the copies on the second."""
    return lines.with_tagalign_pair_line(_named(spark, sf_dir, cell_fragments(spark, sf_dir))).select("line")


_SE_NAMED = "named AS (SELECT m.*, r.ref_name FROM deduped m JOIN ref_seqs r ON m.rid = r.rid WHERE mapq >= 30)"
_SE_DEDUPED = f"deduped AS ({SQL['dedup_se']})"


@query(f"""WITH {_SE_DEDUPED}, {_SE_NAMED} SELECT concat_ws(chr(9), ref_name, fragment_start_position, fragment_start_position + fragment_length, 'N', mapq,
  CASE WHEN direction = 1 THEN '+' ELSE '-' END, num_dups) AS line FROM named""")
def tagalign_se_rows(spark, sf_dir):
    """Lines of single reads without barcode."""
    return _named(spark, sf_dir, dedup.at_least_mapq(dedup_se(spark, sf_dir))).select(lines.tagalign_line(barcoded=False))


@query(f"""WITH {_SE_DEDUPED}, {_SE_NAMED} SELECT concat_ws(chr(9), 'r' || read_id, fragment_length, 0, fragment_length, CASE WHEN direction = 1 THEN '+' ELSE '-' END, ref_name, l,
  fragment_start_position, fragment_start_position + fragment_length, fragment_length, fragment_length, mapq) AS line FROM (SELECT n.*, r.length AS l FROM named n JOIN ref_seqs r ON n.rid = r.rid)""")
def paf_rows(spark, sf_dir):
    """PAF lines of single reads."""
    rows = dedup.at_least_mapq(dedup_se(spark, sf_dir)).join(table(spark, sf_dir, "ref_seqs").select("rid", "ref_name", F.col("length").alias("ref_length")), "rid")
    return rows.withColumns({"read_name": F.concat(F.lit("r"), "read_id"), "read_length": F.col("fragment_length")}).select(lines.paf_line())


@query(f"""{_CHAIN}, sized AS (SELECT n.*, r.length AS l FROM named n JOIN ref_seqs r ON n.rid = r.rid),
mates AS (
  SELECT *, fragment_start_position AS a, fragment_start_position + positive_alignment_length AS b, positive_alignment_length AS n, '+' AS strand, CASE WHEN direction = 1 THEN 1 ELSE 2 END AS mate FROM sized
  UNION ALL SELECT *, fragment_start_position + fragment_length - negative_alignment_length, fragment_start_position + fragment_length, negative_alignment_length, '-', CASE WHEN direction = 1 THEN 2 ELSE 1 END FROM sized)
SELECT concat_ws(chr(9), 'r' || read_id || '/' || mate, n, 0, n, strand, ref_name, l, a, b, n, b - a, mapq) AS line FROM mates""")
def paf_pair_rows(spark, sf_dir):
    """PAF lines of pairs, two a pair."""
    rows = cell_fragments(spark, sf_dir).join(table(spark, sf_dir, "ref_seqs").select("rid", "ref_name", F.col("length").alias("ref_length")), "rid")
    return lines.with_paf_pair_line(rows.withColumn("read_name", F.concat(F.lit("r"), "read_id"))).select("line")


@query("SELECT seen AS barcode, count(*) AS abundance FROM (SELECT trim(split_part(upper(cell_barcode), '-', 1)) AS seen FROM paired_end_mapping_with_barcode) WHERE seen IN (SELECT barcode FROM whitelist) GROUP BY seen")
def barcode_abundance(spark, sf_dir):
    """B1."""
    return _abundance(spark, sf_dir)


@query("""SELECT count(*) AS n_observed, count(*) FILTER (seen IN (SELECT barcode FROM whitelist)) AS n_listed,
  count(*) FILTER (seen IN (SELECT barcode FROM whitelist)) * 20 >= count(*) AS passed
  FROM (SELECT trim(split_part(upper(cell_barcode), '-', 1)) AS seen FROM paired_end_mapping_with_barcode WHERE cell_barcode IS NOT NULL)""")
def whitelist_check(spark, sf_dir):
    """B2."""
    seen = table(spark, sf_dir, PAIRED).select(normal_barcode(F.col("cell_barcode")).alias("barcode"))
    return barcodes.check_whitelist(seen, table(spark, sf_dir, "whitelist"))


BARCODE_LENGTH = 16


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes with a quality made by arithmetic on the record and position."""
    quality = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BARCODE_LENGTH - 1)), lambda p: F.char((F.lit(33) + (F.col("record_id") * 7 + p * 13) % 41).cast("int"))), "")
    return table(spark, sf_dir, PAIRED).select("record_id", normal_barcode(F.col("cell_barcode")).alias("barcode"), quality.alias("quality"))


def _corrected(spark: SparkSession, sf_dir: str, errors: int) -> DataFrame:
    whitelist = table(spark, sf_dir, "whitelist")
    return barcodes.correct(_observed(spark, sf_dir), whitelist, _abundance(spark, sf_dir), BARCODE_LENGTH, errors)


def _correct_sql(errors: int) -> str:
    q = " + ".join(f"CASE WHEN substr(o.barcode, {p + 1}, 1) <> substr(w.barcode, {p + 1}, 1) THEN greatest(3, least(40, (o.record_id * 7 + {p * 13}) % 41)) ELSE 0 END" for p in range(BARCODE_LENGTH))
    return f"""WITH {_ABUNDANCE},
observed AS (SELECT record_id, trim(split_part(upper(cell_barcode), '-', 1)) AS barcode FROM {PAIRED}),
odd AS (SELECT * FROM observed WHERE barcode NOT IN (SELECT barcode FROM whitelist) AND length(barcode) = {BARCODE_LENGTH} AND length(barcode) - length(replace(barcode, 'N', '')) < {errors}),
weighed AS (
  SELECT o.record_id, w.barcode, pow(10.0, -({q}) / 10.0) * coalesce(a.abundance, 0) AS weight
  FROM odd o JOIN whitelist w ON hamming(o.barcode, w.barcode) <= {errors} LEFT JOIN abundance a ON w.barcode = a.barcode),
best AS (
  SELECT record_id, barcode FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY weight DESC, barcode) AS n, sum(weight) OVER (PARTITION BY record_id) AS s, count(*) OVER (PARTITION BY record_id) AS k FROM weighed)
  WHERE n = 1 AND (k = 1 OR weight > 0.9 * s))
SELECT o.record_id, CASE WHEN o.barcode IN (SELECT barcode FROM whitelist) THEN o.barcode ELSE b.barcode END AS corrected,
  CASE WHEN o.barcode IN (SELECT barcode FROM whitelist) THEN 'listed' WHEN b.barcode IS NOT NULL THEN 'corrected' ELSE 'rejected' END AS outcome
FROM observed o LEFT JOIN best b ON o.record_id = b.record_id"""


@query(_correct_sql(1))
def barcode_correct_1(spark, sf_dir):
    """B4 with one substitution."""
    return _corrected(spark, sf_dir, 1).select("record_id", "corrected", "outcome")


@query(_correct_sql(2))
def barcode_correct_2(spark, sf_dir):
    """B4 with up to two substitutions."""
    return _corrected(spark, sf_dir, 2).select("record_id", "corrected", "outcome")


@query(f"SELECT outcome, count(*) AS n_barcodes FROM ({_correct_sql(1)}) GROUP BY outcome")
def barcode_stats(spark, sf_dir):
    """B5."""
    return barcodes.outcome_counts(_corrected(spark, sf_dir, 1))


@query("""WITH whole AS (SELECT barcode, substr(barcode, 1, 8) AS a, substr(barcode, 9, 8) AS b FROM whitelist)
SELECT barcode, translate(reverse(a), 'ACGT', 'TGCA') || '-' || translate(reverse(b), 'ACGT', 'TGCA') AS translated FROM whole""")
def barcode_translate(spark, sf_dir):
    """Both halves of every whitelist barcode through a translation table."""
    whitelist = table(spark, sf_dir, "whitelist")
    half = whitelist.select(F.explode(F.array(F.substring("barcode", 1, 8), F.substring("barcode", 9, 8))).alias("from")).distinct()
    to = half.select("from", F.translate(F.reverse("from"), "ACGT", "TGCA").alias("to"))
    mapping = to.agg(F.map_from_entries(F.collect_list(F.struct("from", "to"))).alias("mapping"))  # a translation table is part of the chemistry and fits a map
    return whitelist.crossJoin(F.broadcast(mapping)).select("barcode", barcodes.translate(F.col("barcode"), F.col("mapping"), 8).alias("translated"))


@query("""SELECT cell_barcode, row_number() OVER (ORDER BY first, cell_barcode) - 1 AS cell_id FROM (
  SELECT cell_barcode, min(record_id) AS first FROM paired_end_mapping_with_barcode WHERE cell_barcode IS NOT NULL GROUP BY cell_barcode)""")
def barcode_index(spark, sf_dir):
    """Numbers of barcodes in the order first seen."""
    return barcodes.dense_ids(table(spark, sf_dir, PAIRED), "cell_barcode", "record_id")


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "peak").select("peak_index", F.trim(F.upper("sample_id")).alias("sample_id"), "rid", F.col("start_position").alias("c"), (F.col("start_position") + F.col("length")).alias("d"))


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = singles(spark, sf_dir, "mapping_without_barcode", "sample_id")
    return rows.select("read_id", F.trim(F.upper("sample_id")).alias("sample_id"), "rid", "mapq", F.col("fragment_start_position").alias("a"), (F.col("fragment_start_position") + F.col("fragment_length")).alias("b"))


_BULK = """bulk AS (SELECT read_id, trim(upper(sample_id)) AS sample_id, rid, mapq, fragment_start_position AS a, fragment_start_position + fragment_length AS b
  FROM mapping_without_barcode WHERE fragment_start_position IS NOT NULL AND fragment_length IS NOT NULL),
peaks AS (SELECT peak_index, trim(upper(sample_id)) AS sample_id, rid, start_position AS c, start_position + length AS d FROM peak WHERE length > 0)"""


@query(f"""WITH {_BULK} SELECT p.peak_index, p.sample_id, p.rid, (SELECT count(*) FROM bulk b WHERE b.sample_id = p.sample_id AND b.rid = p.rid AND b.a < p.d AND p.c < b.b AND b.a < b.b) AS n_overlaps
FROM peaks p""")
def overlap_count(spark, sf_dir):
    """A6, first half: mappings that overlap each peak."""
    peaks = _peaks(spark, sf_dir).filter("c < d").withColumnsRenamed({"c": "a", "d": "b"})
    reads = _bulk(spark, sf_dir).select("sample_id", "rid", F.col("a").alias("c"), F.col("b").alias("d"))
    return overlap.count_overlaps(peaks, reads, ["sample_id", "rid"], "peak_index").select("peak_index", "sample_id", "rid", "n_overlaps")


@query(f"""WITH {_BULK} SELECT b.read_id, b.sample_id, b.rid, b.a, p.peak_index FROM bulk b JOIN peaks p ON b.sample_id = p.sample_id AND b.rid = p.rid AND b.a < p.d AND p.c < b.b AND b.a < b.b""")
def peak_overlap(spark, sf_dir):
    """M3: pairs of mappings and peaks that overlap."""
    return overlap.overlap_join(_bulk(spark, sf_dir).drop("mapq"), _peaks(spark, sf_dir), ["sample_id", "rid"]).select("read_id", "sample_id", "rid", "a", "peak_index")


@query(f"""WITH {FRAGMENTS},
numbered AS (SELECT library_id, rid, read_id // 4 AS read_key, read_id AS placement, min(fragment_start_position) AS a, min(fragment_start_position + fragment_length) AS b
  FROM fragments WHERE coalesce(mapq, 0) < 4 GROUP BY ALL),
uniques AS (SELECT library_id, rid, fragment_start_position AS c, fragment_start_position + fragment_length AS d FROM fragments WHERE mapq >= 4 AND fragment_length > 0),
placed_once AS (SELECT placement, min(library_id) AS library_id, min(rid) AS rid, min(read_key) AS read_key, min(a) AS a, min(b) AS b FROM numbered GROUP BY placement),
weighed AS (SELECT p.*, (SELECT count(*) FROM uniques u WHERE u.library_id = p.library_id AND u.rid = p.rid AND u.c < p.b + 2000 AND p.a - 2000 < u.d) AS weight FROM placed_once p),
summed AS (SELECT *, sum(weight) OVER (PARTITION BY read_key ORDER BY placement) AS upto, sum(weight) OVER (PARTITION BY read_key) AS total, (read_key * 2654435761 + 11 * 40503) % 1000003 AS drawn FROM weighed)
SELECT read_key, placement, library_id, rid, a, b, weight FROM summed WHERE weight > 0 AND upto * 1000003 > drawn * total AND (upto - weight) * 1000003 <= drawn * total""")
def allocate_multi(spark, sf_dir):
    """One placement per multi-mapped read, drawn by the unique mappings around it."""
    f = fragments(spark, sf_dir).withColumns({"a": F.col("fragment_start_position"), "b": F.col("fragment_start_position") + F.col("fragment_length")})
    few = f.filter(F.coalesce("mapq", F.lit(0)) < 4).groupBy(F.col("read_id").alias("placement"))
    # a read's neighbours in number stand for its other placements
    placements = few.agg(*(F.min(c).alias(c) for c in ("library_id", "rid", "a", "b"))).withColumn("read_key", F.floor(F.col("placement") / 4))
    uniques = f.filter("mapq >= 4").select("library_id", "rid", F.col("a").alias("c"), F.col("b").alias("d"))
    return overlap.allocate(placements, uniques, ["library_id", "rid"], "read_key", "placement", distance=2000).select("read_key", "placement", "library_id", "rid", "a", "b", "weight")


_DEPTHS = f"""WITH {_BULK},
steps AS (SELECT sample_id, rid, p, sum(d) AS d FROM (SELECT sample_id, rid, a AS p, 1 AS d FROM bulk WHERE a < b UNION ALL SELECT sample_id, rid, b, -1 FROM bulk WHERE a < b) GROUP BY ALL HAVING sum(d) <> 0),
depths AS (SELECT sample_id, rid, p AS seg_start, lead(p) OVER w AS seg_end, CAST(sum(d) OVER w AS BIGINT) AS depth FROM steps WINDOW w AS (PARTITION BY sample_id, rid ORDER BY p))"""


@query(f"{_DEPTHS} SELECT * FROM depths WHERE depth > 0")
def pileup(spark, sf_dir):
    """M1: coverage depth as segments."""
    return overlap.pileup(_bulk(spark, sf_dir), ["sample_id", "rid"])


@query(f"""{_DEPTHS}, high AS (SELECT *, CASE WHEN lag(seg_end) OVER (PARTITION BY sample_id, rid ORDER BY seg_start) = seg_start THEN 0 ELSE 1 END AS new FROM depths WHERE depth >= 3),
islands AS (SELECT *, sum(new) OVER (PARTITION BY sample_id, rid ORDER BY seg_start) AS island FROM high)
SELECT sample_id, rid, min(seg_start) AS peak_start, max(seg_end) AS peak_end, max(depth) AS max_depth FROM islands GROUP BY sample_id, rid, island""")
def call_peaks(spark, sf_dir):
    """M2: stretches of at least the cutoff depth."""
    return overlap.call_peaks(overlap.pileup(_bulk(spark, sf_dir), ["sample_id", "rid"]), ["sample_id", "rid"])


_CELL_BINS = f"""WITH {FRAGMENTS}, binned AS (SELECT cell_barcode, rid, unnest(generate_series(fragment_start_position // 5000, (fragment_start_position + fragment_length - 1) // 5000)) AS bin
  FROM fragments WHERE fragment_length > 0)"""


@query(f"{_CELL_BINS} SELECT rid, bin, count(*) AS n_fragments FROM binned GROUP BY rid, bin")
def bin_overlap(spark, sf_dir):
    """M4: fragments per fixed-width bin."""
    f = fragments(spark, sf_dir).select("rid", F.col("fragment_start_position").alias("a"), (F.col("fragment_start_position") + F.col("fragment_length")).alias("b"))
    return overlap.bins_of(f).groupBy("rid", "bin").agg(F.count("*").alias("n_fragments"))


@query(f"{_CELL_BINS} SELECT cell_barcode, rid, bin, count(*) AS n FROM binned WHERE cell_barcode IS NOT NULL GROUP BY ALL")
def cell_by_bin(spark, sf_dir):
    """M5: sparse cell by bin counts."""
    f = fragments(spark, sf_dir).select("cell_barcode", "rid", F.col("fragment_start_position").alias("a"), (F.col("fragment_start_position") + F.col("fragment_length")).alias("b"))
    return overlap.count_matrix(overlap.bins_of(f), "cell_barcode", ["rid", "bin"])


@query(f"""WITH {FRAGMENTS}, {_BULK.replace("bulk AS", "unused AS")}
SELECT cell_barcode, peak_index, count(*) AS n FROM fragments f JOIN peaks p ON f.rid = p.rid AND f.fragment_start_position < p.d AND p.c < f.fragment_start_position + f.fragment_length
WHERE cell_barcode IS NOT NULL AND fragment_length > 0 GROUP BY ALL""")
def cell_by_peak(spark, sf_dir):
    """M5: sparse cell by peak counts."""
    f = fragments(spark, sf_dir).select("cell_barcode", "rid", F.col("fragment_start_position").alias("a"), (F.col("fragment_start_position") + F.col("fragment_length")).alias("b"))
    return overlap.count_matrix(overlap.overlap_join(f, _peaks(spark, sf_dir).drop("sample_id"), ["rid"]), "cell_barcode", ["peak_index"])


@query("""SELECT rid, ref_name, bin, bin * 5000 AS bin_start, least((bin + 1) * 5000, length) AS bin_end
  FROM (SELECT rid, ref_name, length::BIGINT AS length, unnest(generate_series(0, (length - 1) // 5000)) AS bin FROM ref_seqs WHERE length > 0)""")
def bin_table(spark, sf_dir):
    """M6."""
    return overlap.bin_table(table(spark, sf_dir, "ref_seqs"))


SLOT_PRIME = 1_000_003
_FLAGS = f"""seen AS (
  SELECT trim(split_part(upper(cell_barcode), '-', 1)) AS barcode, record_id, rid, mapq, fragment_start_position AS start, fragment_length AS length,
    fragment_start_position IS NOT NULL AND fragment_length IS NOT NULL AS mapped,
    (rid * {SLOT_PRIME} + fragment_start_position // 1000) % {SLOT_SPACE} AS slot, fragment_start_position // 200 AS fingerprint, library_id, cell_barcode
  FROM {PAIRED}),
slots AS (
  SELECT slot, fingerprint FROM (
    SELECT slot, fingerprint, n, sum(n) OVER (PARTITION BY slot) AS total, row_number() OVER (PARTITION BY slot ORDER BY n DESC, fingerprint) AS r
    FROM (SELECT slot, fingerprint, count(*) AS n FROM seen WHERE slot IS NOT NULL GROUP BY ALL)) WHERE r = 1 AND total >= 10 AND n >= 0.2 * total),
flagged AS (
  SELECT CASE WHEN s.barcode IN (SELECT barcode FROM whitelist) THEN s.barcode END AS barcode, s.mapped, c.slot IS NOT NULL AND s.mapped AS cachehit, s.slot,
    s.mapped AND row_number() OVER (PARTITION BY s.library_id, s.rid, s.barcode, s.start, s.length ORDER BY s.record_id) > 1 AS duplicate,
    s.mapped AND coalesce(s.mapq, 0) < 30 AS lowmapq
  FROM seen s LEFT JOIN slots c ON s.slot = c.slot AND s.fingerprint = c.fingerprint)"""
_SUMMARY = f"""summary AS (
  SELECT coalesce(barcode, 'non-whitelist') AS barcode, count(*) AS total, CASE WHEN barcode IS NULL THEN 0 ELSE count(*) FILTER (mapped) END AS mapped,
    CASE WHEN barcode IS NULL THEN 0 ELSE count(*) FILTER (duplicate) END AS duplicate, CASE WHEN barcode IS NULL THEN 0 ELSE count(*) FILTER (lowmapq) END AS lowmapq,
    CASE WHEN barcode IS NULL THEN 0 ELSE count(*) FILTER (cachehit) END AS cachehit
  FROM flagged GROUP BY flagged.barcode)"""


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("fragment_start_position")
    return table(spark, sf_dir, PAIRED).withColumns({
        "barcode": normal_barcode(F.col("cell_barcode")),
        "slot": (F.col("rid") * SLOT_PRIME + F.floor(start / 1000)) % SLOT_SPACE,
        "fingerprint": F.floor(start / 200),
        "mapped": start.isNotNull() & F.col("fragment_length").isNotNull(),
    })


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signatures(spark, sf_dir)
    key = ["library_id", "rid", "barcode", "fragment_start_position", "fragment_length"]
    first = rows.filter("mapped").groupBy(*key).agg(F.min("record_id").alias("record_id")).select("record_id", F.lit(True).alias("leads"))
    listed = table(spark, sf_dir, "whitelist").select("barcode", F.lit(True).alias("listed")).distinct()
    hits = summary.with_cache_hits(rows, summary.cache_slots(rows))
    joined = hits.join(first, "record_id", "left").join(listed, "barcode", "left")
    return joined.select(
        F.when(F.col("listed"), F.col("barcode")).alias("barcode"), "slot", "mapped", (F.col("mapped") & F.col("leads").isNull()).alias("duplicate"),
        (F.col("mapped") & (F.coalesce("mapq", F.lit(0)) < 30)).alias("lowmapq"), (F.col("mapped") & F.col("cachehit")).alias("cachehit"),
    )


@query(f"WITH {_FLAGS}, {_SUMMARY} SELECT * FROM summary")
def summary_barcode(spark, sf_dir):
    """A1 and A3: counters per barcode and the row of those not on the whitelist."""
    return summary.summarise(_flagged(spark, sf_dir), "barcode")


_FRIP = """SELECT barcode, total, duplicate, total - mapped AS unmapped, lowmapq, cachehit, fric,
  CASE WHEN fric = 0 THEN 0.0 ELSE 1 / (1 + exp(-(-1.0996 + 4.2391 * fric + 3.0164e-05 * duplicate - 2.1087e-04 * (total - mapped) - 5.5825e-05 * lowmapq))) END::DOUBLE AS estfrip
  FROM (SELECT *, CASE WHEN mapped > 0 THEN cachehit / mapped ELSE 0.0 END::DOUBLE AS fric FROM summary)"""


@query(f"WITH {_FLAGS}, {_SUMMARY} SELECT * REPLACE (round(fric, 9) AS fric, round(estfrip, 9) AS estfrip) FROM ({_FRIP})")
def estfrip(spark, sf_dir):
    """A2: derived quality metrics."""
    found = summary.derived(summary.summarise(_flagged(spark, sf_dir), "barcode"))
    return found.withColumns({"fric": F.round("fric", 9), "estfrip": F.round("estfrip", 9)})


@query(f"WITH {_FLAGS}, bulk AS (SELECT * REPLACE ('' AS barcode) FROM flagged), {_SUMMARY.replace('FROM flagged GROUP BY flagged.barcode', 'FROM bulk GROUP BY bulk.barcode')} SELECT * FROM summary")
def summary_bulk(spark, sf_dir):
    """A1 without barcodes: one row with an empty label."""
    return summary.summarise(_flagged(spark, sf_dir).withColumn("barcode", F.lit("")), "barcode")


@query(f"WITH {_FLAGS}, {_SUMMARY} SELECT barcode, total, mapped // 2 AS mapped, duplicate // 2 AS duplicate, lowmapq // 2 AS lowmapq, cachehit FROM summary")
def sam_halving(spark, sf_dir):
    """A4."""
    return summary.halved(summary.summarise(_flagged(spark, sf_dir), "barcode"))


@query(f"""WITH {_FLAGS}, ranked AS (SELECT library_id, slot, row_number() OVER (PARTITION BY library_id ORDER BY slot) AS r FROM (SELECT DISTINCT library_id, slot FROM seen WHERE slot IS NOT NULL)),
kept AS (SELECT library_id, count(*) AS n_kept, max(slot) AS kth FROM ranked WHERE r <= {KMV} GROUP BY library_id)
SELECT library_id, n_kept, CAST(CASE WHEN n_kept = {KMV} AND kth > 0 THEN floor({KMV} * {SLOT_SPACE}::DOUBLE / kth) - 1 ELSE 0 END AS BIGINT) AS cardinality FROM kept""")
def kmv_cardinality(spark, sf_dir):
    """A5: distinct slots from the k smallest."""
    return summary.smallest_values(_signatures(spark, sf_dir), ["library_id"], "slot", KMV, SLOT_SPACE)


@query(f"""WITH {_FLAGS} SELECT slot, fingerprint, n, total FROM (
    SELECT slot, fingerprint, n, CAST(sum(n) OVER (PARTITION BY slot) AS BIGINT) AS total, row_number() OVER (PARTITION BY slot ORDER BY n DESC, fingerprint) AS r
    FROM (SELECT slot, fingerprint, count(*) AS n FROM seen WHERE slot IS NOT NULL GROUP BY ALL)) WHERE r = 1 AND total >= 10 AND n >= 0.2 * total""")
def cache_eligible(spark, sf_dir):
    """Slots of the seed cache that would be filled."""
    return summary.cache_slots(_signatures(spark, sf_dir))


@query("""SELECT count(*) AS n_records, count(*) FILTER (fragment_start_position IS NOT NULL AND fragment_length IS NOT NULL) AS n_mapped,
  count(*) FILTER (is_unique = 1) AS n_unique, count(*) FILTER (is_unique = 0) AS n_multi, count(DISTINCT read_id) AS n_reads FROM paired_end_mapping_with_barcode""")
def mapping_counters(spark, sf_dir):
    """Counters of a run."""
    mapped = F.col("fragment_start_position").isNotNull() & F.col("fragment_length").isNotNull()
    return table(spark, sf_dir, PAIRED).agg(
        F.count("*").alias("n_records"), F.count_if(mapped).alias("n_mapped"), F.count_if(F.col("is_unique") == 1).alias("n_unique"),
        F.count_if(F.col("is_unique") == 0).alias("n_multi"), F.count_distinct("read_id").alias("n_reads"),
    )


_ORDERED = "ranks AS (SELECT rid, ref_name, row_number() OVER (ORDER BY length, rid) - 1 AS new_rid FROM ref_seqs)"


@query(f"WITH {FRAGMENTS}, {_ORDERED} SELECT r.new_rid, r.ref_name, count(*) AS n_fragments FROM fragments f JOIN ranks r ON f.rid = r.rid GROUP BY ALL")
def chrom_order(spark, sf_dir):
    """Fragments per sequence under a custom order (shortest first)."""
    refs = table(spark, sf_dir, "ref_seqs")
    order = [r["ref_name"] for r in refs.orderBy("length", "rid").select("ref_name").collect()]  # the order list is a small file in practice
    ranks = lines.reference_ranks(refs, order)
    return fragments(spark, sf_dir).join(ranks.select("rid", "ref_name", "new_rid"), "rid").groupBy("new_rid", "ref_name").agg(F.count("*").alias("n_fragments"))


@query(f"""WITH {FRAGMENTS}, ends AS (
  SELECT read_id, rid AS rid1, (rid * 7 + read_id) % 24 AS rid2, fragment_start_position AS pos1, fragment_start_position + fragment_length - 1 AS pos2, direction = 1 AS plus1, is_unique = 1 AS plus2, mapq FROM fragments),
swapped AS (SELECT *, rid1 > rid2 OR (rid1 = rid2 AND pos1 >= pos2) AS swap FROM ends)
SELECT read_id, CASE WHEN swap THEN rid2 ELSE rid1 END::INT AS rid1, CASE WHEN swap THEN pos2 ELSE pos1 END AS pos1, CASE WHEN swap THEN rid1 ELSE rid2 END::INT AS rid2, CASE WHEN swap THEN pos1 ELSE pos2 END AS pos2,
  CASE WHEN swap THEN plus2 ELSE plus1 END AS plus1, CASE WHEN swap THEN plus1 ELSE plus2 END AS plus2, mapq FROM swapped""")
def pair_flip(spark, sf_dir):
    """P20: contact pairs turned to the upper triangle; the second sequence is made by arithmetic."""
    return lines.flip_pairs(_contacts(spark, sf_dir))


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir)
    return f.select(
        "read_id", F.col("rid").alias("rid1"), F.col("fragment_start_position").alias("pos1"), ((F.col("rid") * 7 + F.col("read_id")) % 24).cast("int").alias("rid2"),
        (F.col("fragment_start_position") + F.col("fragment_length") - 1).alias("pos2"), (F.col("direction") == 1).alias("plus1"), (F.col("is_unique") == 1).alias("plus2"), "mapq",
    )


@query(f"""WITH p AS ({SQL['pair_flip']})
SELECT concat_ws(chr(9), 'r' || read_id, a.ref_name, pos1 + 1, b.ref_name, pos2 + 1, CASE WHEN plus1 THEN '+' ELSE '-' END, CASE WHEN plus2 THEN '+' ELSE '-' END, 'UU', coalesce(mapq, 0), coalesce(mapq, 0)) AS line
FROM p JOIN ref_seqs a ON p.rid1 = a.rid JOIN ref_seqs b ON p.rid2 = b.rid""")
def pairs_rows(spark, sf_dir):
    """Body lines of a contact-pairs file."""
    refs = table(spark, sf_dir, "ref_seqs")
    rows = lines.flip_pairs(_contacts(spark, sf_dir))
    rows = rows.join(refs.select(F.col("rid").alias("rid1"), F.col("ref_name").alias("ref_name1")), "rid1").join(refs.select(F.col("rid").alias("rid2"), F.col("ref_name").alias("ref_name2")), "rid2")
    return lines.pairs_lines(rows.withColumns({"read_name": F.concat(F.lit("r"), "read_id"), "mapq": F.coalesce("mapq", F.lit(0))}))


@query(f"""WITH {FRAGMENTS} SELECT read_id, m.mate, 3 + CASE WHEN m.plus THEN 32 ELSE 16 END + CASE WHEN m.mate = 1 THEN 64 ELSE 128 END + CASE WHEN is_unique = 1 THEN 0 ELSE 256 END AS flag,
  CASE WHEN m.plus THEN fragment_length ELSE -fragment_length END AS tlen
  FROM fragments, LATERAL (SELECT 1 AS mate, direction = 1 AS plus UNION ALL SELECT 2, direction <> 1) m""")
def sam_flags(spark, sf_dir):
    """Flags and template lengths of both mates."""
    mates = F.explode(F.array(F.struct(F.lit(1).alias("mate"), (F.col("direction") == 1).alias("plus")), F.struct(F.lit(2).alias("mate"), (F.col("direction") != 1).alias("plus"))))
    rows = fragments(spark, sf_dir).select("read_id", "is_unique", "fragment_length", mates.alias("m"))
    return rows.select("read_id", "m.mate", lines.pair_flag(F.col("m.plus"), F.col("m.mate") == 1, F.col("is_unique") != 1).alias("flag"), lines.template_length(F.col("m.plus"), F.col("fragment_length")).alias("tlen"))
