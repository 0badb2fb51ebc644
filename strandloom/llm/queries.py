"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.cells import with_cell
from strandloom.llm import distinct, frequent, languages, leakage, packing, percentiles, survivors
from strandloom.plans.intervals_and_load import CELLS_SQL
from strandloom.storage import cut, table

#: Percentiles reported by the queries of problem 2.
AT = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
FIELDS = ["fragment_length", "mapq"]
#: Share of the rows from which a cell counts as frequent.
FREQUENT_SHARE = 0.004


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "paired_end_mapping_with_barcode")
    return survivors.survivors(survivors.duplicate_members(records, table(spark, sf_dir, "whitelist")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the best record of every duplicate group."""
    return _survivors(spark, sf_dir).select("first_record_id", "best_record_id")


def p1_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every duplicate group with fused field values."""
    return _survivors(spark, sf_dir)


def p1_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group's size, and the fused values of the fields on which all its records agree: there is
    then one value to fuse, with certainty."""
    records = table(spark, sf_dir, "paired_end_mapping_with_barcode")
    members = survivors.duplicate_members(records, table(spark, sf_dir, "whitelist"))
    members = cut(members)
    fused = survivors.survivors(members)
    claims = members.groupBy("g").agg(*(F.size(F.collect_set(c)).alias(f"n_{name}") for name, c, _ in survivors.FIELDS))
    agreed = [F.when(F.col(f"n_{name}") == 1, F.struct(F.col(name).alias("v"), (F.abs(F.col(f"{name}_confidence") - 1) < 1e-9).alias("sure"))) for name, _, _ in survivors.FIELDS]
    rows = fused.join(claims.withColumnRenamed("g", "first_record_id"), "first_record_id").select("first_record_id", "n_records", *(a.alias(name) for a, (name, _, _) in zip(agreed, survivors.FIELDS)))
    return rows.select("first_record_id", "n_records", *(F.col(f"{name}.v").alias(name) for name, _, _ in survivors.FIELDS), *(F.col(f"{name}.sure").alias(f"{name}_sure") for name, _, _ in survivors.FIELDS))


P1_GROUPED = f"""WITH RECURSIVE {CELLS_SQL.format(source="paired_end_mapping_with_barcode")},
celled_all AS (
  SELECT p.*, c.cell, c.seen IN (SELECT barcode FROM whitelist) AS listed FROM paired_end_mapping_with_barcode p LEFT JOIN celled c ON p.record_id = c.record_id),
near_pairs AS (
  SELECT a.record_id AS a, b.record_id AS b FROM celled_all a JOIN celled_all b
    ON a.library_id = b.library_id AND a.rid = b.rid AND a.cell = b.cell AND a.record_id <> b.record_id
   AND abs(a.fragment_start_position - b.fragment_start_position) <= {survivors.REACH}
   AND abs(a.fragment_start_position + a.fragment_length - b.fragment_start_position - b.fragment_length) <= {survivors.REACH}
  UNION
  SELECT a.record_id, b.record_id FROM celled_all a JOIN celled_all b ON a.read_id = b.read_id AND a.record_id <> b.record_id),
reach AS (SELECT a, b FROM near_pairs UNION SELECT r.a, p.b FROM reach r JOIN near_pairs p ON r.b = p.a),
grouped AS (SELECT a AS record_id, least(a, min(b)) AS g FROM reach GROUP BY a)"""
P1_FOUND_SQL = f"""{P1_GROUPED},
ranked AS (
  SELECT g.g, c.record_id, row_number() OVER (PARTITION BY g.g ORDER BY
      (c.cell_barcode IS NULL)::INT + (c.fragment_start_position IS NULL)::INT + (c.fragment_length IS NULL)::INT + (c.mapq IS NULL)::INT + (c.num_dups IS NULL)::INT,
      coalesce(c.listed, false) DESC, coalesce(c.mapq, -1) DESC, coalesce(c.num_dups, -1) DESC, c.mapped_at DESC, c.record_id) AS n
  FROM grouped g JOIN celled_all c ON g.record_id = c.record_id)
SELECT g AS first_record_id, record_id AS best_record_id FROM ranked WHERE n = 1"""


_AGREED = {"cell_barcode": "c.cell", "fragment_start_position": "c.fragment_start_position", "fragment_length": "c.fragment_length", "mapq": "c.mapq", "num_dups": "c.num_dups"}
P1_AGREED_SQL = f"""{P1_GROUPED}
SELECT g.g AS first_record_id, count(*) AS n_records, {", ".join(f"CASE WHEN count(DISTINCT {c}) = 1 THEN min({c}) END AS {n}" for n, c in _AGREED.items())},
  {", ".join(f"CASE WHEN count(DISTINCT {c}) = 1 THEN true END AS {n}_sure" for n, c in _AGREED.items())}
FROM grouped g JOIN celled_all c ON g.record_id = c.record_id GROUP BY g.g"""


def _day() -> F.Column:
    return F.to_date(F.date_trunc("day", "mapped_at"))


def _daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "paired_end_mapping_with_barcode").select("library_id", "mapped_at", "cell_barcode", *FIELDS)
    rows = with_cell(rows, table(spark, sf_dir, "whitelist")).select("library_id", _day().alias("day"), "cell", *FIELDS)
    return percentiles.sketch(rows, ["library_id", "day", "cell"], FIELDS)


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of fragment length and mapq per library, day and cell."""
    return percentiles.percentiles(_daily_sketches(spark, sf_dir), ["library_id", "day", "cell"], FIELDS, AT)


def p2_library_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per library, from the merged sketches of its days and cells."""
    merged = percentiles.merge(_daily_sketches(spark, sf_dir), ["library_id"], FIELDS)
    return percentiles.percentiles(merged, ["library_id"], FIELDS, AT)


def p2_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per library: exact numbers of values, and whether every percentile of the merged sketches holds a
    value whose exact rank is within the reported error."""
    rows = table(spark, sf_dir, "paired_end_mapping_with_barcode").select("library_id", *FIELDS)
    found = p2_library_percentiles(spark, sf_dir)
    by = rows.select("library_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in FIELDS))).alias("x")).select("library_id", "x.*").filter("v IS NOT NULL")
    by = by.groupBy("library_id", "field", "v").agg(F.count("*").alias("n"))  # of one value once
    name = lambda f, p: f"{f}_p{p * 100:g}"
    answers = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(p).alias("p"), F.col(name(f, p)).alias("answer"), F.col(f"{f}_rank_error").alias("error"), F.col(f"{f}_n").alias("n_sketched")) for f in FIELDS for p in AT)))
    asked = found.select("library_id", answers.alias("a")).select("library_id", "a.*")
    keys = ["library_id", "field"]
    ranks = by.join(asked, keys).groupBy(*keys, "p", "answer", "error", "n_sketched").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("v") < F.col("answer"), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("answer"), F.col("n")).otherwise(0)).alias("upto"))
    fits = (F.col("below") <= (F.col("p") + F.col("error")) * F.col("n")) & (F.col("upto") >= (F.col("p") - F.col("error")) * F.col("n")) & (F.col("n") == F.col("n_sketched"))
    return ranks.groupBy(*keys).agg(F.max("n").alias("n_values"), F.bool_and(fits).alias("within_bound"))


P2_BOUNDS_SQL = " UNION ALL ".join(f"SELECT library_id, '{f}' AS field, count({f}) AS n_values, true AS within_bound FROM paired_end_mapping_with_barcode GROUP BY library_id HAVING count({f}) > 0" for f in FIELDS)


def p4_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct barcodes and reads per day, per library, per both, and over all rows."""
    rows = table(spark, sf_dir, "mapping_with_barcode").select("library_id", _day().alias("day"), "cell_barcode", "read_id")
    keys = ["day", "library_id"]
    maps = cut(distinct.bitmaps(rows, keys, ["cell_barcode", "read_id"]))
    return distinct.rollups(maps, [keys, ["day"], ["library_id"], []], keys)


def p4_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact numbers beside the estimates' rows, and whether each estimate is within five standard errors."""
    keys = ["day", "library_id"]
    rows = table(spark, sf_dir, "mapping_with_barcode").select("library_id", _day().alias("day"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.xxhash64(f).alias("h"), F.col(f).isNull().alias("none")) for f in ("cell_barcode", "read_id")))).alias("x"))
    different = cut(rows.filter("NOT x.none").select(*keys, "x.field", "x.h").distinct())
    exact = []
    for s in (keys, ["day"], ["library_id"], []):
        n = different.select(*s, "field", "h").distinct().groupBy(*s, "field").agg(F.count("*").alias("n_exact"))
        exact.append(n.select(F.lit("+".join(s) or "all").alias("scope"), *(F.col(k) if k in s else F.lit(None).cast(different.schema[k].dataType).alias(k) for k in keys), "field", "n_exact"))
    exact = reduce(DataFrame.unionByName, exact).alias("e")
    found = p4_distinct(spark, sf_dir).alias("f")
    on = (F.col("e.scope") == F.col("f.scope")) & (F.col("e.field") == F.col("f.field")) & F.col("e.day").eqNullSafe(F.col("f.day")) & F.col("e.library_id").eqNullSafe(F.col("f.library_id"))
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.greatest(F.lit(1.0), 5 * F.col("std_error") * F.col("n_exact"))
    return exact.join(found, on).select("e.scope", "e.day", "e.library_id", "e.field", "n_exact", near.alias("within_bound"))


P4_BOUNDS_SQL = " UNION ALL ".join(
    f"SELECT '{'+'.join(s) or 'all'}' AS scope, {'day' if 'day' in s else 'NULL::DATE'} AS day, {'library_id' if 'library_id' in s else 'NULL::VARCHAR'} AS library_id, '{f}' AS field, count(DISTINCT {f}) AS n_exact, true AS within_bound FROM (SELECT *, CAST(mapped_at AS DATE) AS day FROM mapping_with_barcode) t WHERE {f} IS NOT NULL {'GROUP BY ' + ', '.join(s) if s else ''}"
    for s in (["day", "library_id"], ["day"], ["library_id"], []) for f in ("cell_barcode", "read_id")
)


def p5_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent cells of the single-end records with their counts."""
    rows = with_cell(table(spark, sf_dir, "mapping_with_barcode").select("cell_barcode"), table(spark, sf_dir, "whitelist"))
    return frequent.frequent(rows.select(F.col("cell").alias("cell_barcode")), "cell_barcode", FREQUENT_SHARE)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with at least FREQUENT_SHARE of the rows that have a barcode."""
    return p5_frequent(spark, sf_dir).select("cell_barcode")


_P5 = f"""WITH {CELLS_SQL.format(source="mapping_with_barcode")},
counted AS (SELECT cell AS cell_barcode, count(*) AS n_rows, CAST(sum(count(*)) OVER () AS BIGINT) AS n_total FROM celled GROUP BY cell)"""
P5_FREQUENT_SQL = f"{_P5} SELECT * FROM counted WHERE n_rows >= {FREQUENT_SHARE} * n_total"
P5_FOUND_SQL = f"{_P5} SELECT cell_barcode FROM counted WHERE n_rows >= {FREQUENT_SHARE} * n_total"


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document."""
    return _packed(spark, sf_dir)


def p7_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every placement: documents placed, containers beyond their capacity, pieces
    placed twice, documents split although they fit, and whether nine tenths of the room is used."""
    placed = _packed(spark, sf_dir)
    used = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).alias("n_overfull"), (F.sum("used") >= 0.9 * packing.CAPACITY * F.count("*")).alias("well_filled"))
    pieces = placed.groupBy("doc_id", "piece").agg(F.count("*").alias("n"), F.max("n_tokens").alias("n_tokens")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("n_tokens").alias("tokens"))
    counted = pieces.agg(F.count("*").alias("n_documents"), F.coalesce(F.sum(F.col("n") - F.col("k")), F.lit(0)).alias("n_repeated"), F.count_if((F.col("k") > 1) & (F.col("tokens") <= packing.CAPACITY)).alias("n_torn"))
    return counted.crossJoin(used)  # one row each


P7_SOUND_SQL = "SELECT count(*) FILTER (length(text) > 0) AS n_documents, 0::BIGINT AS n_repeated, 0::BIGINT AS n_torn, 0::BIGINT AS n_overfull, true AS well_filled FROM documents"


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split because their text alone exceeds a container."""
    return _packed(spark, sf_dir).filter("piece = 1").select("doc_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they share a run of template windows with, re-parameterised ones included."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents holding a run of an item's own words."""
    return p8_leaks(spark, sf_dir).filter(leakage.verbatim()).select("doc_id", "item_id")


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents")
    return documents, languages.segments(documents, languages.fit(documents))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment of every document."""
    return _segments(spark, sf_dir)[1]


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language and confidence of every document."""
    return languages.document_languages(_segments(spark, sf_dir)[1])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the languages of their paragraphs that their label does not name."""
    return languages.mislabelled(*_segments(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_fused": p1_fused,
    "p1_agreed": p1_agreed,
    "p2_percentiles": p2_percentiles,
    "p2_library_percentiles": p2_library_percentiles,
    "p2_bounds": p2_bounds,
    "p4_distinct": p4_distinct,
    "p4_bounds": p4_bounds,
    "p5_found": p5_found,
    "p5_frequent": p5_frequent,
    "p7_found": p7_found,
    "p7_pack": p7_pack,
    "p7_sound": p7_sound,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_segments": p9_segments,
    "p9_documents": p9_documents,
}
SQL = {"p1_found": P1_FOUND_SQL, "p1_agreed": P1_AGREED_SQL, "p2_bounds": P2_BOUNDS_SQL, "p4_bounds": P4_BOUNDS_SQL, "p7_sound": P7_SOUND_SQL, "p5_found": P5_FOUND_SQL, "p5_frequent": P5_FREQUENT_SQL}
