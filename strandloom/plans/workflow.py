"""From files to files: building an index, and mapping reads to any of the text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import bases, effective_range
from strandloom.operators import barcodes, lines, seeds, summary
from strandloom.operators.adapters import trim_pairs
from strandloom.operators.minimizers import build_index, minimizers
from strandloom.params import IndexParams, MapParams, parse_read_format
from strandloom.plans import pipeline
from strandloom.sources import fastx, sinks, tables
from strandloom.storage import cut


def index_files(spark: SparkSession, reference: str, out: str, params: IndexParams = IndexParams()) -> None:
    """Builds and stores the index of a reference file."""
    refs = fastx.read_references(spark, reference).select("rid", bases(F.col("seq")).alias("seq"))
    tables.write_index(build_index(cut(refs), params), out, params)


def _reads(spark: SparkSession, read1: str, read2: str | None, barcode: str | None, params: MapParams, split_bytes: int = 0) -> DataFrame:
    """``read_id, read_name, seq (or seq1, seq2), qual..., barcode, barcode_qual`` under the read format."""
    load = lambda p: fastx.read_fastx(spark, p, split_bytes) if p else None
    form = parse_read_format(params.read_format)
    rows = fastx.zip_reads(load(read1), load(read2), load(barcode)).withColumnRenamed("name", "read_name")
    changed = {}
    for tag, name in (("1", "r1"), ("2", "r2")) if read2 else (("", "r1"),):
        changed[f"seq{tag}"] = effective_range(bases(F.col(f"seq{tag}")), form.of(name))
        changed[f"qual{tag}"] = effective_range(F.col(f"qual{tag}"), form.of(name), quality=True)
    if barcode:
        changed["barcode"] = effective_range(bases(F.col("barcode")), form.of("bc"))
        changed["barcode_qual"] = effective_range(F.col("barcode_qual"), form.of("bc"), quality=True)
    return rows.withColumns(changed)


def _celled(rows: DataFrame, whitelist: DataFrame, params: MapParams) -> tuple[DataFrame, DataFrame]:
    """Rows with corrected barcodes, those of other cells dropped or (on demand) kept, and the abundance."""
    length = tables.barcode_length(rows, "barcode")
    known = cut(barcodes.abundance(rows, whitelist))
    check = barcodes.check_whitelist(rows, whitelist).first()
    if not check["passed"] and not params.skip_barcode_check:
        raise ValueError(f"only {check['n_listed']} of {check['n_observed']} barcodes are on the whitelist")
    found = barcodes.correct(rows, whitelist, known, length, params.barcode_errors, params.barcode_probability, quality="barcode_qual", key="read_id")
    kept = F.coalesce("corrected", "barcode") if params.keep_unlisted_barcodes else F.col("corrected")
    return found.withColumn("cell", kept).drop("corrected", "outcome"), known


def _summary(rows: DataFrame, mapped: DataFrame, final: DataFrame, found: DataFrame | None, params: MapParams) -> DataFrame:
    """Per-cell counters of a run: all rows, mapped ones, surplus copies, and survivors of low quality."""
    hits = rows.select("read_id", F.lit(False).alias("cachehit"), F.lit(None).cast("long").alias("slot"))
    if found is not None:
        sig = seeds.signatures(found).select("read_id", F.pmod(F.xxhash64("signature"), F.lit(params.cache_size)).alias("slot"), F.xxhash64("signature", F.lit(1)).alias("fingerprint"))
        met = summary.with_cache_hits(sig, summary.cache_slots(sig))
        hits = met.groupBy("read_id").agg(F.max("cachehit").alias("cachehit"), F.min(F.when(F.col("cachehit"), F.col("slot"))).alias("slot"))
    flags = rows.select("read_id", "cell").join(mapped.select("read_id", F.lit(True).alias("mapped")).distinct(), "read_id", "left")
    flags = flags.join(final.select("read_id", F.lit(True).alias("first"), (F.col("mapq") < params.mapq_threshold).alias("lowmapq")).dropDuplicates(["read_id"]), "read_id", "left").join(hits, "read_id", "left")
    flags = cut(flags.withColumns({"duplicate": F.col("mapped") & F.col("first").isNull(), "cachehit": F.col("mapped") & F.col("cachehit")}))
    table = summary.derived(summary.summarise(flags, "cell"), params.frip_coefficients)
    if not params.count_cache_slots:
        return table
    slots = summary.smallest_values(flags.filter("cell IS NOT NULL"), ["cell"], "slot", params.minhash_size, params.cache_size).select(F.col("cell").alias("barcode"), F.col("cardinality").alias("numcacheslots"))
    return table.join(slots, "barcode", "left").fillna(0, ["numcacheslots"])


def map_files(
    spark: SparkSession, reference: str, index: str, out: str, read1: str, read2: str | None = None, barcode: str | None = None, whitelist: str | None = None,
    translation: str | None = None, order: str | None = None, summary_out: str | None = None, params: MapParams = MapParams(), split_bytes: int = 0,
) -> None:
    """Maps reads and writes one of the text formats below ``out``, and the summary if asked.

    Paths may be comma-separated lists and patterns; file k of each list belongs together.
    With ``split_bytes``, plain files of four lines a record are read by several tasks each.
    ``order`` lists sequence names in the order wanted, by which contacts are also turned.
    """
    if params.output_format == "pairs" and read2 is None:
        raise ValueError("contact pairs need paired reads")
    names = cut(fastx.read_references(spark, reference).withColumn("seq", bases(F.col("seq"))))
    refs = names.select("rid", "seq")
    ranks = lines.reference_ranks(names.drop("seq"), tables.read_order(spark, order) if order else []).select("rid", "ref_name", "new_rid", F.col("length").alias("ref_length"))
    held, ip = tables.read_index(spark, index)
    rows = _reads(spark, read1, read2, barcode, params, split_bytes).withColumn("cell", F.lit(None).cast("string"))
    known = None
    if barcode and whitelist:
        rows, known = _celled(rows, tables.read_whitelist(spark, whitelist), params)
    elif barcode:
        rows = rows.withColumn("cell", F.col("barcode"))
    rows = cut(rows)
    used = rows.filter("cell IS NOT NULL") if barcode else rows
    paired = read2 is not None
    if paired and params.trim_adapters:
        used = cut(trim_pairs(used, params.min_read_length))
    tags = ("1", "2") if paired else ("",)
    kept = used.select("read_id", "read_name", "cell", *(f"seq{t}" for t in tags), *(F.col(f"seq{t}").alias(f"bases{t}") for t in tags), *(F.col(f"qual{t}") for t in tags))
    run = pipeline.map_paired if paired else pipeline.map_single
    found = cut(run(kept, held, refs, params.but(trim_adapters=False), ip))
    by_cell = "cell" if barcode else None
    if params.output_format == "pairs":
        _write_contacts(found, ranks, params, out)
        return
    final = cut(pipeline.finish(found, params.but(mapq_threshold=0), paired, by_cell, known))
    text = final.filter(F.col("mapq") >= params.mapq_threshold).join(ranks, "rid")
    if translation and barcode:
        table = tables.read_translation(spark, translation)
        mapping = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
        text = text.withColumn("cell", barcodes.translate(F.col("cell"), mapping, len(next(iter(table)))))
    _write(text.withColumnRenamed("cell", "cell_barcode"), names, ranks, refs, params, paired, barcode is not None, out)
    if summary_out:
        ends = used.select("read_id", F.explode(F.array(*(F.struct(F.lit(i + 1).alias("mate"), F.col(f"seq{t}").alias("seq")) for i, t in enumerate(tags)))).alias("m")).select("read_id", "m.mate", "m.seq")
        seeds_of = minimizers(ends, seeds.END, ip) if paired else None
        label = rows if barcode else rows.withColumn("cell", F.lit(""))
        sinks.write_summary(_summary(label, found, final, seeds_of, params), summary_out)


def _write(text: DataFrame, names: DataFrame, ranks: DataFrame, refs: DataFrame, params: MapParams, paired: bool, celled: bool, out: str) -> None:
    key = ["new_rid", "fragment_start_position", "fragment_length", "read_id"]
    place = text.select(*key, F.struct("*").alias("r"))

    def with_key(lines_of) -> DataFrame:
        """Lines beside the sort key of their record."""
        rows = place.select(*(F.col(k).alias(f"k_{k}") for k in key), "r.*")
        return lines_of(rows)

    kind = params.output_format
    if kind == "BED":
        body = with_key(lambda d: d.withColumn("line", lines.fragment_line() if celled else lines.bed_line()))
    elif kind == "TagAlign":
        body = with_key(lambda d: lines.with_tagalign_pair_line(d) if paired else d.withColumn("line", lines.tagalign_line(celled)))
    elif kind == "PAF":
        body = with_key(lambda d: lines.with_paf_pair_line(d) if paired else d.withColumn("read_length", F.length("bases")).withColumn("line", lines.paf_line()))
    else:
        rows = text.withColumn("barcode", F.col("cell_barcode"))
        found = pipeline.sam_pair_records(rows, refs, params) if paired else pipeline.sam_records(rows.withColumnRenamed("bases", "seq"), refs, params)
        body = lines.sam_lines(found, keep=["rid", "pos", "read_name", "flag"]).join(ranks.select("rid", "new_rid"), "rid")
        header = names.select("rid", "ref_name", "length").join(ranks.select("rid", "new_rid"), "rid").drop("rid").withColumnRenamed("new_rid", "rid")
        sinks.write_sam(body, header, out, ["new_rid", "pos", "read_name", "flag"])
        return
    sinks.write_lines(body, out, [*(f"k_{k}" for k in key), *(["mate"] if "mate" in body.columns else [])])


def _write_contacts(found: DataFrame, ranks: DataFrame, params: MapParams, out: str) -> None:
    """Contacts of sufficient quality, turned to the upper triangle of the sequence order."""
    side = lambda m: ranks.select(F.col("rid").alias(f"rid{m}"), F.col("new_rid").alias(f"rank{m}"))
    rows = found.filter(F.col("mapq") >= params.mapq_threshold).join(side(1), "rid1").join(side(2), "rid2")
    rows = lines.flip_pairs(rows.drop("rid1", "rid2").withColumnsRenamed({"rank1": "rid1", "rank2": "rid2"}))
    if params.remove_duplicates:
        rows = rows.groupBy("rid1", "pos1", "rid2", "pos2").agg(F.max(F.struct("mapq", F.struct("read_id", "read_name", "plus1", "plus2").alias("x"))).alias("b")).select("rid1", "pos1", "rid2", "pos2", "b.mapq", "b.x.*")
    name = lambda m: ranks.select(F.col("new_rid").alias(f"rid{m}"), F.col("ref_name").alias(f"ref_name{m}"))
    body = lines.pairs_lines(rows.join(name(1), "rid1").join(name(2), "rid2"), keep=["rid1", "rid2", "pos1", "pos2", "read_id"])
    header = ranks.select(F.col("new_rid").alias("rid"), "ref_name", F.col("ref_length").alias("length"))
    sinks.write_pairs(body, header, out, ["rid1", "rid2", "pos1", "pos2", "read_id"])
