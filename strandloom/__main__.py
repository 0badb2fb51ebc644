"""``python -m strandloom index|map``: the file workflow from a command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from strandloom.params import FORMATS, IndexParams, MapParams, parse_frip, preset
from strandloom.plans import workflow

#: Options of `map` that set a parameter of the same name, with their kind.
NUMBERS = {
    "error_threshold": int, "min_seeds": int, "max_insert_size": int, "mapq_threshold": int, "min_read_length": int, "max_best_mappings": int, "drop_repetitive_reads": int, "barcode_errors": int,
    "match": int, "mismatch": int, "barcode_probability": float, "allocation_distance": int, "seed": int, "cache_size": int, "minhash_size": int,
}
SWITCHES = ["trim_adapters", "remove_duplicates", "tn5_shift", "split_alignment", "low_memory", "keep_unlisted_barcodes", "skip_barcode_check", "allocate_multi_mappings"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    index = verbs.add_parser("index")
    index.add_argument("--reference", required=True)
    index.add_argument("--out", required=True)
    index.add_argument("--kmer-size", type=int)
    index.add_argument("--window-size", type=int)
    index.add_argument("--min-frag-length", type=int)
    run = verbs.add_parser("map")
    for name in ("reference", "index", "out", "read1"):
        run.add_argument(f"--{name}", required=True)
    for name in ("read2", "barcode", "whitelist", "translation", "order", "summary-out", "preset", "read-format", "frip-coefficients", "max-seed-frequencies", "gap-open", "gap-extend"):
        run.add_argument(f"--{name}")
    run.add_argument("--split-bytes", type=int, default=0)
    run.add_argument("--output-format", choices=FORMATS)
    level = run.add_mutually_exclusive_group()
    level.add_argument("--duplicates-at-bulk-level", action="store_true", default=None)
    level.add_argument("--duplicates-at-cell-level", action="store_false", dest="duplicates_at_bulk_level")
    run.add_argument("--no-cache-slots", action="store_false", dest="count_cache_slots", default=None)
    for name, kind in NUMBERS.items():
        run.add_argument(f"--{name.replace('_', '-')}", type=kind)
    for name in SWITCHES:
        run.add_argument(f"--{name.replace('_', '-')}", action="store_true", default=None)
    return top


def index_params(args: argparse.Namespace) -> IndexParams:
    base = IndexParams.for_fragments(args.min_frag_length) if args.min_frag_length else IndexParams()
    return IndexParams(args.kmer_size or base.kmer_size, args.window_size or base.window_size)


def map_params(args: argparse.Namespace) -> MapParams:
    """The preset's values, overridden by what was given."""
    given = {n: getattr(args, n) for n in (*NUMBERS, *SWITCHES, "output_format", "read_format", "duplicates_at_bulk_level", "count_cache_slots") if getattr(args, n) is not None}
    if args.frip_coefficients:
        given["frip_coefficients"] = parse_frip(args.frip_coefficients)
    for name in ("max_seed_frequencies", "gap_open", "gap_extend"):
        if getattr(args, name):
            given[name] = tuple(int(x) for x in getattr(args, name).split(","))
    return (preset(args.preset) if args.preset else MapParams()).but(**given)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    if args.verb == "index":
        workflow.index_files(spark, args.reference, args.out, index_params(args))
    else:
        files = {n: getattr(args, n) for n in ("reference", "index", "out", "read1", "read2", "barcode", "whitelist", "translation", "order", "summary_out")}
        workflow.map_files(spark, **files, params=map_params(args), split_bytes=args.split_bytes)


if __name__ == "__main__":
    main()
