"""Problem 1: duplicate groups, their best record, and field values fused over dependent sources."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.cells import with_cell
from strandloom.llm.components import components, crowded_points
from strandloom.storage import cut, spread

#: Bases by which starts and ends of one fragment may differ.
REACH = 8
#: Fields whose values are fused, as (output name, column of the members table, type).
FIELDS = [("cell_barcode", "cell", "string"), ("fragment_start_position", "start", "long"), ("fragment_length", "length", "int"), ("mapq", "mapq", "int"), ("num_dups", "num_dups", "int")]
#: Sources are told apart by how the barcode is spelt (6 ways) and how late the record came (3).
SPELLINGS, DELAYS = 6, 3
#: Sources that a set of sources can hold, which is a number's bits.
MOST_SOURCES = 62
#: Rounds of estimating accuracies and dependence; false values assumed per field; prior
#: probability that two sources depend; share of its values a copier copies.
ROUNDS, FALSE_VALUES, DEPENDENT, COPIED = 4, 10, 0.2, 0.8


def source_of(barcode: Column, listed: Column, mapped_at: Column, loaded_at: Column) -> Column:
    """Number 0..SPELLINGS * DELAYS - 1 of the source of a record."""
    spelling = (
        F.when(barcode.isNull(), 5).when(barcode != F.trim(barcode), 3).when(F.contains(barcode, F.lit("-")), 2).when(barcode != F.upper(barcode), 1).when(~listed, 4).otherwise(0)
    )
    late = (F.unix_seconds(loaded_at) - F.unix_seconds(mapped_at)) / 86400
    return (spelling * DELAYS + F.when(late >= 3, 2).when(late >= 1, 1).otherwise(0)).cast("int")


def duplicate_members(records: DataFrame, whitelist: DataFrame, source: Column | None = None) -> DataFrame:
    """One row per record of a group of two or more: ``g`` (the group's smallest record_id),
    ``record_id, cell, start, length, mapq, num_dups, source, rank``.

    Records belong together by the same read_id, or by the same library_id, rid and cell with
    start and end at most REACH apart, transitively; a missing value matches nothing. rank is a
    struct whose maximum is the group's best record: fewest nulls among the five fields, then a
    whitelisted barcode, highest mapq, highest num_dups (null lowest), latest mapped_at, smallest
    record_id. Extra columns are ignored; record_id must be unique, rows without one are left out.
    An empty table has no groups.

    A library, rid and cell enter as a 64-bit hash beside start and end: two fragments of other
    cells would have to share it and the position to be confused. Only points and reads with
    company become vertices; the rest never leaves the first pass.

    ``source`` is a whole number 0..MOST_SOURCES - 1 that tells a record's source; without it
    sources are told apart by source_of. A null or other number is an error.
    """
    base = records.select("record_id", "read_id", "library_id", "rid", "cell_barcode", F.col("fragment_start_position").alias("start"), F.col("fragment_length").alias("length"), "mapq", "num_dups", "mapped_at", "loaded_at", *([] if source is None else [source.alias("source_given")])).filter("record_id IS NOT NULL")
    key = ["h", "x", "y"]

    def placed(rows: DataFrame) -> DataFrame:
        """Rows with their cells and points."""
        rows = with_cell(rows, whitelist)
        whole = F.col("library_id").isNotNull() & F.col("rid").isNotNull() & F.col("cell").isNotNull() & F.col("start").isNotNull() & F.col("length").isNotNull()
        return rows.select(
            "*",
            F.when(whole, F.xxhash64("library_id", "rid", "cell")).otherwise(F.xxhash64("record_id")).alias("h"),
            F.when(whole, F.col("start")).otherwise(-1).cast("long").alias("x"),
            F.when(whole, F.col("start") + F.col("length")).otherwise(F.col("record_id")).cast("long").alias("y"),
            whole.alias("placed"),
        )

    rows = placed(spread(base))
    crowded = cut(crowded_points(rows.filter("placed").select(*key, F.col("record_id").alias("id")), REACH))
    points = crowded.select(*key, "first_id").distinct()  # those near a tile's end may come from two tiles
    # records of reads that were delivered more than once, each linked to its read's first record
    reads = base.filter("read_id IS NOT NULL").groupBy("read_id").agg(F.min("record_id").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("read_id", "lead")
    again = base.select("read_id", "record_id", "library_id", "rid", "cell_barcode", "start", "length").join(reads, "read_id")
    again = cut(placed(again).select("record_id", "lead", *key))
    again = again.join(points, key, "left").withColumn("vertex", F.coalesce("first_id", "record_id"))
    edges = crowded.select(F.col("first_id").alias("a"), F.col("root").alias("b")).unionByName(again.select(F.col("vertex").alias("a"), F.col("lead").alias("b")))
    roots = components(edges)
    vertices = points.withColumnRenamed("first_id", "node").unionByName(again.filter("first_id IS NULL").select(*key, F.col("record_id").alias("node")))
    grouped = cut(vertices.join(roots, "node", "left").select(*key, F.coalesce("root", "node").alias("g")))
    nulls = sum(F.col(c).isNull().cast("int") for c in ("cell_barcode", "start", "length", "mapq", "num_dups"))
    if source is None:
        source = source_of(F.col("cell_barcode"), F.col("cell_listed"), F.col("mapped_at"), F.col("loaded_at"))
    else:
        source = F.when(F.col("source_given").between(0, MOST_SOURCES - 1), F.col("source_given").cast("int")).otherwise(F.raise_error(F.lit("a source is outside its range")).cast("int"))
    wanted = rows.select(*key, "record_id", "cell", "start", "length", "mapq", "num_dups", "mapped_at", (-nulls).alias("full"), F.col("cell_listed").cast("int").alias("listed"), source.alias("source"))
    # the rank repeats columns, so it is put together behind the shuffle
    rank = F.struct("full", "listed", F.coalesce("mapq", F.lit(-1)).alias("mapq"), F.coalesce("num_dups", F.lit(-1)).alias("num_dups"), "mapped_at", (-F.col("record_id")).alias("id"))
    return wanted.join(grouped, key).select("g", "record_id", "cell", "start", "length", "mapq", "num_dups", "source", rank.alias("rank"))


def _votes(masks: list[int], accuracy: np.ndarray, dependent: np.ndarray) -> list[float]:
    """Log-odds vote for a value given by each set of sources; a source that probably copied
    from a more accurate one in the set counts only for what it provides itself."""
    weight = np.log(FALSE_VALUES * accuracy / (1 - accuracy))
    out = []
    for mask in masks:
        own = sorted((k for k in range(len(accuracy)) if mask >> k & 1), key=lambda k: -accuracy[k])
        out.append(float(sum(weight[k] * math.prod(1 - COPIED * dependent[k, j] for j in own[:i]) for i, k in enumerate(own))))
    return out


def _dependence(accuracy: np.ndarray, same: np.ndarray, same_false: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Posterior probability that two sources depend, from values they share: shared false ones
    are improbable unless copied, shared true ones are not, differing ones speak against it."""
    a, b = accuracy[:, None], accuracy[None, :]
    true, false = a * b, (1 - a) * (1 - b) / FALSE_VALUES
    differ = np.maximum(both - same, 0)
    mean = (a + b) / 2
    gain = (
        (same - same_false) * np.log((mean * COPIED + true * (1 - COPIED)) / true)
        + same_false * np.log(((1 - mean) * COPIED + false * (1 - COPIED)) / false)
        + differ * np.log(1 - COPIED)
    )
    out = 1 / (1 + (1 - DEPENDENT) / DEPENDENT * np.exp(-np.clip(gain, -500, 500)))
    np.fill_diagonal(out, 0)
    return out


def claimed_values(members: DataFrame) -> DataFrame:
    """``g, field, value, sources, n``: every value claimed in a group, with the set of claiming
    sources as bits and the number of records. Nulls claim nothing."""
    each = F.explode(F.array(*(F.struct(F.lit(i).cast("tinyint").alias("field"), F.col(c).cast("string").alias("value")) for i, (_, c, _) in enumerate(FIELDS))))
    rows = members.select("g", F.expr("shiftleft(1L, source)").alias("bit"), each.alias("x")).select("g", "x.field", "x.value", "bit").filter("value IS NOT NULL")
    return rows.groupBy("g", "field", "value").agg(F.bit_or("bit").alias("sources"), F.count("*").alias("n"))


def estimate(values: DataFrame) -> dict[int, float]:
    """The vote of every set of sources that occurs, after ROUNDS of estimating the sources'
    accuracies and mutual dependence over all groups.

    What matters of a field of a group is which sets of sources claim its values, so equal
    patterns are counted once. The driver sees sums per set of sources that occurs together: with
    the sources of source_of at most 2^18 rows.
    """
    sets = values.groupBy("g", "field", "sources").agg(F.count("*").alias("nv"))
    shape = sets.groupBy("g", "field").agg(F.sort_array(F.collect_list(F.struct("sources", "nv"))).alias("shape"))
    counted = shape.groupBy("shape").agg(F.count("*").alias("objects"))
    patterns = cut(counted.withColumn("id", F.xxhash64(F.col("shape").cast("string"))).select("id", "objects", F.explode("shape").alias("s")).select("id", "objects", "s.sources", "s.nv"))
    spark = values.sparkSession
    present: Counter = Counter()
    for r in patterns.groupBy("id", "objects").agg(F.bit_or("sources").alias("m")).groupBy("m").agg(F.sum("objects").alias("n")).collect():
        present[r["m"]] += r["n"]
    masks = sorted(r["sources"] for r in patterns.select("sources").distinct().collect())
    n = max((m.bit_length() for m in present), default=1)
    bits = np.array([[m >> k & 1 for k in range(n)] for m in masks], float).reshape(-1, n)
    whole = np.array([[m >> k & 1 for k in range(n)] for m in present], float).reshape(-1, n)
    both = (whole * np.array(list(present.values()), float).reshape(-1, 1)).T @ whole
    accuracy, dependent = np.full(n, 0.8), np.zeros((n, n))
    for turn in range(ROUNDS):
        votes = spark.createDataFrame(list(zip(masks, _votes(masks, accuracy, dependent))), "sources long, vote double")
        scored = patterns.join(F.broadcast(votes), "sources").withColumn("e", F.exp("vote"))
        total = scored.groupBy("id").agg(F.sum(F.col("nv") * F.col("e")).alias("total"))
        right = scored.join(total, "id").groupBy("sources").agg(F.sum(F.col("objects") * F.col("nv") * F.col("e") / F.col("total")).alias("right"), F.sum(F.col("objects") * F.col("nv")).alias("all"))
        sums = {r["sources"]: (r["right"], float(r["all"])) for r in right.collect()}
        true, every = (np.array([sums[m][i] for m in masks]) for i in (0, 1))
        if turn:  # the first votes count copies; accuracies wait until copies are discounted
            accuracy = np.clip((bits.T @ true + 8) / (bits.T @ every + 10), 0.05, 0.99)
        dependent = _dependence(accuracy, (bits * every[:, None]).T @ bits, (bits * (every - true)[:, None]).T @ bits, both)
    return dict(zip(masks, _votes(masks, accuracy, dependent)))


def survivors(members: DataFrame) -> DataFrame:
    """One row per group: ``first_record_id, best_record_id, n_records`` and, for every field, the
    value with the highest posterior probability and that probability as ``{field}_confidence``.

    best_record_id is the record the surviving row is built on; the fused values replace or
    complete its fields. A field without any value is null with null confidence; ties go to the
    value with more records, then the greater text. Sources' accuracies and copying are
    estimated from all groups. ``members`` is as from duplicate_members. The result is written to
    the shared folder, so that nothing asked of it is worked out without the fusion.
    """
    members = cut(members)
    values = cut(claimed_values(members))
    votes = estimate(values)
    table = members.sparkSession.createDataFrame(list(votes.items()), "sources long, vote double")
    scored = values.join(F.broadcast(table), "sources")
    best = [F.max(F.when(F.col("field") == i, F.struct("vote", "n", "value"))).alias(f"b{i}") for i in range(len(FIELDS))]
    mass = [F.sum(F.when(F.col("field") == i, F.exp("vote"))).alias(f"m{i}") for i in range(len(FIELDS))]
    fused = scored.groupBy("g").agg(*best, *mass)
    groups = members.groupBy("g").agg(F.max("rank").alias("rank"), F.count("*").alias("n_records"))
    columns = []
    for i, (name, _, kind) in enumerate(FIELDS):
        columns += [F.col(f"b{i}.value").cast(kind).alias(name), (F.exp(F.col(f"b{i}.vote")) / F.col(f"m{i}")).alias(f"{name}_confidence")]
    return cut(groups.join(fused, "g", "left").select(F.col("g").alias("first_record_id"), (-F.col("rank.id")).alias("best_record_id"), "n_records", *columns))
