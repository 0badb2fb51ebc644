"""Problem 7: texts into fixed-capacity containers, shortest pack first over the length histogram."""

from __future__ import annotations

import base64
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.storage import broadcast_if, cut, spread

CAPACITY = 4096
#: Pieces of one length that are ranked together; a hot length has as many parts as it needs.
PART_ROWS = 1 << 17
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public byte-level vocabulary's splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of every document; a null text has null, an empty one 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for b in batches:
            sizes = [None if not t.is_valid else len(encode(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(count, "doc_id long, n_tokens long")


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, how many containers)``: longest lengths first, each into the open pack with
    the most room left; a new pack is begun only if the length fits none.

    Works on counts: one step places as many items as there are equal packs. Every length adds
    at most two patterns, so there are at most 2 x capacity of them.
    """
    open_packs: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, count]
    rooms: list[int] = []  # heap of -room

    def put(room: int, pattern: tuple, n: int) -> None:
        if not open_packs[room]:
            heapq.heappush(rooms, -room)
        open_packs[room].append([pattern, n])

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left = histogram[length]
        while left:
            while rooms and not open_packs[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else -1
            if room < length:
                put(capacity - length, (None, length), left)
                break
            pack = open_packs[room][-1]
            n = min(left, pack[1])
            pack[1] -= n
            if not pack[1]:
                open_packs[room].pop()
            put(room - length, (pack[0], length), n)
            left -= n
    done: Counter = Counter()
    for packs in open_packs.values():
        for pattern, n in packs:
            lengths = []
            while pattern:
                pattern, length = pattern
                lengths.append(length)
            done[tuple(reversed(lengths))] += n
    return sorted(done.items(), reverse=True)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, ``(first rank, end rank, first container, items per container)``."""
    slots: dict[int, list] = defaultdict(list)
    taken: Counter = Counter()
    base = 0
    for lengths, n in patterns:
        for length, each in Counter(lengths).items():
            slots[length].append((taken[length], taken[length] + n * each, base, each))
            taken[length] += n * each
        base += n
    return slots


def pack(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens, container_id`` from ``doc_id, n_tokens``.

    A text within the capacity is one piece; a longer one is cut into full pieces and a rest.
    Null and zero counts take no container. Ties are placed in doc_id order within parts of a
    length, so the result depends on the data alone. Repeated doc_ids are packed each by
    itself. Other columns are ignored.

    The driver sees the length histogram and the sizes of the parts: capacity + pieces / PART_ROWS
    rows at most. Patterns go back to the pieces by one row per part, which holds the patterns of
    its ranks only: the rank among equal lengths is counted within a part of about PART_ROWS
    pieces and shifted by the parts before. The placement is written to the shared folder, so that
    nothing asked of it is worked out without it.
    """
    spark = counts.sparkSession
    full = F.floor((F.col("n_tokens") - 1) / capacity)
    pieces = cut(
        counts.filter("n_tokens > 0")
        .select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), full)).alias("piece"))
        .select("doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.col("n_tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size"))
    )
    histogram = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    parts = [(size, max(1, -(-n // PART_ROWS))) for size, n in histogram.items()]
    parts_of = spark.createDataFrame(parts, "size int, n_parts int")
    pieces = pieces.join(F.broadcast(parts_of), "size").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("n_parts")).cast("int")).drop("n_parts")
    seen: dict[int, dict[int, int]] = defaultdict(dict)
    for r in pieces.groupBy("size", "part").count().collect():
        seen[r["size"]][r["part"]] = r["count"]
    slots = _slots(pack_lengths(histogram, capacity))
    rows = []
    for size, of in seen.items():
        ahead, k = 0, 0
        for part in sorted(of):
            end = ahead + of[part]
            while slots[size][k][1] <= ahead:
                k += 1
            j = k
            while j < len(slots[size]) and slots[size][j][0] < end:
                j += 1
            rows.append((size, part, ahead, slots[size][k:j]))
            ahead = end
    plan = spark.createDataFrame(rows, "size int, part int, ahead long, slots array<struct<first: long, end: long, base: long, each: long>>")
    rank = F.row_number().over(W.partitionBy("size", "part").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("rank", rank).join(broadcast_if(plan, sum(len(r[3]) for r in rows), 64), ["size", "part"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    slot = F.get(F.filter("slots", lambda s: (s.first <= F.col("rank")) & (F.col("rank") < s.end)), 0)
    return cut(ranked.withColumn("slot", slot).select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.col("size").alias("n_tokens"),
        (F.col("slot.base") + F.floor((F.col("rank") - F.col("slot.first")) / F.col("slot.each"))).alias("container_id"),
    ))
