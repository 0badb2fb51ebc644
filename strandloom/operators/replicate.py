"""Fragment-replicate join: bin-packed keys, split heavy keys, matching rows copied to shards only."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hash buckets whose loads are counted; all that the driver learns of light keys.
BUCKETS = 4096
#: A shard's load, as a share of a task's fair load.
SHARD_SHARE = 0.25


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def plan_loads(left: DataFrame, key: str, tasks: int) -> tuple[list[tuple[int, int]], list[tuple[object, list[int]]]]:
    """``(bucket, task)`` of every bucket of light keys and ``(key, tasks)`` of every heavy key.

    Loads are counted over all rows: first by hash bucket (BUCKETS rows reach the driver), then
    by key within buckets above one shard's load, of which only keys above that load are
    fetched - at most tasks / SHARD_SHARE keys. A heavy key is split into as many shards as its
    load fills; shards and buckets go to the least loaded task, largest first.
    """
    rows = left.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    loads = {r.b: r.n for r in rows.groupBy(_bucket(F.col("k")).alias("b")).agg(F.count("*").alias("n")).collect()}
    shard = max(1.0, SHARD_SHARE * sum(loads.values()) / tasks)
    suspects = [b for b, n in loads.items() if n > shard]
    heavy = []
    if suspects:
        inside = rows.filter(_bucket(F.col("k")).isin(suspects))
        heavy = inside.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > shard).withColumn("b", _bucket(F.col("k"))).collect()
    items: list[tuple[float, object, object]] = []
    for r in heavy:
        loads[r.b] -= r.n
        parts = -int(-r.n // shard)
        items += [(r.n / parts, "key", r.k)] * parts
    items += [(loads.get(b, 0), "bucket", b) for b in range(BUCKETS)]
    bins = [(0.0, t) for t in range(tasks)]
    light, shards = [], {}
    for load, kind, what in sorted(items, key=lambda x: (-x[0], x[1], str(x[2]))):
        used, t = heapq.heappop(bins)
        heapq.heappush(bins, (used + load, t))
        if kind == "key":
            shards.setdefault(what, []).append(t)
        else:
            light.append((what, t))
    return light, list(shards.items())


def _routed(df: DataFrame, key: str, light: DataFrame, heavy: DataFrame) -> DataFrame:
    """Adds ``__task`` (for light keys) and ``__shards`` (tasks of a heavy key, else null)."""
    rows = df.withColumn("__bucket", _bucket(F.col(key)))
    return rows.join(F.broadcast(heavy), rows[key] == heavy["__heavy"], "left").join(F.broadcast(light), "__bucket", "left").drop("__heavy", "__bucket")


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """``left`` with the other columns of ``right`` by ``key`` (left join), plus ``__task``.

    ``right`` holds at most one row per key. Null keys match nothing and their rows are kept,
    spread over all tasks. The result is partitioned by ``__task``: an aggregate by
    ``__task`` and more columns needs no further shuffle. Rows of a key that alone fills more than one shard of a
    task's fair load are split over several tasks by a hash of the row, and the matching
    right row is copied to those tasks only; give ``left`` a column that tells rows apart. The two broadcasts are bounded: BUCKETS rows, and
    at most tasks / SHARD_SHARE heavy keys. A column of ``right`` whose name ``left`` has too gets
    ``_right`` appended.
    """
    taken = set(left.columns)
    for c in [c for c in right.columns if c != key and c in taken]:
        name = c
        while name in taken or name in right.columns:
            name += "_right"
        right, taken = right.withColumnRenamed(c, name), taken | {name}
    others = [c for c in right.columns if c != key]
    spark = left.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    light, heavy = plan_loads(left, key, tasks)
    kind = left.schema[key].dataType.simpleString()
    light_df = spark.createDataFrame(light, "__bucket int, __task int")
    heavy_df = spark.createDataFrame(heavy, f"__heavy {kind}, __shards array<int>")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(1 << 30)).cast("int")
    packed = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    a = _routed(left, key, light_df, heavy_df).select(
        F.coalesce(F.get("__shards", spread % F.size("__shards")), F.col("__task"), spread % F.lit(tasks)).alias("__task"),
        F.col(key).alias("__key"),
        packed.alias("__left"),
        F.lit(None).cast(right.select(F.struct(*[F.col(f"`{c}`") for c in others])).schema[0].dataType).alias("__right"),
    )
    b = (
        _routed(right.filter(F.col(key).isNotNull()), key, light_df, heavy_df)
        .withColumn("__task", F.explode(F.coalesce(F.col("__shards"), F.array("__task"))))
        .select("__task", F.col(key).alias("__key"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("__right"))
    )
    over = W.partitionBy("__task", "__key").orderBy(F.col("__right").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    match = F.first("__right").over(over)  # the right row sorts first; no frame buffers the key's rows
    placed = a.unionByName(b).repartitionById(tasks, F.col("__task"))
    joined = placed.withColumn("__match", match).filter("__left IS NOT NULL")
    return joined.select("__task", *[F.col("__left")[c].alias(c) for c in left.columns], *[F.col("__match")[c].alias(c) for c in others])

