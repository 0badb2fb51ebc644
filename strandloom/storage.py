"""Table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table of known row count is broadcast; beyond, it is joined by shuffle.
BROADCAST_BYTES = 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan ahead of heavy work, over all cores if its files are too few to occupy them. On a
    large input, which has more splits than there are cores, nothing is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def likely_tasks(df: DataFrame) -> int:
    """About how many tasks a plan's output comes from, by the optimizer's size; runs nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(split[-1], 1)
    return max(1, size // (int(split.rstrip("kmg")) * unit))


def broadcast_if(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for a broadcast if ``rows`` counted rows of about ``row_bytes`` are within
    BROADCAST_BYTES; a larger one is left to shuffled joins."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The application's folder below the shared one the cluster names in spark.checkpoint.dir;
    only a local session without that setting gets a folder of its own."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again: later steps
    neither repeat its work nor depend on the executors that computed it, and scan only the
    columns they need."""
    at = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
