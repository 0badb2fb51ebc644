"""FASTA and FASTQ as a Spark data source, and ordinal joins of parallel files."""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: read_id = place of the file in the list x FILE_STEP + place of the record in the file.
FILE_STEP = 1 << 40
#: Records of one range of a split file; a file has up to FILE_STEP / RANGE_STEP ranges.
RANGE_STEP = 1 << 28
ROWS = 8192
SCHEMA = "read_id long, file_idx int, name string, comment string, seq string, qual string"
ARROW = pa.schema([("read_id", pa.int64()), ("file_idx", pa.int32()), ("name", pa.string()), ("comment", pa.string()), ("seq", pa.string()), ("qual", pa.string())])


def expand(paths: str) -> list[str]:
    """Files of a comma-separated list of paths and patterns, in list order; no match is an error."""
    found: list[str] = []
    for part in filter(None, (p.strip() for p in paths.split(","))):
        some = sorted(glob.glob(os.path.expanduser(part)))
        if not some:
            raise FileNotFoundError(f"no file matches {part}")
        found += some
    return found


def records(lines: Iterator[str], where: str = "input") -> Iterator[tuple[str, str | None, str, str | None]]:
    """Name, comment, bases and qualities of FASTA or FASTQ lines; both may run over several lines.

    Blank lines between records are skipped. A quality of another length than its bases, or one
    that breaks off, is an error; the quality of a FASTA record is null.
    """
    line = next(lines, None)
    while line is not None:
        line = line.rstrip("\r\n")
        if not line:
            line = next(lines, None)
            continue
        if line[0] not in ">@":
            raise ValueError(f"{where}: a record begins with {line[:20]!r}")
        name, _, comment = line[1:].replace("\t", " ", 1).partition(" ")
        bases: list[str] = []
        line = next(lines, None)
        while line is not None and line[:1] not in (">", "@", "+"):
            bases.append(line.strip())
            line = next(lines, None)
        seq = "".join(bases)
        if line is None or line[0] != "+":
            yield name, comment or None, seq, None
            continue
        quals, n = [], 0
        while n < len(seq) or not quals:
            part = next(lines, None)
            if part is None:
                if n == len(seq):
                    break
                raise ValueError(f"{where}: the quality of {name} breaks off")
            quals.append(part.rstrip("\r\n"))
            n += len(quals[-1])
        if n != len(seq):
            raise ValueError(f"{where}: bases and quality of {name} differ in length")
        yield name, comment or None, seq, "".join(quals)
        line = next(lines, None)


@dataclass
class _File(InputPartition):
    path: str
    file_idx: int
    number: int = 0
    start: int = 0
    end: int | None = None


def _begin(f: BinaryIO, start: int) -> int:
    """Offset of the first record at or behind ``start`` of a FASTA file or a FASTQ file of four lines a
    record. Of the lines there, a FASTQ record begins with the one after which two lines on a plus
    sign stands and whose bases are as many as its qualities; a quality line never looks so."""
    fasta = f.read(1) == b">"
    f.seek(max(0, start - 1))
    if start:
        f.readline()
    at, held = [f.tell()], []
    while True:
        line = f.readline()
        if not line:
            return at[-1]
        if fasta:
            if line[:1] == b">":
                return at[-1]
            at.append(f.tell())
            continue
        held.append(line.rstrip(b"\r\n"))
        at.append(f.tell())
        if len(held) >= 4:
            a, b, c, d = held[-4:]
            if a[:1] == b"@" and c[:1] == b"+" and len(b) == len(d):
                return at[-5]
        if len(held) > 8:
            raise ValueError("no record of four lines; read this file without splitting")


def _lines(f: BinaryIO, start: int, end: int) -> Iterator[str]:
    """Lines of the records that begin in [start, end)."""
    stop = _begin(f, end)
    f.seek(0)
    first = _begin(f, start) if start else 0
    f.seek(first)
    while f.tell() < stop:
        line = f.readline()
        if not line:
            return
        yield line.decode("latin-1")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = expand(options["path"])
        self.split = int(options.get("splitbytes", options.get("splitBytes", 0)))

    def partitions(self) -> list[_File]:
        parts = []
        for i, path in enumerate(self.files):
            size = os.path.getsize(path)
            if not self.split or size <= self.split or _packed(path):
                parts.append(_File(path, i))
                continue
            step = max(self.split, -(-size // (FILE_STEP // RANGE_STEP)))
            parts += [_File(path, i, n, at, min(size, at + step)) for n, at in enumerate(range(0, size, step))]
        return parts

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        ranged = partition.end is not None
        opener = open if ranged or not _packed(partition.path) else gzip.open
        with opener(partition.path, "rb") if ranged else opener(partition.path, "rt", encoding="latin-1") as f:
            lines = _lines(f, partition.start, partition.end) if ranged else f
            base = partition.file_idx * FILE_STEP + partition.number * RANGE_STEP
            rows = []
            for i, (name, comment, seq, qual) in enumerate(records(lines, partition.path)):
                rows.append((base + i, partition.file_idx, name, comment, seq, qual))
                if len(rows) == ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def _packed(path: str) -> bool:
    with open(path, "rb") as head:
        return head.read(2) == b"\x1f\x8b"


class FastxSource(DataSource):
    """``spark.read.format("fastx").load("a.fq.gz,lane*.fq")``: one task per file, read as a stream.
    With the option ``splitBytes``, plain files are read in ranges of so many bytes; a record's number
    then begins anew in every range, which read_fastx puts right. Files must lie where every
    executor can open them."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_fastx(spark: SparkSession, paths: str, split_bytes: int = 0) -> DataFrame:
    """Records of FASTA or FASTQ files, gzipped or not, in any mix.

    With ``split_bytes``, files that are not gzipped are read by several tasks each, in ranges of
    about so many bytes; FASTQ records must then have four lines. Records are counted per range
    first (one row per range), so that read_id is the same as without.
    """
    spark.dataSource.register(FastxSource)
    if not split_bytes:
        return spark.read.format("fastx").load(paths)
    rows = spark.read.format("fastx").option("splitBytes", split_bytes).load(paths)
    part = F.floor(F.col("read_id") / RANGE_STEP)
    counts = rows.select("file_idx", part.alias("part")).groupBy("file_idx", "part").agg(F.count("*").alias("n"))
    ahead = counts.select("part", F.coalesce(F.sum("n").over(W.partitionBy("file_idx").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    joined = rows.withColumn("part", part).join(F.broadcast(ahead), "part")
    return joined.select((F.col("file_idx").cast("long") * FILE_STEP + F.col("ahead") + F.col("read_id") % RANGE_STEP).alias("read_id"), "file_idx", "name", "comment", "seq", "qual")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """``rid, ref_name, length, seq`` of a reference; empty records are skipped, rid counts the others."""
    rows = read_fastx(spark, path).filter("length(seq) > 0")
    rid = F.row_number().over(W.orderBy("read_id")) - 1  # sequences of one genome
    names = rows.select("read_id", "name").withColumn("rid", rid.cast("int"))
    return rows.drop("name").join(names, "read_id").select("rid", F.col("name").alias("ref_name"), F.length("seq").alias("length"), "seq")


def zip_reads(first: DataFrame, second: DataFrame | None = None, barcodes: DataFrame | None = None) -> DataFrame:
    """Reads of parallel files by ordinal: ``read_id, name, seq`` (or ``seq1, seq2``), ``qual...``,
    ``barcode, barcode_qual``. Names are not compared; unequal numbers of records are an error."""
    sides = [("1" if second is not None else "", first), *([("2", second)] if second is not None else [])]
    out = None
    for tag, df in sides:
        part = df.select("read_id", *([F.col("name")] if out is None else []), F.col("seq").alias(f"seq{tag}"), F.col("qual").alias(f"qual{tag}"), F.lit(True).alias(f"in{tag}"))
        out = part if out is None else out.join(part, "read_id", "full")
    marks = [f"in{t}" for t, _ in sides]
    if barcodes is not None:
        out = out.join(barcodes.select("read_id", F.col("seq").alias("barcode"), F.col("qual").alias("barcode_qual"), F.lit(True).alias("inb")), "read_id", "full")
        marks.append("inb")
    whole = F.lit(True)
    for m in marks:
        whole = whole & F.col(m).isNotNull()
    return out.withColumn("read_id", F.when(whole, F.col("read_id")).otherwise(F.raise_error(F.lit("numbers of reads and barcodes differ")).cast("long"))).drop(*marks)
