"""FASTA and FASTQ files as a Python data source: `spark.read.format("fastx").load(path)`.

A file is a partition, as gzip can't be split; a lane's files number its reads from 0. Multi-line records
are read; records without bases don't count; a file that ends inside a record raises.
"""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, lane int, read_id long, name string, comment string, seq string, qual string"


def expand(paths: str) -> list[str]:
    """Comma-separated paths with ~ and wildcards, in order; one that matches nothing raises."""
    out: list[str] = []
    for p in paths.split(","):
        found = sorted(glob.glob(os.path.expanduser(p.strip().removeprefix("file://"))))
        if not found:
            raise FileNotFoundError(p)
        out += found
    return out


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, bases, qualities or None) from a file's lines."""
    lines = (x.rstrip("\r\n") for x in lines)
    head = next((x for x in lines if x), None)
    while head is not None:
        if head[0] not in ">@":
            raise ValueError(f"not a record: {head[:40]!r}")
        name, _, comment = head[1:].partition(" ")
        bases, then = [], None
        for x in lines:
            if x[:1] in (">", "@", "+"):
                then = x
                break
            bases.append(x.strip())
        seq, qual = "".join(bases), None
        if then is not None and then[0] == "+":
            qual = ""
            while len(qual) < len(seq):
                x = next(lines, None)
                if x is None:
                    raise ValueError(f"the file ends inside {name!r}")
                qual += x
            if len(qual) != len(seq):
                raise ValueError(f"{name!r} has {len(seq)} bases and {len(qual)} qualities")
            then = next((x for x in lines if x), None)
        elif head[0] == "@":
            raise ValueError(f"the file ends inside {name!r}")
        if seq:
            yield name, comment, seq, qual
        head = then


class _File(InputPartition):
    def __init__(self, path: str, lane: int):
        self.path, self.lane = path, lane


class _Reader(DataSourceReader):
    def __init__(self, paths: str):
        self.paths = paths

    def partitions(self) -> list[_File]:
        return [_File(p, i) for i, p in enumerate(expand(self.paths))]

    def read(self, partition: _File) -> Iterator[tuple]:
        opener = gzip.open if partition.path.endswith(".gz") else open
        with opener(partition.path, "rt") as f:
            for i, (name, comment, seq, qual) in enumerate(records(f)):
                yield partition.path, partition.lane, i, name, comment, seq, qual


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read(spark: SparkSession, paths: str) -> DataFrame:
    """Files that the executors can open."""
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").load(paths)


def zip_lanes(read1: DataFrame, *others: DataFrame, names: bool = False) -> DataFrame:
    """Lanes read in step, by lane and number: seq, seq2, ... A lane of unequal counts raises.

    names: reads of a place must have one name, up to a mate's `/1`, and none may be empty; else the rows raise when
    they are computed. Only lanes' counts, a row for each file, come to the driver.
    """
    counted = lambda df: {r["lane"]: r["n"] for r in df.groupBy("lane").agg(F.count(F.lit(1)).alias("n")).collect()}
    out, n = read1.select("lane", "read_id", "name", "seq", "qual"), counted(read1)
    bare = lambda c: F.regexp_replace(c, "/[0-9]$", "")
    for i, df in enumerate(others, 2):
        if (m := counted(df)) != n:
            raise ValueError(f"numbers of reads and barcodes don't match: {sorted(n.items())} and {sorted(m.items())} by lane")
        side = df.select("lane", "read_id", F.col("seq").alias(f"seq{i}"), F.col("qual").alias(f"qual{i}"), *([F.col("name").alias("_name")] if names else []))
        out = out.join(side, ["lane", "read_id"])
        if names:
            same = (bare("name") == bare("_name")) & (F.length(bare("name")) > 0)
            text = F.concat(F.lit("names don't match: "), F.coalesce("name", F.lit("")), F.lit(" and "), F.coalesce("_name", F.lit("")))
            out = out.withColumn("name", F.when(F.coalesce(same, F.lit(False)), F.col("name")).otherwise(F.raise_error(text))).drop("_name")
    return out


def reference(spark: SparkSession, path: str) -> DataFrame:
    """rid, name, length, seq, crc of a FASTA file's contigs in order."""
    return read(spark, path).select(F.col("read_id").alias("rid"), "name", F.length("seq").alias("length"), F.upper("seq").alias("seq"), F.crc32(F.upper("seq")).alias("crc"))


def fingerprint(ref: DataFrame) -> DataFrame:
    """n, bases and an order-free digest of a reference."""
    return ref.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bases"), F.bit_xor(F.xxhash64("rid", "name", "crc")).alias("digest"))
