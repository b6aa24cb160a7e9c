"""Operator 2: lines that many documents share, found with levelled sorted runs.

Runs are tables of line hashes in the shared folder, dealt by hash into the same number of
files and sorted within them, so that Spark merges any two without a shuffle. A batch of
documents turns into line hashes with counts of documents. A merge anti-join with each run
leaves out the lines that it knows to be frequent and adds what it has counted of the
others, which tells the lines that have become frequent; the batch is added as a run. Two
runs of a level are compacted into one of the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.llm.common import join_few, map_rows, own_names, remove_folder, shared_folder, staged, texts

#: What a one-off call deals the documents into.
BATCHES = 4


def key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip(b" \t\n\r\x0b\x0c").lower()


def _hashes(k: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(k)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def line_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 1) -> DataFrame:
    """doc_id, t (the text's hash), h1, h2: a row for each distinct key of each row's text, of at least least_chars code points."""

    def batch(b: pa.RecordBatch) -> dict:
        out: tuple[list, ...] = ([], [], [], [])
        for i, text, t in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist(), strict=True):
            for k in {key(x) for x in text.split(b"\n")}:
                if k and (least_chars <= 1 or len(k.decode()) >= least_chars):
                    for column, value in zip(out, (i, t, *_hashes(k)), strict=True):
                        column.append(value)
        return {name: pa.array(x, pa.int64()) for name, x in zip(("doc_id", "t", "h1", "h2"), out, strict=True)}

    return map_rows(df, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _hash_of(text_col).alias("t")], "doc_id long, t long, h1 long, h2 long", batch)


def _hash_of(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


class LineRuns:
    """Counts of documents by line, kept as runs in the shared folder; only the runs' places are on the driver.

    A run is a table h1, h2, n, total: n documents that its batches have, total with what had come before. Where the
    total has reached min_docs a row is frequent, and later batches leave its line out: a line is frequent in one run only.
    """

    #: Lets Spark rely on the order of a file that is all of its bucket.
    ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = shared_folder(spark, "line_runs")
        self.levels: dict[int, list[str]] = {}

    @contextmanager
    def _ordered(self) -> Iterator[None]:
        before = self.spark.conf.get(self.ORDERED, None)
        self.spark.conf.set(self.ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(self.ORDERED) if before is None else self.spark.conf.set(self.ORDERED, before)

    def _write(self, df: DataFrame) -> str:
        """A run's name. Tasks must hold a bucket each, so that each bucket is one file."""
        name = f"line_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def names(self) -> list[str]:
        return [x for found in self.levels.values() for x in found]

    def _totals(self, keys: DataFrame) -> DataFrame:
        """h1, h2, n, total of a batch's lines that the runs don't know as frequent.

        One merge join with each run is its anti-join, as lines that it holds as frequent go, and adds what it counts of
        the others. As an anti-join of its own Catalyst would push it below the counting, where a line has all its rows.
        """
        counted = keys.select("doc_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        # dealt and sorted as the runs' buckets are, so that the batch is merged as it stands
        out = counted.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2").withColumn("total", F.col("n"))
        for name in self.names():
            run = self.spark.table(name).select("h1", "h2", F.col("n").alias("more"), F.col("total").alias("before"))
            out = out.join(run.hint("merge"), ["h1", "h2"], "left").where(F.col("before").isNull() | (F.col("before") < self.min_docs))
            out = out.select("h1", "h2", "n", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
        return out

    def add(self, keys: DataFrame) -> None:
        """keys(doc_id, h1, h2) of a batch; a document must not be spread over batches."""
        with self._ordered():
            self.levels.setdefault(0, []).append(self._write(self._totals(keys)))
            self._compact()

    def _compact(self) -> None:
        """Merges two runs of a level into one of the next."""
        level = 0
        while len(self.levels.get(level, ())) > 1:
            a, b = self.levels.pop(level)
            side = lambda x, k: self.spark.table(x).select("h1", "h2", F.col("n").alias(f"n{k}"), F.col("total").alias(f"total{k}"))
            both = side(a, 1).join(side(b, 2).hint("merge"), ["h1", "h2"], "full")
            n = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
            self.levels.setdefault(level + 1, []).append(self._write(both.select("h1", "h2", n.alias("n"), F.greatest("total1", "total2").alias("total"))))
            self._drop(a)
            self._drop(b)
            level += 1

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table {name}")
        remove_folder(self.spark, f"{self.folder}/{name}")

    def frequent(self) -> DataFrame:
        """h1, h2 of the lines in min_docs documents or more, each once."""
        runs = [self.spark.table(x).where(F.col("total") >= self.min_docs).select("h1", "h2") for x in self.names()]
        return reduce(DataFrame.unionByName, runs) if runs else self.spark.createDataFrame([], "h1 long, h2 long")

    def close(self) -> None:
        for name in self.names():
            self._drop(name)
        self.levels = {}


def drop_frequent(df: DataFrame, min_docs: int = 10, least_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), batches: int = BATCHES) -> DataFrame:
    """doc_id, text, n_lines, n_dropped of each row, and the columns in keep.

    A line whose key at least min_docs documents hold loses all its occurrences; the others stay, joined
    by \\n. A null or empty text is one empty line, which stays; empty keys are never frequent. Texts of any length
    are taken whole. Rows with the same id (null is an id too) are one document when lines are counted, and each
    is returned, repeated ones as often as they came. An empty table stays empty. Other columns are left out; where
    keep has a column n_lines or n_dropped, the operator's own gets underscores behind its name.
    """
    spark = df.sparkSession
    runs = LineRuns(spark, min_docs)
    batch_of = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    line_keys(df, id_col, text_col, least_chars).withColumn("batch", batch_of).write.partitionBy("batch").parquet(f"{runs.folder}/keys")
    keys = spark.read.schema("doc_id long, t long, h1 long, h2 long, batch int").parquet(f"{runs.folder}/keys")
    for i in range(batches):
        runs.add(keys.where(F.col("batch") == i))
    frequent = staged(runs.frequent(), f"{runs.folder}/frequent")
    runs.close()
    gone = join_few(keys.drop("batch"), frequent, ["h1", "h2"]).groupBy("doc_id", "t").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    gone = gone.toDF("gone_id", "gone_t", "gone")
    kinds = dict(df.dtypes)
    rows = df.select(F.col(id_col).cast("long"), F.col(text_col), _hash_of(text_col), *keep)
    rows = rows.toDF(*(f"c{i}" for i in range(3 + len(keep))))
    rows = rows.join(gone.hint("shuffle_hash"), F.col("c0").eqNullSafe(F.col("gone_id")) & (F.col("c2") == F.col("gone_t")), "left")
    n_lines, n_dropped = own_names(("n_lines", "n_dropped"), keep)

    def batch(b: pa.RecordBatch) -> dict:
        out, all_lines, dropped = [], [], []
        for text, gone in zip(texts(b.column(1)), b.column(2).to_pylist(), strict=True):
            found = text.split(b"\n")
            gone = {(g["h1"], g["h2"]) for g in gone or ()}
            kept = [x for x in found if not (k := key(x)) or _hashes(k) not in gone] if gone else found
            out.append(b"\n".join(kept))
            all_lines.append(len(found))
            dropped.append(len(found) - len(kept))
        base = {"doc_id": b.column(0), "text": pa.array(out, pa.binary()).cast(pa.string()), n_lines: pa.array(all_lines, pa.int64()), n_dropped: pa.array(dropped, pa.int64())}
        return base | {k: b.column(3 + i) for i, k in enumerate(keep)}

    schema = ", ".join([f"doc_id long, text string, {n_lines} long, {n_dropped} long", *(f"`{k}` {kinds[k]}" for k in keep)])
    return map_rows(rows, ["c0", "c1", "gone", *(f"c{3 + i}" for i in range(len(keep)))], schema, batch)
