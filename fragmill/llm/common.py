"""What the training-text operators share: reading, Arrow mapping, shared folders.

Tables are documents(doc_id, text, ...). Operators name the columns they need and
return their own; further columns of an input, whatever their names, are left out
unless a docstring says otherwise.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most, and where Spark has that number.
BATCH_ROWS, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir; where that is unset (tests), below a folder of the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def remove_folder(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, uri: str) -> DataFrame:
    """df as written to and reread from uri: lineage ends here, and lost executors cost nothing."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    return own_names((name,), df.columns)[0]


def own_names(names: tuple[str, ...], others: tuple[str, ...] | list[str]) -> list[str]:
    """The names, each with as many underscores behind it as tell it from the others, in either case of letters."""
    taken, out = {x.lower() for x in others}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a table that may be sent to every task, and copies of a larger one's rows that share a hot key's partners.
FEW, SALTS = 200_000, 16


def join_few(big: DataFrame, small: DataFrame, keys: list[str], then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The inner join of a table in which few keys may hold most rows with one that has each key once (staged: it is
    counted first), and `then` of it.

    Up to FEW rows are broadcast. More are repeated SALTS times, so that a key's rows meet in so many tasks; where
    `then` sums up by the keys alone, that is done first and the sums are joined.
    """
    n = small.count()
    if n <= FEW:
        out = big.join(F.broadcast(small), keys)
        return then(out) if then else out
    if then:
        return then(big).join(small, keys)
    salt = unused(small, unused(big, "salt"))
    left = big.withColumn(salt, F.pmod(F.xxhash64(F.lit(0), *(c for c in big.columns if c not in keys)), F.lit(SALTS)))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return left.join(right, [*keys, salt]).drop(salt)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_rows(df: DataFrame, columns: list[str | Column], schema: str, per_batch: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """mapInArrow over chosen columns, which per_batch finds by place; it returns the output's columns by name.

    Texts may be long, and both sides of the pipe hold a batch or two, so the session's batches are made of
    at most BATCH_ROWS rows.
    """
    if int(df.sparkSession.conf.get(BATCH_CONF)) not in range(1, BATCH_ROWS + 1):
        df.sparkSession.conf.set(BATCH_CONF, str(BATCH_ROWS))
    df = df.select(*columns)
    df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # the input may repeat names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, BATCH_ROWS):
                out = per_batch(batch.slice(part, BATCH_ROWS))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=list(out))

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, where: Column, limit: int, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> list:
    """At most `limit` rows by the order of a hash of their id: a fit's documented bound.

    Only ids cross to the driver first; then only the chosen rows' texts do.
    """
    ids = [r[0] for r in df.where(where).select(F.col(id_col).alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(limit).collect()]
    if not ids:
        return []
    name = unused(df, "chosen_id")
    chosen = df.sparkSession.createDataFrame([(i,) for i in ids], f"{name} long")
    rows = df.where(where).join(F.broadcast(chosen), F.col(id_col) == F.col(name), "left_semi")
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    return rows.orderBy("id", F.xxhash64("text")).limit(limit).collect()


_RESIDENT: dict = {}


def resident(key: object, make: Callable):
    """What a worker keeps between tasks. Workers serve one operator after another, so only the last one's
    tables stay; another key frees them first."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an unsigned array."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes(dict):
    """xxh3 of byte strings, kept for up to `most` of them."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
