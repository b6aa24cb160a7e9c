"""Shards that arrive over time: counted with watermarks, or appended and gathered again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fragmill.operators import dedup

SHARD = "shard long, read_id long, chrom string, start long, len long, bc long, mapq long, dir long, uniq int, pos_len int, neg_len int, arrived timestamp"


def read_shards(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """Parquet shards as they come, at most so many files a batch."""
    return spark.readStream.schema(SHARD).option("maxFilesPerTrigger", files).parquet(path)


def live_counts(shards: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """window, bc, n of arrived fragments; rows later than `late` don't count."""
    return shards.withWatermark("arrived", late).groupBy(F.window("arrived", window), "bc").agg(F.count(F.lit(1)).alias("n"))


def first_copies(shards: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first row of each fragment as it arrives; keys are forgotten after `late`, so state stays bounded."""
    return shards.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["chrom", "start", "len", "bc"])


def gather_into(shards: DataFrame, store: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to store once (a batch's folder is overwritten when it is retried) and rewrites the
    deduplicated whole at out."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.drop("arrived").write.mode("overwrite").parquet(f"{store}/batch={number}")
        whole = spark.read.parquet(store).drop("batch", "shard")
        dedup.dedup(whole).write.mode("overwrite").parquet(out)

    return shards.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
