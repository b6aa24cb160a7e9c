"""The minimizer index and the reference as Parquet, with the reference's fingerprint beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.operators.mapping import build_index
from fragmill.sources.fastx import fingerprint

INDEX = "hash long, rid long, pos int, strand int, n_occ long"


def save(ref: DataFrame, path: str, k: int = 17, w: int = 7) -> None:
    """index (sorted by hash, so that a join's keys prune row groups), reference and layout of ref(rid, name, length, seq, crc)."""
    if not 0 < k <= 28 or not 0 < w < 256:
        raise ValueError("k must be 1 to 28 and w 1 to 255")
    build_index(ref, k, w).repartitionByRange("hash").sortWithinPartitions("hash", "rid", "pos").write.mode("overwrite").parquet(f"{path}/index")
    ref.write.mode("overwrite").parquet(f"{path}/reference")
    fingerprint(ref).withColumns({"k": F.lit(k), "w": F.lit(w)}).write.mode("overwrite").parquet(f"{path}/layout")


def load(spark: SparkSession, path: str, ref: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """index, reference, k, w. A ref other than the indexed one raises."""
    layout = spark.read.parquet(f"{path}/layout").first()
    stored = spark.read.parquet(f"{path}/reference")
    if ref is not None and fingerprint(ref).first()["digest"] != layout["digest"]:
        raise ValueError("the index is of another reference")
    return spark.read.schema(INDEX).parquet(f"{path}/index"), stored, layout["k"], layout["w"]
