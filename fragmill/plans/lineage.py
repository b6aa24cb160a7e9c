"""Cutting lineage where a plan reads its input more than once."""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in spark.checkpoint.dir, where all executors can read it; in a folder of the warehouse if unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def mounted_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below spark.checkpoint.dir, or below the warehouse if unset, in which workers write and map files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    at = urlparse(root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
    if at.scheme not in ("", "file"):
        raise ValueError(f"workers map files there: spark.checkpoint.dir must be a mounted folder, not {root}")
    return f"{(unquote(at.path) if at.scheme else at.path).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
