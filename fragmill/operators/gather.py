"""Scatter and gather: shards of mapped fragments, checked, renumbered and deduplicated together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.plans.lineage import cut


def manifest(shards: DataFrame) -> DataFrame:
    """shard, n, contract of a table of shard rows; a row for each shard."""
    contract = F.first("contract") if "contract" in shards.columns else F.lit("v1")
    return shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), contract.alias("contract"))


def validate(found: DataFrame, expected: int) -> None:
    """Raises unless shards 0 to expected - 1 are there once each under one contract; only counts are collected."""
    r = found.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("shard").alias("n"), F.min("shard").alias("low"), F.max("shard").alias("high"), F.countDistinct("contract").alias("contracts")).first()
    if (r["rows"], r["n"], r["low"], r["high"], r["contracts"]) != (expected, expected, 0, expected - 1, 1):
        raise ValueError(f"the shards are not 0 to {expected - 1} under one contract: {r.asDict()}")


def prefix(found: DataFrame) -> DataFrame:
    """Adds first: the read number at which each shard starts. The window holds one row a shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def rebase(shards: DataFrame) -> DataFrame:
    """Adds read_id: the local one, counted on from the shards before."""
    firsts = prefix(manifest(shards)).select("shard", "first")
    return shards.join(F.broadcast(firsts), "shard").withColumn("read_id", F.col("first") + F.col("local_read_id")).drop("first")


def histograms(parts: DataFrame) -> DataFrame:
    """bc, abundance: shards' barcode counts summed."""
    return parts.groupBy("bc").agg(F.sum("abundance").alias("abundance"))


def rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds rank: 1 + the rows that come before in the given order; ties share it.

    Equal keys are counted first and dealt out by ranges of the order, so that no task holds all and no tie crowds
    one. A window over the ranges' totals, a row each, gives what comes before.
    """
    names = [f"_k{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)))
    keys = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(*names)
    keys = cut(keys.withColumn("shard", F.spark_partition_id()))
    starts = prefix(keys.groupBy("shard").agg(F.sum("_n").alias("n"))).select("shard", "first")
    before = Window.partitionBy("shard").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    ranks = keys.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(starts), "shard")
    ranks = ranks.select(*(F.col(n).alias(f"_{n}") for n in names), (F.col("first") + F.col("_before") + 1).alias("rank"))
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return keyed.join(ranks, same).select(*df.columns, "rank")
