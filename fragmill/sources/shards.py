"""Shards of mapped fragments that workers write apart and one run gathers.

A shard has its fragments before deduplication, a histogram of the barcodes that it read cleanly, and evidence: every
read with its raw barcode, mapped or not. Its manifest row is written last, so a shard without one is not whole.
Gathering sums the histograms, corrects barcodes by them, and only then deduplicates and counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.operators import barcode, dedup, gather, qc
from fragmill.plans.lineage import cut
from fragmill.presets import Parameters

PARTS = ("rows", "histogram", "evidence")
MANIFEST = "shard long, contract string, n long, n_rows long"


def write(frags: DataFrame, reads: DataFrame, path: str, shard: int, contract: str) -> None:
    """frags(local_read_id, chrom, start, ...) and reads(local_read_id, bc, qual, cachehit) of a shard, numbered from 0.

    contract says what all shards must share: the reference, the parameters, the whitelist.
    """
    spark, reads = frags.sparkSession, cut(reads.select("local_read_id", "bc", "qual", "cachehit"))
    clean = reads.where(~F.contains("bc", F.lit("N"))).groupBy("bc").agg(F.count(F.lit(1)).alias("abundance"))
    order = ["chrom", "start", "len", "local_read_id"]
    for name, df in zip(PARTS, (frags.repartitionByRange(*order).sortWithinPartitions(*order), clean, reads), strict=True):
        df.write.mode("overwrite").parquet(f"{path}/{name}/shard={shard}")
    n_rows = spark.read.parquet(f"{path}/rows/shard={shard}").count()
    spark.createDataFrame([(shard, contract, reads.count(), n_rows)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/part={shard}")


def read(spark: SparkSession, path: str, expected: int, contract: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The manifest and the parts by name. Missing, repeated or cut shards raise, and so does another contract."""
    manifest = cut(spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("shard", "contract", "n", "n_rows"))
    gather.validate(manifest, expected)
    if contract is not None and manifest.where(F.col("contract") != contract).count():
        raise ValueError("the shards were written under another contract")
    parts = {name: spark.read.parquet(f"{path}/{name}") for name in PARTS}
    for name, column in (("rows", "n_rows"), ("evidence", "n")):
        there = parts[name].groupBy("shard").agg(F.count(F.lit(1)).alias("there"))
        if manifest.join(there, "shard", "left").where(F.coalesce("there", F.lit(0)) != F.col(column)).count():
            raise ValueError(f"{name} of a shard are not what its manifest says")
    return manifest, parts


def collect(spark: SparkSession, path: str, expected: int, whitelist: DataFrame, p: Parameters, contract: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Deduplicated fragments and counts by barcode (qc.summary) of all shards, as one run over all reads gives them."""
    manifest, parts = read(spark, path, expected, contract)
    firsts = F.broadcast(gather.prefix(manifest).select("shard", "first"))  # a row for each shard
    numbered = lambda df: df.join(firsts, "shard").withColumn("read_id", F.col("first") + F.col("local_read_id")).drop("first", "local_read_id", "shard")
    known = whitelist.select("bc").distinct().join(gather.histograms(parts["histogram"]), "bc", "left").select("bc", F.coalesce("abundance", F.lit(0)).alias("abundance"))
    evidence = cut(numbered(parts["evidence"]))
    fixed = barcode.correct(evidence, cut(known), "read_id", p.barcode_errors, p.barcode_confidence)
    fixed = cut(fixed.select(F.col("id").alias("read_id"), F.coalesce("corrected", F.when(F.lit(p.output_off_whitelist), F.col("bc"))).alias("bc")))
    rows = numbered(parts["rows"]).join(fixed.where("bc is not null"), "read_id")
    if not p.remove_duplicates:
        found = rows.withColumn("num_dups", F.lit(1))
    elif p.bulk_level_dedup:
        found = dedup.dedup_cells_at_bulk(rows, dedup.abundance(rows))
    else:
        found = dedup.dedup(rows)
    found = cut(found)
    counts = qc.summary(found, whitelist, fixed.join(evidence.select("read_id", "cachehit"), "read_id"))
    found = dedup.allocate_multi(found) if p.allocate_multi else found
    return dedup.mapq_filter(found, p.least_mapq), counts
