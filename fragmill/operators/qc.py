"""Counts by barcode and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Intercept, share in cache, duplicates, unmapped, low mapping quality.
FRIP = (-1.0996, 4.2391, 3.0164e-05, -2.1087e-04, -5.5825e-05)


def summary(frags: DataFrame, whitelist: DataFrame, reads: DataFrame, least_mapq: int = 30) -> DataFrame:
    """bc, total, dup, mapped, lowmapq, cachehit of each barcode, and `non-whitelist` for the others.

    frags(bc, mapq, num_dups): a row for each deduplicated fragment. reads(bc): a row for each pair that was read,
    mapped or not; they are counted by barcode before anything is joined. cachehit is a column of either. Barcodes of
    reads alone have zeros.
    """
    known = whitelist.select(F.col("bc").alias("wl")).distinct()
    low = F.col("mapq") < least_mapq
    zero = F.lit(0).cast("long")
    hits = lambda df: F.sum("cachehit").cast("long") if "cachehit" in df.columns else zero
    n = reads.groupBy("bc").agg(F.count(F.lit(1)).alias("total"), hits(reads).alias("cachehit"))
    n = n.select("bc", "total", *(zero.alias(c) for c in ("dup", "mapped", "lowmapq")), "cachehit")
    mapped = frags.groupBy("bc").agg(
        F.lit(0).cast("long").alias("total"),
        F.sum(F.when(low, 0).otherwise(F.col("num_dups") - 1)).alias("dup"),
        F.sum("num_dups").alias("mapped"),
        F.sum(F.when(low, F.col("num_dups")).otherwise(0)).alias("lowmapq"),
        hits(frags).alias("cachehit"),
    )
    both = n.unionByName(mapped).join(known, F.col("bc") == F.col("wl"), "left")
    label = F.coalesce(F.col("wl").cast("string"), F.lit("non-whitelist"))
    return both.groupBy(label.alias("bc")).agg(*(F.sum(c).alias(c) for c in ("total", "dup", "mapped", "lowmapq", "cachehit")))


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def derived(counts: DataFrame, coefficients: tuple[float, ...] = FRIP, digits: int | None = 6) -> DataFrame:
    """Adds unmapped, fric and est_frip (0 where nothing was in the cache), rounded unless digits is None."""
    b0, b1, b2, b3, b4 = coefficients
    out = counts.withColumn("unmapped", F.col("total") - F.col("mapped")).withColumn("fric", F.when(F.col("mapped") > 0, F.col("cachehit") / F.col("mapped")).otherwise(0.0))
    est = inverse_logit(b0 + b1 * F.col("fric") + b2 * F.col("dup") + b3 * F.col("unmapped") + b4 * F.col("lowmapq"))
    out = out.withColumn("est_frip", F.when(F.col("fric") == 0, 0.0).otherwise(est))
    return out if digits is None else out.withColumns({c: F.round(c, digits) for c in ("fric", "est_frip")})


def halved(counts: DataFrame) -> DataFrame:
    """Paired SAM rows count each pair twice."""
    return counts.withColumns({c: F.floor(F.col(c) / 2) for c in ("dup", "lowmapq", "mapped")})


def bottom_k(slots: DataFrame, k: int = 250, span: int = 4_000_003) -> DataFrame:
    """bc, estimate of distinct slots from the k least: k * span / largest - 1; 0 for fewer than k.

    Slots are made distinct by a shuffle on both columns and ranked, so a barcode's slots are never gathered.
    """
    from pyspark.sql import Window

    ranked = slots.select("bc", "slot").distinct().withColumn("r", F.row_number().over(Window.partitionBy("bc").orderBy("slot")))
    kept = ranked.where(F.col("r") <= k).groupBy("bc").agg(F.max("slot").alias("largest"), F.count(F.lit(1)).alias("n"))
    estimate = F.floor(F.lit(k) * F.lit(span) / F.col("largest")) - 1
    return kept.select("bc", F.when((F.col("n") < k) | (F.col("largest") == 0), 0).otherwise(estimate).cast("bigint").alias("estimate"))


def approximate_distinct(slots: DataFrame, error: float = 0.02) -> DataFrame:
    """The same by a mergeable sketch: other numbers than bottom_k's."""
    return slots.groupBy("bc").agg(F.approx_count_distinct("slot", error).alias("estimate"))


def mapping_stats(frags: DataFrame) -> DataFrame:
    return frags.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("uniq") == 1, 1).otherwise(0)).alias("n_unique"), F.sum(F.when(F.col("mapq") < 4, 1).otherwise(0)).alias("n_multi"))
