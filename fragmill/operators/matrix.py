"""Cell by feature counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.operators.barcode import number_first_seen
from fragmill.operators.gather import rank
from fragmill.operators.intervals import bins, overlap_join
from fragmill.plans.lineage import cut


def cell_by_bin(frags: DataFrame, size: int = 5000) -> DataFrame:
    """bc, chrom, bin, n: fragments that touch each bin, counted for each bin of its own chromosome."""
    return bins(frags.withColumn("stop", F.col("start") + F.col("len")), size).groupBy("bc", "chrom", "bin").agg(F.count(F.lit(1)).alias("n"))


_PLACE = ["chrom", "start", "stop"]


def _by_place(frags: DataFrame, peaks: DataFrame, bin_size: int) -> DataFrame:
    """bc, chrom, start, stop, n: a barcode's fragments over each distinct interval of the peaks. Equal fragments and
    equal peaks meet once, with their numbers, so that deep stacks make no pair for each of their rows."""
    spans = frags.groupBy("bc", "chrom", "start", (F.col("start") + F.col("len")).alias("stop")).agg(F.count(F.lit(1)).alias("w"))
    pairs = overlap_join(spans, peaks.select(*_PLACE).distinct(), 0, bin_size)
    return pairs.groupBy(F.col("a_bc").alias("bc"), *(F.col(f"b_{c}").alias(c) for c in _PLACE)).agg(F.sum("a_w").alias("n"))


def cell_by_peak(frags: DataFrame, peaks: DataFrame, bin_size: int = 200) -> DataFrame:
    """bc, peak_id, n of fragments over peaks."""
    return peaks.join(_by_place(frags, peaks, bin_size), _PLACE).groupBy("bc", "peak_id").agg(F.sum("n").alias("n"))


def _cells(frags: DataFrame) -> DataFrame:
    return number_first_seen(frags, "bc", ["chrom", "start", "len", "bc"], "bc_idx")


def _features(found: DataFrame, feature: str) -> DataFrame:
    return rank(found.select(feature).distinct(), [F.col(feature)]).select(feature, (F.col("rank") - 1).cast("int").alias("feat_idx"))


def numbered(counts: DataFrame, frags: DataFrame, feature: str = "peak_id") -> DataFrame:
    """bc_idx, feat_idx, n with 0-based numbers: barcodes as first seen in the fragments' order, features by id."""
    return counts.join(_cells(frags), "bc").join(_features(counts, feature), feature).select("bc_idx", "feat_idx", "n")


def numbered_peaks(frags: DataFrame, peaks: DataFrame, bin_size: int = 200) -> DataFrame:
    """numbered() of cell_by_peak(), with the numbers given before the counts are spread over equal peaks."""
    by = cut(_by_place(frags, peaks, bin_size))
    feats = _features(peaks.join(by.select(*_PLACE).distinct(), _PLACE, "left_semi"), "peak_id")
    spread = peaks.join(feats, "peak_id").join(by.join(_cells(frags), "bc"), _PLACE)
    return spread.groupBy("bc_idx", "feat_idx").agg(F.sum("n").alias("n"))
