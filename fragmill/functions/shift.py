"""Transposase offsets. Formats that keep alignments (SAM, pairs) are left as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSICAL, SYMMETRIC = (4, -5), (4, -4)


def tn5_pairs(frags: DataFrame, forward: int = 4, reverse: int = -5) -> DataFrame:
    """Start moves by forward, the end by reverse; the mates' lengths follow."""
    return frags.withColumns({"start": F.col("start") + forward, "len": F.col("len") - (forward - reverse), "pos_len": F.col("pos_len") - forward, "neg_len": F.col("neg_len") + reverse})


def tn5_single(frags: DataFrame, forward: int = 4, reverse: int = -5) -> DataFrame:
    """dir 1 (the plus strand): start moves by forward; else the length changes by reverse."""
    plus = F.col("dir") == 1
    return frags.withColumns({"start": F.when(plus, F.col("start") + forward).otherwise(F.col("start")), "len": F.when(plus, F.col("len")).otherwise(F.col("len") + reverse)})


def for_output(frags: DataFrame, output: str, paired: bool = True, forward: int = 4, reverse: int = -5) -> DataFrame:
    """Shifted for formats of fragments; SAM, BAM and pairs, which keep alignments, as they are."""
    if output in ("sam", "bam", "pairs"):
        return frags
    return (tn5_pairs if paired else tn5_single)(frags, forward, reverse)
