"""Peaks of fragment pileups against a local background."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.functions import kernels
from fragmill.operators.barcode import small
from fragmill.operators.intervals import overlap_join, pileup, regions, step_merge
from fragmill.plans.lineage import cut

#: The mappable genome, the local window, and defaults of the caller.
GENOME, LOCAL, P_VALUE, MIN_LENGTH, MAX_GAP = 2_913_022_398, 10_000, 1e-5, 200, 30


def inputs(frags: DataFrame) -> DataFrame:
    """chrom, start, stop, count of fragments with a length and a count."""
    count = F.col("num_dups") if "num_dups" in frags.columns else F.lit(1)
    out = frags.select("chrom", F.col("start").cast("bigint").alias("start"), (F.col("start") + F.col("len")).cast("bigint").alias("stop"), count.cast("bigint").alias("count"))
    return out.where("stop > start and count > 0")


def chrom_numbers(frags: DataFrame) -> DataFrame:
    """chrom, chrom_id: chromosomes that occur, numbered densely by name."""
    return frags.select("chrom").distinct().withColumn("chrom_id", F.row_number().over(Window.orderBy("chrom")) - 1)


def totals(frags: DataFrame, genome: int = GENOME) -> DataFrame:
    """mass, n, lambda_bg: bases and fragments by count, and the background rate."""
    out = frags.agg(F.sum((F.col("stop") - F.col("start")) * F.col("count")).alias("mass"), F.sum("count").alias("n"))
    return out.withColumn("lambda_bg", F.col("mass") / F.lit(genome))


def cut_windows(frags: DataFrame, local: int = LOCAL) -> DataFrame:
    """Windows of `local` bases around both ends of each fragment, cut at 0."""
    half = local // 2
    ends = F.explode(F.array("start", "stop"))
    out = frags.select("chrom", "count", ends.alias("at"))
    return out.select("chrom", "count", F.greatest(F.col("at") - half, F.lit(0)).alias("start"), (F.col("at") + half).alias("stop"))


def tracks(frags: DataFrame, genome: int = GENOME, local: int = LOCAL, max_count: int | None = None) -> DataFrame:
    """chrom, start, stop, treat, lam: the weighted pileup and max(background, local rate) where there is either."""
    frags = cut(frags)
    treat = pileup(frags, F.col("count"), max_count).select("chrom", "start", "stop", F.col("depth").alias("v"))
    around = pileup(cut_windows(frags, local), F.col("count"), max_count).select("chrom", "start", "stop", F.col("depth").alias("v"))
    both = step_merge(treat, around).withColumnsRenamed({"a": "treat", "b": "near"})
    t = totals(frags, genome).select("lambda_bg", (F.col("mass") / (2.0 * local * F.col("n"))).alias("scale"))
    lam = F.greatest(F.col("lambda_bg"), F.col("near") * F.col("scale"))
    return both.crossJoin(F.broadcast(t)).select("chrom", "start", "stop", "treat", F.round(lam, 9).alias("lam"))  # one row of totals


def scored(steps: DataFrame) -> DataFrame:
    """Adds ppois, -log10 of the Poisson tail above treat; worked out once for each distinct pair of values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(ppois=kernels.log10_poisson_tail(pdf["treat"].to_numpy(), pdf["lam"].to_numpy()).round(5))

    steps = cut(steps)
    pairs = cut(steps.select("treat", "lam").distinct().mapInPandas(run, "treat double, lam double, ppois double"))
    return steps.join(small(pairs), ["treat", "lam"])  # most of a genome may have one pair


def q_values(steps: DataFrame, score: str = "ppois") -> DataFrame:
    """Adds qscore (Benjamini-Hochberg): bases by distinct score, ranked from the highest, made monotone.

    The table of distinct scores is what is ranked, never the genome.
    """
    steps = cut(steps)
    by = steps.groupBy(F.col(score).alias("p")).agg(F.sum(F.col("stop") - F.col("start")).alias("bases"))
    down = Window.orderBy(F.desc("p"))
    total = by.agg(F.sum("bases").alias("total"))
    ranked = by.crossJoin(F.broadcast(total)).withColumn("rank", F.sum("bases").over(down.rowsBetween(Window.unboundedPreceding, -1)))
    raw = F.col("p") + F.log10((F.coalesce("rank", F.lit(0)) + 1) / F.col("total"))
    q = ranked.withColumn("raw", raw).withColumn("q", F.min("raw").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    q = cut(q.select("p", F.round(F.greatest("q", F.lit(0.0)), 5).alias("qscore")))
    return steps.join(small(q), F.col(score) == F.col("p")).drop("p")


def call(frags: DataFrame, p: float | None = P_VALUE, q: float | None = None, least: int = MIN_LENGTH, gap: int = MAX_GAP, genome: int = GENOME, local: int = LOCAL) -> DataFrame:
    """chrom, start, stop, score, signal, p, q, summit of the peaks: narrowPeak's columns. p or q is the cutoff.

    The summit is the middle of the first stretch with the peak's highest pileup.
    """
    import math

    if (p is None) == (q is None):
        raise ValueError("give a p-value or a q-value")
    steps = cut(q_values(scored(tracks(frags, genome, local))))
    name, cutoff = ("ppois", -math.log10(p)) if q is None else ("qscore", -math.log10(q))
    found = regions(steps, name, cutoff, gap, least)
    inside = overlap_join(found, steps, 0, 1000)
    top = F.max_by(F.struct("b_start", "b_stop", "b_treat", "b_lam", "b_ppois", "b_qscore"), F.struct("b_treat", (-F.col("b_start")).alias("first"))).alias("t")
    out = inside.groupBy(F.col("a_chrom").alias("chrom"), F.col("a_start").alias("start"), F.col("a_stop").alias("stop")).agg(top)
    middle = F.floor((F.greatest("t.b_start", "start") + F.least("t.b_stop", "stop")) / 2)
    return out.select("chrom", "start", "stop", F.least(F.floor(F.col("t.b_qscore") * 10), F.lit(1000)).cast("int").alias("score"), F.round(F.col("t.b_treat") / F.col("t.b_lam"), 5).alias("signal"), F.col("t.b_ppois").alias("p"), F.col("t.b_qscore").alias("q"), (middle - F.col("start")).alias("summit"))


def cut_sites(frags: DataFrame, shift: int = -100, extend: int = 200) -> DataFrame:
    """The 5' ends of both strands, moved by shift against their direction and extended: a row for each end."""
    left = F.struct((F.col("start") + shift).alias("start"), (F.col("start") + shift + extend).alias("stop"))
    right = F.struct((F.col("stop") - shift - extend).alias("start"), (F.col("stop") - shift).alias("stop"))
    out = frags.select("chrom", "count", F.inline(F.array(left, right)))
    return out.withColumn("start", F.greatest("start", F.lit(0)).cast("bigint"))


def bed_profile(frags: DataFrame, cells: DataFrame | None = None, q: float = 0.05, genome: int = 2_700_000_000, shift: int = -100, extend: int = 200) -> DataFrame:
    """call() over cut sites of frags(chrom, start, stop, count, bc), of the barcodes in cells(bc) where given."""
    chosen = frags if cells is None else frags.join(small(cells.select("bc").distinct()), "bc", "left_semi")
    return call(cut_sites(chosen, shift, extend).where("stop > start"), p=None, q=q, genome=genome)


def parameters(spark, **settings: object) -> DataFrame:
    """key, value rows that say how peaks were called: the settings given and the fixed values, for write_tsv."""
    known = {"genome": GENOME, "local": LOCAL, "min_length": MIN_LENGTH, "max_gap": MAX_GAP} | settings
    return spark.createDataFrame([(k, "" if v is None else f"{v:.10g}" if isinstance(v, float) else str(v)) for k, v in known.items()], "key string, value string")


def binned_cuts(frags: DataFrame, size: int = 50, extend: int = 150) -> DataFrame:
    """chrom, bin, n: windows of `extend` around both ends by the bins that they touch."""
    half = extend // 2
    ends = frags.select("chrom", "count", F.explode(F.array("start", "stop")).alias("at"))
    bins = F.sequence(F.floor(F.greatest(F.col("at") - half, F.lit(0)) / size), F.floor((F.col("at") + half - 1) / size))
    return ends.select("chrom", "count", F.explode(bins).alias("bin")).groupBy("chrom", "bin").agg(F.sum("count").alias("n"))


def compare_steps(a: DataFrame, b: DataFrame) -> DataFrame:
    """bases, mae, pearson of two step functions (chrom, start, stop, v), weighted by length."""
    m = step_merge(a, b).withColumn("w", (F.col("stop") - F.col("start")).cast("double"))
    s = lambda x: F.sum(F.col("w") * x)
    x, y = F.col("a"), F.col("b")
    t = m.agg(F.sum("w").alias("w"), s(F.abs(x - y)).alias("d"), s(x).alias("x"), s(y).alias("y"), s(x * x).alias("xx"), s(y * y).alias("yy"), s(x * y).alias("xy"))
    cov: Column = F.col("w") * F.col("xy") - F.col("x") * F.col("y")
    dev = F.sqrt((F.col("w") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("w") * F.col("yy") - F.col("y") * F.col("y")))
    return t.select(F.col("w").cast("bigint").alias("bases"), F.round(F.col("d") / F.col("w"), 6).alias("mae"), F.round(F.when(dev > 0, cov / dev), 6).alias("pearson"))
