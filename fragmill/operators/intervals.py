"""Half-open genomic intervals: overlaps, merges, pileups and regions.

Running values over a chromosome are taken in two steps, so that no task holds one: bins
of positions are scanned alone, and the bins' totals, a row each, give what carries over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmill.plans.lineage import cut

#: Positions of a bin when a chromosome is scanned.
SCAN_BIN = 1 << 20
#: Rows of a block in overlap_pairs(), about.
BLOCK = 1024
#: Cells for each task that overlap_pairs() makes of all work, about, and places that it sends to every task.
CELLS, FEW = 4, 200_000
_PLACE = ["chrom", "start", "stop"]


def _binned(df: DataFrame, side: str, reach: int, bin_size: int) -> DataFrame:
    """df's good rows in each bin that they touch, columns prefixed, with the first such bin."""
    df = df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)).where(F.col(f"{side}_stop") > F.col(f"{side}_start"))
    first = F.floor((F.col(f"{side}_start") - reach) / bin_size)
    last = F.floor((F.col(f"{side}_stop") - 1 + reach) / bin_size)
    return df.withColumn(f"{side}_first", first).withColumn(f"{side}_bin", F.explode(F.sequence(first, last)))


def _meet(distance: int) -> Column:
    """Rows that met in a bin overlap, and it is the first bin that both share."""
    near = (F.col("a_start") - distance < F.col("b_stop")) & (F.col("b_start") < F.col("a_stop") + distance)
    return near & (F.col("a_bin") == F.greatest("a_first", "b_first"))


def overlap_join(a: DataFrame, b: DataFrame, distance: int = 0, bin_size: int = 200) -> DataFrame:
    """Pairs that overlap (start < other stop both ways, within distance), columns prefixed a_ and b_.

    Both sides go to the bins that they touch and join there; a pair is kept in the first bin that both
    share, so that it comes once. bin_size about the usual length keeps rows few.
    """
    x, y = _binned(a, "a", distance, bin_size), _binned(b, "b", 0, bin_size)
    bins_ = (F.col("a_chrom") == F.col("b_chrom")) & (F.col("a_bin") == F.col("b_bin"))
    return x.join(y, bins_ & _meet(distance)).drop("a_first", "a_bin", "b_first", "b_bin")


def _places(df: DataFrame) -> DataFrame:
    """chrom, start, stop, n of the distinct good intervals; checkpointed, and broadcast where they are few."""
    good = df.where(F.col("chrom").isNotNull() & (F.col("stop") > F.col("start")))
    places = cut(good.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n")))
    return F.broadcast(places) if places.count() <= FEW else places


def _met(a: DataFrame, b: DataFrame, distance: int, bin_size: int) -> DataFrame:
    """a_ and b_ place and rows (their other columns, prefixed) of the blocks of overlap_pairs() that meet."""
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = {"a": _places(a), "b": _places(b)}
    reach = {"a": distance, "b": 0}
    depth = {s: _binned(n[s], s, reach[s], bin_size).groupBy(F.col(f"{s}_chrom").alias("chrom"), F.col(f"{s}_bin").alias("bin")).agg(F.sum(f"{s}_n").cast("double").alias(f"{s}_n")) for s in "ab"}
    work = cut(depth["a"].join(depth["b"], ["chrom", "bin"]).withColumn("work", F.col("a_n") * F.col("b_n")))
    most = max((work.agg(F.sum("work")).first()[0] or 0) / (CELLS * tasks), BLOCK**2)
    cells = F.ceil(F.col("work") / most)
    cells_a = F.least(cells, F.greatest(F.lit(1), F.round(F.sqrt(cells * F.col("a_n") / F.col("b_n"))).cast("bigint")))
    deep = cut(work.where(F.col("work") > most).select("chrom", "bin", cells_a.alias("cells_a"), F.ceil(cells / cells_a).alias("cells_b")))

    def dealt(df: DataFrame, side: str) -> DataFrame:
        other = "b" if side == "a" else "a"
        row = F.struct(*([F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in _PLACE] or [F.lit(None).alias(f"{side}_")]))
        block = F.pmod(F.xxhash64(*df.columns), F.ceil(F.col("n") / BLOCK)).alias("block")
        blocks = df.join(n[side], _PLACE).groupBy(*_PLACE, block).agg(F.collect_list(row).alias("rows"))
        x = _binned(blocks, side, reach[side], bin_size)
        x = x.join(F.broadcast(deep), (F.col(f"{side}_chrom") == F.col("chrom")) & (F.col(f"{side}_bin") == F.col("bin")), "left")
        mine = F.pmod(F.xxhash64(f"{side}_start", f"{side}_stop", f"{side}_block"), F.coalesce(f"cells_{side}", F.lit(1)))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"cells_{other}", F.lit(1)) - 1))
        x = x.withColumn(f"in_{side}", mine).withColumn(f"in_{other}", every)
        # one key: were it several, Spark would deal again wherever it finds one of them constant, and merge small partitions
        x = x.withColumn(f"{side}_cell", F.concat_ws(" ", "in_a", "in_b", f"{side}_bin", f"{side}_chrom"))
        return x.drop("chrom", "bin", "cells_a", "cells_b", "in_a", "in_b").repartition(tasks, f"{side}_cell")

    met = dealt(a, "a").hint("merge").join(dealt(b, "b"), (F.col("a_cell") == F.col("b_cell")) & _meet(distance))
    return met.select(*(f"{s}_{c}" for s in "ab" for c in [*_PLACE, "rows"]))


def overlap_pairs(a: DataFrame, b: DataFrame, distance: int = 0, bin_size: int = 200) -> DataFrame:
    """The rows of overlap_join() for deep stacks, whose pairs are many more than the rows that make them.

    Rows of one interval are collected in blocks of about BLOCK, dealt by a hash so that only rows equal in all columns
    can exceed it. Blocks are dealt out once, by bin, and spread into pairs where they meet. A bin with much of the work is
    a grid of cells: each block of a goes to a row of it, each block of b to a column. So no task is left all pairs, and what
    is dealt grows with the rows, times the square root of the cells in such bins, not with the pairs.
    """
    columns = lambda df, s: [f"{s}_{c}" for c in df.columns]
    place = [f"{s}_{c}" for s in "ab" for c in _PLACE]
    one = _met(a, b, distance, bin_size).select(*place, "b_rows", F.inline("a_rows"))
    return one.select(*place, *(c for c in columns(a, "a") if c not in place), F.inline("b_rows")).select(*columns(a, "a"), *columns(b, "b"))


def overlap_totals(a: DataFrame, b: DataFrame, distance: int = 0) -> DataFrame:
    """chrom, start, stop, n: of each distinct interval of a the rows of b that it overlaps within distance, 0 for none.

    No pair is made: of the rows of b that start before a's end, those that end by a's start don't overlap it. Both
    numbers are running sums over the distinct places, so the work grows with the rows, not with the depth.
    """
    place = lambda c, s=0, e=0: F.struct(c.cast("bigint").alias("pos"), F.lit(s).alias("s"), F.lit(e).alias("e"))
    good = lambda d: d.where(F.col("stop") > F.col("start")).select("chrom", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))
    mine = cut(good(a).distinct())
    counted = good(b).select("chrom", F.inline(F.array(place(F.col("start"), s=1), place(F.col("stop"), e=1))))
    asked = mine.select("chrom", F.inline(F.array(place(F.col("stop") + distance), place(F.col("start") - distance))))
    at = counted.unionByName(asked).groupBy("chrom", "pos").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    run = cut(_scan(cut(at), ["pos"], sums={"starts": F.col("s"), "ends": F.col("e")}))
    before = run.select("chrom", (F.col("pos") - distance).alias("stop"), (F.col("starts") - F.col("s")).alias("_starts"))
    gone = run.select("chrom", (F.col("pos") + distance).alias("start"), F.col("ends").alias("_ends"))
    return mine.join(before, ["chrom", "stop"]).join(gone, ["chrom", "start"]).select("chrom", "start", "stop", (F.col("_starts") - F.col("_ends")).alias("n"))


def overlap_count(a: DataFrame, b: DataFrame, key: list[str], distance: int = 0) -> DataFrame:
    """key, n: the rows of b that the rows of a with that key overlap; 0 for none."""
    n = overlap_totals(a, b, distance)
    return a.join(n, ["chrom", "start", "stop"], "left").groupBy(*key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _scan(df: DataFrame, order: list[str], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, inclusive: bool = True, following: str | None = None) -> DataFrame:
    """Adds running sums and maxima by chromosome in the given order, over this row too if inclusive, and as
    `following` the next row's first order column (null for the last). df is read twice."""
    values = {**{k: (v, F.sum) for k, v in (sums or {}).items()}, **{k: (v, F.max) for k, v in (maxes or {}).items()}}
    pos = order[0]
    df = df.withColumn("_bin", F.floor(F.col(pos) / SCAN_BIN)).withColumns({f"_v_{k}": v for k, (v, _) in values.items()})
    inside = Window.partitionBy("chrom", "_bin").orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    by_bin = Window.partitionBy("chrom").orderBy("_bin")
    before = by_bin.rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("chrom", "_bin").agg(F.min(pos).alias("_first"), *(fold(f"_v_{k}").alias(f"_t_{k}") for k, (_, fold) in values.items()))
    carry = totals.select("chrom", "_bin", F.lead("_first").over(by_bin).alias("_after"), *(fold(f"_t_{k}").over(before).alias(f"_c_{k}") for k, (_, fold) in values.items()))
    local = {f"_r_{k}": fold(f"_v_{k}").over(frame) for k, (_, fold) in values.items()}
    if following:
        local["_next"] = F.lead(pos).over(inside)
    out = df.withColumns(local).join(carry, ["chrom", "_bin"])
    for k, (_, fold) in values.items():
        here, earlier = F.col(f"_r_{k}"), F.col(f"_c_{k}")
        out = out.withColumn(k, F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0)) if fold is F.sum else F.greatest(here, earlier))
    if following:
        out = out.withColumn(following, F.coalesce("_next", "_after"))
    return out.drop("_bin", "_after", "_next", *(f"_{x}_{k}" for x in "vcr" for k in values))


def pileup(intervals: DataFrame, weight: Column | int = 1, max_count: int | None = None) -> DataFrame:
    """chrom, start, stop, depth: a step for each stretch of one depth above 0. weight: of a row; max_count clamps it."""
    w = F.lit(weight) if isinstance(weight, int) else weight
    w = F.least(w, F.lit(max_count)) if max_count is not None else w
    w = w.cast("bigint")
    good = intervals.where((F.col("stop") > F.col("start")) & (w > 0))
    ends = F.array(F.struct(F.col("start").cast("bigint").alias("pos"), w.alias("d")), F.struct(F.col("stop").cast("bigint").alias("pos"), (-w).alias("d")))
    events = good.select("chrom", F.inline(ends)).groupBy("chrom", "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    steps = _scan(cut(events), ["pos"], sums={"depth": F.col("d")}, following="stop")
    return steps.where("depth > 0").select("chrom", F.col("pos").alias("start"), "stop", "depth")


def merge(intervals: DataFrame, gap: int = 0) -> DataFrame:
    """chrom, start, stop, n of unions of intervals that overlap, touch, or lie at most gap apart. Equal intervals
    are counted first, so that no two rows tie in the scans."""
    df = cut(intervals.groupBy("chrom", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop")).agg(F.count(F.lit(1)).alias("w")))
    seen = _scan(df, ["start", "stop"], maxes={"seen": F.col("stop")}, inclusive=False)
    head = F.when(F.col("seen").isNull() | (F.col("start") > F.col("seen") + gap), F.col("start"))
    joined = _scan(seen, ["start", "stop"], maxes={"island": head})
    return joined.groupBy("chrom", "island").agg(F.max("stop").alias("stop"), F.sum("w").alias("n")).select("chrom", F.col("island").alias("start"), "stop", "n")


def regions(steps: DataFrame, value: str, cutoff: float, gap: int = 30, least: int = 200) -> DataFrame:
    """chrom, start, stop of stretches with value >= cutoff, joined over gaps of at most gap, of least length."""
    joined = merge(steps.where(F.col(value) >= cutoff), gap)
    return joined.where(F.col("stop") - F.col("start") >= least).select("chrom", "start", "stop")


def depth_regions(steps: DataFrame, cutoff: int = 3) -> DataFrame:
    """Contiguous stretches with at least the cutoff's depth."""
    return merge(steps.where(F.col("depth") >= cutoff)).select("chrom", "start", "stop")


def bins(df: DataFrame, size: int = 5000) -> DataFrame:
    """A row for each bin that an interval touches."""
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))


def step_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """chrom, start, stop, a, b of two step functions (chrom, start, stop, v), 0 where one is not defined."""

    def ends(df: DataFrame, side: str) -> DataFrame:
        other = "b" if side == "a" else "a"
        v = F.col("v").cast("double")
        rows = F.array(F.struct(F.col("start").alias("pos"), v.alias("d")), F.struct(F.col("stop").alias("pos"), (-v).alias("d")))
        return df.select("chrom", F.inline(rows)).select("chrom", "pos", F.col("d").alias(side), F.lit(0.0).alias(other))

    at = ends(a, "a").unionByName(ends(b, "b")).groupBy("chrom", "pos").agg(F.sum("a").alias("da"), F.sum("b").alias("db"))
    run = _scan(cut(at), ["pos"], sums={"a": F.col("da"), "b": F.col("db")}, following="stop")
    return run.where("stop is not null").select("chrom", F.col("pos").alias("start"), "stop", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


def nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(chrom, pos, ...) with the distance to the nearest b(chrom, pos), null where the chromosome has none.

    As-of in both directions: the last b before and the first b after, carried over bins.
    """
    rows = a.withColumn("_b", F.lit(None).cast("bigint")).unionByName(b.select("chrom", F.col("pos").cast("bigint").alias("pos"), F.col("pos").cast("bigint").alias("_b")), allowMissingColumns=True)
    rows = cut(rows.withColumn("_mine", F.col("_b").isNull()))
    left = _scan(rows, ["pos", "_mine"], maxes={"_left": F.col("_b")})
    both = _scan(left.withColumn("_p", -F.col("pos")), ["_p", "_mine"], maxes={"_right": -F.col("_b")})
    gap = F.least(F.col("pos") - F.col("_left"), -F.col("_right") - F.col("pos"))
    return both.where("_mine").withColumn("distance", gap).drop("_b", "_mine", "_left", "_right", "_p")


def jaccard(a: DataFrame, b: DataFrame, bin_size: int = 200) -> DataFrame:
    """a_bases, b_bases, both, jaccard of two interval sets."""
    x, y = cut(merge(a)), cut(merge(b))
    both = overlap_join(x, y, 0, bin_size).agg(F.coalesce(F.sum(F.least("a_stop", "b_stop") - F.greatest("a_start", "b_start")), F.lit(0)).alias("both"))
    size = lambda d, n: d.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias(n))
    out = size(x, "a_bases").join(size(y, "b_bases")).join(both)
    union = F.col("a_bases") + F.col("b_bases") - F.col("both")
    return out.withColumn("jaccard", F.round(F.when(union > 0, F.col("both") / union).otherwise(0.0), 6))
