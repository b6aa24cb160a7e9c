"""PCR duplicate removal.

The survivor of a group is the last row in the order of mapq, dir, uniq, read_id and the
two lengths; a struct's maximum is that row, so partial aggregation keeps one row of each
group and map task, and no group is ever sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_DUPS = 255
_TAIL = ("mapq", "dir", "uniq", "read_id", "pos_len", "neg_len")


def _tail(df: DataFrame) -> list[str]:
    return [c for c in _TAIL if c in df.columns]


def dedup(frags: DataFrame, level: str = "cell", layout: str = "pe", cap: int = MAX_DUPS) -> DataFrame:
    """Groups with num_dups (at most cap). level: cell or bulk (no barcode in the key); layout: pe or se.

    Single ends with barcodes are deduplicated by neighbours in sort order, see islands().
    """
    if layout == "se" and level == "cell":
        return islands(frags, cap)
    key = ["chrom", "start"] + (["len"] if layout == "pe" else []) + (["bc"] if level == "cell" else [])
    tail = ([] if layout == "pe" else ["len"]) + _tail(frags)
    best = F.max(F.struct(*tail)).alias("b")
    out = frags.groupBy(*key).agg(best, F.least(F.lit(cap), F.count(F.lit(1))).alias("num_dups"))
    return out.select(*key, *(f"b.{c}" for c in tail), "num_dups")


def islands(frags: DataFrame, cap: int = MAX_DUPS) -> DataFrame:
    """Single ends with barcodes: rows are sorted by start, length, barcode, ...; only neighbours with the same
    start and barcode are duplicates, so lengths in between split a group. Starts never mix: windows stay small."""
    order = ["len", "bc", *_tail(frags)]
    w = Window.partitionBy("chrom", "start").orderBy(*order)
    flagged = frags.withColumn("new", F.coalesce((F.lag("bc").over(w) != F.col("bc")).cast("int"), F.lit(1)))
    numbered = flagged.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct(*order)).alias("b")
    out = numbered.groupBy("chrom", "start", "island").agg(best, F.least(F.lit(cap), F.count(F.lit(1))).alias("num_dups"))
    return out.select("chrom", "start", *(f"b.{c}" for c in order), "num_dups")


def dedup_cells_at_bulk(frags: DataFrame, abundance: DataFrame, cap: int = MAX_DUPS) -> DataFrame:
    """One row a position: of its barcodes the one with most duplicates, then the most abundant, then the
    lowest; num_dups counts all rows of the position. abundance(bc, abundance) has every barcode."""
    tail = _tail(frags)
    cells = frags.groupBy("chrom", "start", "len", "bc").agg(F.max(F.struct(*tail)).alias("b"), F.count(F.lit(1)).alias("n"))
    ranked = cells.join(abundance, "bc", "left").fillna({"abundance": 0})
    pick = F.max(F.struct("n", "abundance", (-F.col("bc")).alias("low"), "bc", "b")).alias("p")
    out = ranked.groupBy("chrom", "start", "len").agg(pick, F.least(F.lit(cap), F.sum("n")).alias("num_dups"))
    return out.select("chrom", "start", "len", "p.bc", *(f"p.b.{c}" for c in tail), "num_dups")


def abundance(frags: DataFrame) -> DataFrame:
    return frags.groupBy("bc").agg(F.count(F.lit(1)).alias("abundance"))


def mapq_filter(frags: DataFrame, least: int = 30) -> DataFrame:
    return frags.where(F.col("mapq") >= least)


def seed_duplicates(reads: DataFrame, seed: int = 16) -> DataFrame:
    """Pairs with distinct first bases of both mates under a barcode (the early test on seeds)."""
    keyed = reads.withColumns({"seed1": F.substring("seq1", 1, seed), "seed2": F.substring("seq2", 1, seed)})
    return keyed.groupBy("bc", "seed1", "seed2").agg(F.min("read_id").alias("read_id"), F.count(F.lit(1)).alias("n"))


def allocate_multi(frags: DataFrame, distance: int = 0, seed: int = 11, unique_mapq: int = 4) -> DataFrame:
    """Unique rows, and one row of each multi-mapping read (mapq below unique_mapq): a row is drawn with the
    weight of the unique rows that it overlaps within distance; reads without any weight go.

    The draw is a hash of the read, so that any partitioning gives the same rows.
    """
    from fragmill.operators.intervals import overlap_totals

    unique, multi = frags.where(F.col("mapq") >= unique_mapq), frags.where(F.col("mapq") < unique_mapq)
    spans = lambda d: d.withColumn("stop", F.col("start") + F.col("len"))
    keys = ["read_id", "chrom", "start", "len", "bc"]
    over = overlap_totals(spans(multi), spans(unique), distance).where("n > 0")
    rows = spans(multi.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    weights = rows.join(over, ["chrom", "start", "stop"]).select(*keys, (F.col("n") * F.col("_rows")).alias("weight"))
    w = Window.partitionBy("read_id").orderBy("chrom", "start", "len", "bc")
    summed = weights.withColumn("upto", F.sum("weight").over(w)).withColumn("total", F.sum("weight").over(Window.partitionBy("read_id")))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("read_id")), F.col("total"))
    picked = summed.where((F.col("upto") > draw) & (F.col("upto") - F.col("weight") <= draw)).select(*keys)
    return unique.unionByName(multi.dropDuplicates(keys).join(picked, keys, "left_semi"))


def _by(rows: DataFrame, key: dict, order: list, cap: int) -> DataFrame:
    """The last row of each group in the order given, with the group's size."""
    names = [f"_{c}" for c in key]
    keyed = rows.withColumns(dict(zip(names, key.values(), strict=True)))
    last = F.max(F.struct(*(F.col(c) if isinstance(c, str) else c for c in order), *(F.col(c).alias(f"r{i}") for i, c in enumerate(rows.columns)))).alias("b")
    out = keyed.groupBy(*names).agg(last, F.least(F.lit(cap), F.count(F.lit(1))).alias("num_dups"))
    return out.select(*(F.col(f"b.r{i}").alias(c) for i, c in enumerate(rows.columns)), "num_dups")


def dedup_sam(rows: DataFrame, cap: int = MAX_DUPS) -> DataFrame:
    """Alignments (read_id, tid, pos, bc, flag, mtid, mpos, mapq, ...) with num_dups: one of those with equal places of
    read and mate, barcode and mate number. Of a group the highest quality stays, then the highest read."""
    first = F.col("flag").bitwiseAND(64).alias("f")
    return _by(rows, {c: F.col(c) for c in ("tid", "pos", "bc", "mtid", "mpos")} | {"read1": first}, ["mapq", "read_id"], cap)


def dedup_pairs(rows: DataFrame, cap: int = 127) -> DataFrame:
    """Contacts (read_id, rid1, pos1, rid2, pos2, mapq, ...) with num_dups: one of those with the same two places,
    whatever their strands and barcodes. Counts have seven bits."""
    return _by(rows, {c: F.col(c) for c in ("rid1", "rid2", "pos1", "pos2")}, ["mapq", "read_id"], cap)
