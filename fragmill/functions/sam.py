"""SAM and pairs fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SAM flag bits.
PAIRED, PROPER, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY = 1, 2, 16, 32, 64, 128, 256


def _bit(on: Column, bit: int) -> Column:
    return F.when(on, F.lit(bit)).otherwise(F.lit(0))


def flags_single(plus: Column, nth: Column) -> Column:
    return _bit(~plus, REVERSE).bitwiseOR(_bit(nth >= 1, SECONDARY))


def flags_paired(plus1: Column, plus2: Column, nth: Column) -> tuple[Column, Column]:
    """Of both mates; nth: how many of the pair's best mappings came before."""
    shared = F.lit(PAIRED | PROPER).bitwiseOR(_bit(nth >= 1, SECONDARY))
    one = shared.bitwiseOR(F.lit(READ1)).bitwiseOR(_bit(~plus1, REVERSE)).bitwiseOR(_bit(~plus2, MATE_REVERSE))
    two = shared.bitwiseOR(F.lit(READ2)).bitwiseOR(_bit(~plus2, REVERSE)).bitwiseOR(_bit(~plus1, MATE_REVERSE))
    return one, two


def tlen(length: Column, plus: Column) -> Column:
    return F.when(plus, length).otherwise(-length)


def coordinate_order(df: DataFrame) -> list[Column]:
    """By reference, place, flag, mate, insert size and read; unmapped (-1) last."""
    last = lambda c: F.when(F.col(c) == -1, F.lit(2147483647)).otherwise(F.col(c))
    return [last("tid"), last("pos"), F.col("flag"), last("mtid"), last("mpos"), F.col("isize"), F.col("read_id")]


def cigar_text(cigar: Column) -> Column:
    """array<struct<len, op>> to text; `*` for none."""
    return F.when(F.size(cigar) > 0, F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")).otherwise("*")


def pairs_flip(df: DataFrame) -> DataFrame:
    """Each pair's smaller end first: by rank1, rank2 where given (else the reference's number), then the place."""
    ranked = "rank1" in df.columns
    r1, r2 = (F.col("rank1"), F.col("rank2")) if ranked else (F.col("rid1"), F.col("rid2"))
    swap = (r1 > r2) | ((r1 == r2) & (F.col("pos1") > F.col("pos2")))
    cols = {}
    for c in ("rid", "pos", "s"):
        a, b = F.col(f"{c}1"), F.col(f"{c}2")
        cols[f"{c}1"], cols[f"{c}2"] = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return df.select(*(c for c in df.columns if c not in cols), *(v.alias(k) for k, v in cols.items()))


def is_y(name: Column) -> Column:
    """The contig is y, with or without chr or chr_ before it, in any case."""
    n = F.lower(name)
    return F.when(F.length(n) > 3, F.regexp_replace(n, "^chr_?", "")).otherwise(n) == "y"


def read_name(name: Column) -> Column:
    """Without the leading @, what follows white space, and /1 or /2."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^@", ""), r"\s.*$", ""), "/[12]$", "")


def read_group(path: Column) -> Column:
    """The file's name without its extensions."""
    return F.regexp_extract(path, r"([^/]+?)(\.(fastq|fq|fasta|fa|cbq))?(\.gz)?$", 1)
