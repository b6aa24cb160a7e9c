"""Sequences as strings and as packed numbers, with built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: str | Column) -> Column:
    """Bases other than A, C, G and T stay as they are."""
    return F.reverse(F.translate(_col(seq), "ACGTacgt", "TGCAtgca"))


def pack(seq: str | Column) -> Column:
    """Up to 31 bases, 2 bits each, the first most significant; others count as A."""
    digits = F.translate(F.regexp_replace(F.upper(_col(seq)), "[^ACGT]", "A"), "ACGT", "0123")
    return F.conv(digits, 4, 10).cast("bigint")


def unpack(key: str | Column, length: int) -> Column:
    return F.translate(F.lpad(F.conv(_col(key).cast("string"), 10, 4), length, "0"), "0123", "ACGT")


def n_positions(seq: str | Column) -> Column:
    """0-based places of bases other than A, C, G and T."""
    s = _col(seq)
    return F.filter(F.sequence(F.lit(0), F.length(s) - 1), lambda i: ~F.substring(s, i + 1, F.lit(1)).rlike("[ACGTacgt]"))


def hash64(x: Column, bits: int) -> Column:
    """An invertible mix of a number of so many bits; bits beyond are masked before each shift, so nothing overflows."""
    mask = (1 << bits) - 1

    def left(v: Column, n: int) -> Column:
        return F.shiftleft(v.bitwiseAND(F.lit((1 << (bits - n)) - 1)) if n < bits else v * 0, n)

    def keep(v: Column) -> Column:
        return v.bitwiseAND(F.lit(mask))

    x = keep(F.lit(-1) - x + left(x, 21))
    x = x.bitwiseXOR(F.shiftright(x, 24))
    x = keep(keep(x + left(x, 3)) + left(x, 8))
    x = x.bitwiseXOR(F.shiftright(x, 14))
    x = keep(keep(x + left(x, 2)) + left(x, 4))
    x = x.bitwiseXOR(F.shiftright(x, 28))
    return keep(x + left(x, 31)) if bits > 31 else keep(x)


def kmers(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """A row pos, kmer for each window of k bases without others."""
    at = F.explode(F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>")))
    out = df.withColumn("pos", at).withColumn("kmer", F.substring(F.col(seq), F.col("pos"), F.lit(k)))
    return out.where(~F.col("kmer").rlike("[^ACGT]"))


def read_slice(seq: str | Column, ranges: list[tuple[int, int]], reverse: bool = False) -> Column:
    """Concatenated inclusive ranges of 0-based places, -1 meaning the end, then reverse-complemented if asked."""
    s = _col(seq)
    parts = [F.substring(s, F.lit(a + 1), F.length(s) if b < 0 else F.lit(b - a + 1)) for a, b in ranges]
    joined = reduce(F.concat, parts)
    return revcomp(joined) if reverse else joined


def parse_format(text: str) -> dict[str, tuple[list[tuple[int, int]], bool]]:
    """`r1:0:-1,bc:0:15:-` to ranges and strand by part; a part may have several ranges."""
    out: dict[str, tuple[list[tuple[int, int]], bool]] = {}
    for item in text.split(","):
        name, start, end, *strand = item.split(":")
        ranges, back = out.get(name, ([], False))
        out[name] = ([*ranges, (int(start), int(end))], back or strand == ["-"])
    return out
