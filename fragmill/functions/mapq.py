"""Mapping qualities as column expressions; every truncation is explicit, and the numbers are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trunc(x: Column) -> Column:
    return x.cast("bigint")  # towards zero; x stands here once, as calls nest


def _penalty(n_second: Column) -> Column:
    return F.when(n_second > 0, _trunc(4.343 * F.log(n_second + 1) + 0.499)).otherwise(F.lit(0))


def _clamp(q: Column) -> Column:
    return F.least(F.greatest(q, F.lit(0)), F.lit(60))


def _repeats(q: Column, identity: Column, rep_len: Column, length: Column) -> Column:
    f = F.when(rep_len >= length, F.lit(0.999)).otherwise(rep_len / length)
    g = F.when(identity <= 0.95, F.sqrt(f)).when(identity <= 0.97, f).when(identity >= 0.999, f * f * f * f).otherwise(f * f)
    return F.when(rep_len > 0, _trunc(q * (1 - g) + 0.499)).otherwise(q)


def single(err: Column, second: Column, n_best: Column, n_second: Column, aln_len: Column, read_len: Column, rep_len: Column, slack: int = 8) -> Column:
    length = F.greatest(aln_len, read_len)
    identity = 1 - err / length
    other = F.least(second, err + slack)
    t = F.when(length < 50, F.lit(1.0)).otherwise(3 / F.log(length.cast("double"))) * identity * identity
    raw = F.when(n_best > 1, F.lit(0)).otherwise(_trunc(5 * 6.02 * (other - err) * t * t + 0.499))
    return _repeats(_clamp(raw - _penalty(n_second)), identity, rep_len, length)


def paired(q1: Column, q2: Column, m1: Column, m2: Column, min_sum: Column, second_sum: Column, n_best: Column, n_second: Column, rep_len: Column, length: Column, force: int = -1) -> Column:
    """q1, q2: the mates' own qualities; m1, m2: their errors. force >= 0 bounds the result."""
    gap = F.least(second_sum, m1 + m2 + 3) - min_sum
    pe = F.when(n_best > 1, F.lit(0)).otherwise(_clamp(_trunc(30.1 * gap + 0.499) - _penalty(n_second)))
    pe = _repeats(pe, 1 - min_sum / length, rep_len, length)

    def mate(q: Column) -> Column:
        raised = F.when(q > pe, q).otherwise(F.least(pe, _trunc(q + 0.65 * pe)))
        return F.least(F.lit(60), _trunc(1.2 * raised))

    q = F.least(mate(q1), mate(q2))
    return F.when((q < 60) & (F.lit(force) >= 0) & (F.lit(force) < q), F.lit(force)).otherwise(q)
