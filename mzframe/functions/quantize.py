"""What the lossy transforms do to values, and the fixed point that keeps one of them in range.

Their round trip acts on each value alone, so it is plain arithmetic: no bytes are needed to know
what a token would give back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mzframe import registry as R


def safe_slof_fp(largest: Column, desired: Column | int = R.SLOF_FP) -> Column:
    """The largest whole fixed point up to the desired one whose codes fit 16 bits; null or small maxima count as 1."""
    desired = F.lit(desired) if isinstance(desired, int) else desired
    top = F.greatest(F.coalesce(largest, F.lit(1.0)), F.lit(1.0))
    bound = F.lit(65535.0) / (F.ln(top + 1) + F.lit(1e-9))
    return F.greatest(F.lit(1), F.floor(F.least(desired.cast("double"), bound))).cast("bigint")


def linear_code(x: Column, fp: Column | int = R.LINEAR_FP) -> Column:
    return F.floor(x * fp + 0.5).cast("bigint")


def linear_round_trip(x: Column, fp: Column | int = R.LINEAR_FP) -> Column:
    return linear_code(x, fp) / (F.lit(fp) if isinstance(fp, int) else fp)


def slof_code(x: Column, fp: Column | int) -> Column:
    return F.floor(F.ln(x + 1) * fp + 0.5).cast("bigint")


def slof_round_trip(x: Column, fp: Column | int) -> Column:
    return F.exp(slof_code(x, fp) / (F.lit(fp) if isinstance(fp, int) else fp)) - 1


def pic_round_trip(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def fits_linear(values: Column, fp: Column | int = R.LINEAR_FP) -> Column:
    """Whether all codes and second differences of an array keep to 32 bits: beyond it the linear transform would wrap."""
    return F.coalesce(F.array_max(values) * fp < float(1 << 29), F.lit(True))


def has_negative(values: Column) -> Column:
    return F.coalesce(F.array_min(values) < 0, F.lit(False))


def is_whole(values: Column) -> Column:
    return F.forall(values, lambda v: v == F.rint(v))
