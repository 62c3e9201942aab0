"""Arithmetic of doubles by IEEE rules, where Spark's own raises or gives null."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def divide(a: Column, b: Column) -> Column:
    """a / b; x / 0 is an infinity with the sign of both, 0 / 0 is NaN."""
    sign = F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * sign * F.lit(INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def log(x: Column) -> Column:
    """Natural logarithm: -inf of 0, NaN below."""
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.ln(x))


def compare(op: str, a: Column, b: Column) -> Column:
    """``eq ne lt le gt ge`` where NaN equals nothing and is not ordered."""
    plain = getattr(operator, op)(a, b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(op == "ne")).otherwise(plain)


def clamp(x: Column, low: float = -1e300, high: float = 1e300) -> Column:
    """max(low, min(high, x)): low wins where low > high, NaN becomes high."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def round_to(x: Column, digits: int) -> Column:
    """C's round (half away from zero) of x * 10^digits; Spark's goes by the decimal text, at some microseconds a value."""
    scaled = F.abs(x) * 10.0**digits
    near = F.rint(scaled)
    whole = F.when(scaled - near == 0.5, near + 1.0).otherwise(near)
    return F.when(scaled < 2.0**52, F.signum(x) * whole / 10.0**digits).otherwise(x)  # from there on, and for NaN, nothing to round
