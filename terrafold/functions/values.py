"""Which coordinates count: null, NaN and infinite values are missing everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR_TIE = 1e-6


def finite(name: str | Column) -> Column:
    """Neither null nor NaN nor infinite; false, never null."""
    value = F.col(name) if isinstance(name, str) else name
    # NaN is above every number in Spark's order
    return value.isNotNull() & (F.abs(value.cast("double")) < F.lit(float("inf")))


def known(name: str | Column) -> Column:
    """The value where it is finite, else null."""
    value = F.col(name) if isinstance(name, str) else name
    return F.when(finite(value), value.cast("double"))


def rounded(value: Column, digits: int) -> Column:
    """``F.round`` of a double, number for number, without a decimal per row.

    A scaled value below 1e9 is exact to far less than NEAR_TIE, so only values beside a tie, and larger or missing ones,
    need the decimal."""
    scale = F.lit(10.0**digits)
    scaled = value * scale
    down = F.floor(scaled)
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - down - 0.5) > NEAR_TIE)
    return F.when(plain, F.floor(scaled + 0.5) / scale).otherwise(F.round(value, digits))
