"""Long literals, written as one SQL text: one call to the JVM instead of one per element."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def double_text(value: float) -> str:
    if math.isfinite(value):
        return f"{float(value)!r}D"
    name = "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    return f"double('{name}')"


def double_array(values: Iterable[float]) -> Column:
    return F.expr(f"array({', '.join(map(double_text, values))})")


def is_one_of(column: str, ids: Iterable[int]) -> Column:
    """column IN (ids); false for no ids."""
    listed = ", ".join(str(int(i)) for i in ids)
    return F.expr(f"{column} IN ({listed})") if listed else F.lit(False)
