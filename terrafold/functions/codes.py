"""Quad codes: the digit string, or the integer, of the quadrants a point falls into.

Digits per level are 0 = upper left, 1 = upper right, 2 = lower left, 3 = lower right. Reading the digits as
one base-4 number gives a Z-order in which every quadrant of every level is one contiguous range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.values import known
from terrafold.plans.extent import Extent

# Fixed value: the boundary is widened by this much on its high sides before it is quartered.
EDGE_PAD = 0.01
MAX_DEPTH = 26  # 52 bits, exact in a double


def check_depth(depth: int) -> int:
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be in 1..{MAX_DEPTH}, got {depth}")
    return depth


def add_quad_number(
    points: DataFrame, ext: Extent, depth: int, name: str = "quad", x: str = "x", y: str = "y", pad: float = EDGE_PAD
) -> DataFrame:
    """Add the base-4 quad number at ``depth``; null for missing points and those outside the padded extent."""
    check_depth(depth)
    cells = float(2**depth)

    def slot(axis: str, low: float, width: float) -> Column:
        s = F.floor((known(axis) - F.lit(low)) / F.lit(width + pad) * F.lit(cells)).cast("bigint")
        return F.when((s >= 0) & (s < int(cells)), s)

    # the slots are columns of their own so that they are computed once, not once per digit
    staged = points.withColumns({"__qx": slot(x, ext.min_x, ext.width), "__qy": slot(y, ext.min_y, ext.height)})
    number = F.lit(0).cast("bigint")
    for level in range(1, depth + 1):
        shift = depth - level
        right = F.shiftright("__qx", shift).bitwiseAND(1)
        upper = F.shiftright("__qy", shift).bitwiseAND(1)
        number = F.shiftleft(number, 2) + (1 - upper) * 2 + right
    return staged.withColumn(name, number).drop("__qx", "__qy")


def quad_text(number: Column, depth: int) -> Column:
    """The digit string of a quad number."""
    return F.lpad(F.conv(number.cast("string"), 10, 4), depth, "0")
