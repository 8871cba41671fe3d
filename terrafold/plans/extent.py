"""Dataset extent: the one-pass count and bounding box that sizes everything else."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.values import known


def extent(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: n, min_x, min_y, max_x, max_y. An empty input gives n = 0 and nulls; coordinates that are not
    finite count as missing."""

    return points.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(known(x)).alias("min_x"),
        F.min(known(y)).alias("min_y"),
        F.max(known(x)).alias("max_x"),
        F.max(known(y)).alias("max_y"),
    )


@dataclass(frozen=True)
class Extent:
    """The same numbers on the driver, used as literals in later plans."""

    n: int
    min_x: float
    min_y: float
    max_x: float
    max_y: float

    @classmethod
    def of(cls, points: DataFrame, x: str = "x", y: str = "y") -> Extent:
        row = extent(points, x, y).first()
        if not row["n"] or row["min_x"] is None or row["min_y"] is None:
            return cls(row["n"], 0.0, 0.0, 0.0, 0.0)
        return cls(row["n"], row["min_x"], row["min_y"], row["max_x"], row["max_y"])

    @property
    def width(self) -> float:
        return self.max_x - self.min_x

    @property
    def height(self) -> float:
        return self.max_y - self.min_y

    @property
    def area(self) -> float:
        return self.width * self.height

    @property
    def box(self) -> tuple[float, float, float, float]:
        return self.min_x, self.min_y, self.max_x, self.max_y
