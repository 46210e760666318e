"""The regular grid: which cell a point is in, and the cells themselves."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A grid of nrows x ncols square cells from (minx, miny). Rows go up with y, columns with x."""

    cell_size: float
    minx: float
    miny: float
    nrows: int
    ncols: int

    @staticmethod
    def of_bbox(bbox: tuple[float, float, float, float], cell_size: float) -> GridSpec:
        minx, miny, maxx, maxy = bbox
        return GridSpec(cell_size, minx, miny, max(1, math.ceil((maxy - miny) / cell_size)), max(1, math.ceil((maxx - minx) / cell_size)))

    @staticmethod
    def fit(points: DataFrame, cell_size: float) -> GridSpec:
        """The grid over the points' own bounds: one row of four numbers reaches the driver."""
        box = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        return GridSpec.of_bbox(tuple(v if v is not None else 0.0 for v in box), cell_size)

    @property
    def n_cells(self) -> int:
        return self.nrows * self.ncols

    def row(self, y: Column) -> Column:
        """Points outside the grid belong to the nearest edge cell."""
        return F.least(F.greatest(F.floor((y - F.lit(self.miny)) / self.cell_size), F.lit(0)), F.lit(self.nrows - 1)).cast("int")

    def col(self, x: Column) -> Column:
        return F.least(F.greatest(F.floor((x - F.lit(self.minx)) / self.cell_size), F.lit(0)), F.lit(self.ncols - 1)).cast("int")

    def flat(self, row: Column, col: Column) -> Column:
        return (row * self.ncols + col).cast("int")

    def inside(self, x: Column, y: Column) -> Column:
        return x.between(self.minx, self.minx + self.ncols * self.cell_size) & y.between(self.miny, self.miny + self.nrows * self.cell_size)

    def assign(self, points: DataFrame, drop_outside: bool = False) -> DataFrame:
        """points with row, col and flat_idx; points without coordinates go."""
        rows = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
        if drop_outside:
            rows = rows.where(self.inside(F.col("x"), F.col("y")))
        rows = rows.withColumns({"row": self.row(F.col("y")), "col": self.col(F.col("x"))})
        return rows.withColumn("flat_idx", self.flat(F.col("row"), F.col("col")))

    def cells(self, spark: SparkSession) -> DataFrame:
        """flat_idx, row, col, bounds and centre of every cell."""
        index = spark.range(self.n_cells).select(F.col("id").cast("int").alias("flat_idx"), F.expr(f"CAST(id DIV {self.ncols} AS INT)").alias("row"), F.expr(f"CAST(id % {self.ncols} AS INT)").alias("col"))
        x, y, size = F.lit(self.minx), F.lit(self.miny), self.cell_size
        return index.withColumns(
            {
                "minx": x + F.col("col") * size,
                "miny": y + F.col("row") * size,
                "maxx": x + (F.col("col") + 1) * size,
                "maxy": y + (F.col("row") + 1) * size,
                "cx": x + (F.col("col") + 0.5) * size,
                "cy": y + (F.col("row") + 0.5) * size,
            }
        )
