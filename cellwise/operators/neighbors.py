"""Neighbour cells on the grid, by moving values to their neighbours instead of joining cells with cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions.grid import GridSpec

QUEEN = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]
ROOK = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def neighbour_sums(grid: DataFrame, spec: GridSpec, value: str, with_self: bool, offsets: list[tuple[int, int]] = QUEEN, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """Per cell (and keys): n_sum, the sum of value over its neighbours, and deg, how many there are.

    Each cell sends its value to its nine cells or fewer; rows grow by that factor at most, and one shuffle by cell sums them.
    """
    moves = [*offsets, *([(0, 0)] if with_self else [])]
    array = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in moves])
    sent = grid.select(*keys, "row", "col", F.col(value).alias("v"), F.explode(array).alias("m"))
    to = sent.select(*keys, (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"), "v")
    inside = to.where(F.col("row").between(0, spec.nrows - 1) & F.col("col").between(0, spec.ncols - 1))
    return inside.groupBy(*keys, "row", "col").agg(F.sum("v").alias("n_sum"), F.count("*").alias("deg"))


def degree(spec: GridSpec) -> Column:
    """Queen neighbours of a cell, from its row and col."""
    line = lambda c, n: (F.when(F.col(c) > 0, 1).otherwise(0) + F.when(F.col(c) < n - 1, 1).otherwise(0) + 1)
    return line("row", spec.nrows) * line("col", spec.ncols) - 1


def edges(grid_cells: DataFrame, spec: GridSpec, offsets: list[tuple[int, int]] = QUEEN) -> DataFrame:
    """The weights as a table: src, dst, w (binary) and w_std (row-standardised)."""
    array = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets])
    sent = grid_cells.select("row", "col", F.explode(array).alias("m")).select("row", "col", (F.col("row") + F.col("m.dr")).alias("r2"), (F.col("col") + F.col("m.dc")).alias("c2"))
    inside = sent.where(F.col("r2").between(0, spec.nrows - 1) & F.col("c2").between(0, spec.ncols - 1))
    line = lambda c, n: F.when(F.col(c) > 0, 1).otherwise(0) + F.when(F.col(c) < n - 1, 1).otherwise(0)
    many = degree(spec) if offsets is QUEEN else line("row", spec.nrows) + line("col", spec.ncols)
    return inside.select(spec.flat(F.col("row"), F.col("col")).alias("src"), spec.flat(F.col("r2"), F.col("c2")).alias("dst"), F.lit(1.0).alias("w"), (F.lit(1.0) / many).alias("w_std"))
