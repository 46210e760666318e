"""The space-time cube: events counted by period and cell, as a long table with every cell of every period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.grid import GridSpec
from cellwise.functions.period import Periods


def densify(counts: DataFrame, spark: SparkSession, spec: GridSpec, n_periods: int) -> DataFrame:
    """t, row, col, flat_idx, count with zeros where counts (t, flat_idx, n) has no row."""
    cells, index = spec.n_cells, F.col("id")
    every = spark.range(n_periods * cells).select((F.expr(f"id DIV {cells}")).cast("int").alias("t"), (index % cells).cast("int").alias("flat_idx"))
    return every.join(counts, ["t", "flat_idx"], "left").select(
        "t",
        F.expr(f"CAST(flat_idx DIV {spec.ncols} AS INT)").alias("row"),
        (F.col("flat_idx") % spec.ncols).cast("int").alias("col"),
        "flat_idx",
        F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("count"),
    )


def count_cube(events: DataFrame, spec: GridSpec, periods: Periods, drop_outside: bool = False) -> DataFrame:
    """The cube of events (x, y, datetime). Events without a time or place are in no cell.

    One shuffle of at most a row per task, period and cell: the counts are aggregated before it.
    """
    placed = spec.assign(events, drop_outside).withColumn("t", periods.index(F.col("datetime")))
    counts = placed.where(F.col("t").between(0, periods.n - 1)).groupBy("t", "flat_idx").agg(F.count("*").alias("n"))
    return densify(counts, events.sparkSession, spec, periods.n)


def event_counts(events: DataFrame, spec: GridSpec) -> DataFrame:
    """Events per cell, without time: flat_idx, row, col, actual."""
    counts = spec.assign(events).groupBy("flat_idx").agg(F.count("*").alias("n")).withColumn("t", F.lit(0))
    return densify(counts, events.sparkSession, spec, 1).select("flat_idx", "row", "col", F.col("count").alias("actual"))


def totals(cube: DataFrame) -> DataFrame:
    """Per cell the sum and the mean over the periods."""
    return cube.groupBy("flat_idx", "row", "col").agg(F.sum("count").alias("total"), F.avg("count").alias("mean"))


def active_cells(cube: DataFrame, min_total: float = 3) -> DataFrame:
    return totals(cube).where(F.col("total") >= min_total)


def most_active(cube: DataFrame, k: int = 3, min_total: float = 10) -> DataFrame:
    """The k active cells with most events: ties by cell."""
    return active_cells(cube, min_total).orderBy(F.desc("total"), "flat_idx").limit(k)


def time_slice(cube: DataFrame, t: int, n_periods: int) -> DataFrame:
    """One period's grid; -1 is the last."""
    return cube.where(F.col("t") == (t if t >= 0 else n_periods + t))


def cell_series(cube: DataFrame, row: int, col: int) -> DataFrame:
    return cube.where((F.col("row") == row) & (F.col("col") == col)).orderBy("t")


def panel(cube: DataFrame, periods: Periods) -> DataFrame:
    """The cube with its periods' labels."""
    return cube.withColumn("period", periods.label(F.col("t")))


def bounding_box(events: DataFrame) -> DataFrame:
    return events.agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


def value_counts(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("n"))


def hexbin(events: DataFrame, size: float) -> DataFrame:
    """Counts by hexagon: the nearer of the two interleaved lattices' points, with that point as the hexagon's centre."""
    high = size * 3**0.5
    ax, ay = F.round(F.col("x") / size), F.round(F.col("y") / high)
    bx, by = F.floor(F.col("x") / size), F.floor(F.col("y") / high)
    to_a = F.pow(F.col("x") / size - ax, 2) + 3 * F.pow(F.col("y") / high - ay, 2)
    to_b = F.pow(F.col("x") / size - bx - 0.5, 2) + 3 * F.pow(F.col("y") / high - by - 0.5, 2)
    first = to_a <= to_b
    centre = events.select(F.when(first, ax).otherwise(bx + 0.5).alias("hx"), F.when(first, ay).otherwise(by + 0.5).alias("hy"))
    return centre.groupBy("hx", "hy").agg(F.count("*").alias("n"))


def exact_sample(events: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed: those with the lowest hash of their id."""
    return events.orderBy(F.xxhash64("event_id", F.lit(seed)), "event_id").limit(n)
