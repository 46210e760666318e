"""Point events from tables without coordinates: places are arithmetic on keys, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.grid import GridSpec

#: The places' box, and the grid that the registered queries use: 10 x 10 cells of 2 km.
BBOX = (0.0, 0.0, 20000.0, 20000.0)
GRID = GridSpec.of_bbox(BBOX, 2000.0)


def _place(u: Column, e: Column, a: int, b: int, step: int) -> Column:
    return ((u * a) % 20000 * ((u * b) % 20000)).cast("double") / F.lit(20000.0).cast("double") + (e * step) % 200


def _points(rows: DataFrame, key: str, event: str, when: str, kind: str) -> DataFrame:
    u, e = F.col(key), F.col(event)
    return rows.select(e.alias("event_id"), _place(u, e, 7919, 104729, 31).alias("x"), _place(u, e, 15485863, 32452843, 37).alias("y"), F.col(when).alias("datetime"), F.col(kind).alias("crime_type"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as points; 30 days."""
    return points_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def points_of_events(rows: DataFrame) -> DataFrame:
    """Rows of the events table, a stream's too, as points."""
    return _points(rows, "user_id", "event_id", "ts", "event_type")


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as points, placed by customer; 80 months."""
    return _points(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
