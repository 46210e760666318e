"""Periods: the start of a period, and its place in the complete range of periods."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = {"M": "month", "ME": "month", "D": "day", "W": "week", "H": "hour", "Q": "quarter", "Y": "year"}
FORMATS = {"month": "yyyy-MM", "day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:00", "quarter": "yyyy-'Q'q", "year": "yyyy"}


@dataclass(frozen=True)
class Periods:
    """n consecutive periods of a unit (one of UNITS' values, or step of them) from start."""

    unit: str
    start: dt.datetime
    n: int
    step: int = 1

    @staticmethod
    def fit(events: DataFrame, freq: str = "M", step: int = 1, column: str = "datetime") -> Periods:
        """From the first to the last event, empty periods between them included."""
        unit = UNITS[freq]
        ends = events.agg(F.date_trunc(unit, F.min(column)).alias("a"), F.max(column).alias("b"))
        row = ends.select("a", _between(unit, F.col("a"), F.col("b")).alias("n")).first()
        return Periods(unit, row["a"] or dt.datetime(1970, 1, 1), (row["n"] // step + 1) if row["n"] is not None else 0, step)

    def index(self, when: Column) -> Column:
        """Place of the period; null for null."""
        whole = _between(self.unit, self._start(), when)
        return (whole if self.step == 1 else F.floor(whole / self.step)).cast("int")

    def begins(self, t: Column) -> Column:
        """Start of the t-th period, also after the last."""
        many = t * self.step * (3 if self.unit == "quarter" else 12 if self.unit == "year" else 1)
        if self.unit in ("month", "quarter", "year"):
            return F.add_months(self._start().cast("date"), many).cast("timestamp_ntz")
        unit = {"week": "WEEK", "day": "DAY", "hour": "HOUR"}[self.unit]
        return F.timestamp_add(unit, many, self._start())

    def label(self, t: Column) -> Column:
        return F.date_format(self.begins(t), FORMATS[self.unit])

    def table(self, spark: SparkSession, first: int = 0, n: int | None = None) -> DataFrame:
        """t, period_start and label; first and n may reach beyond the range: future periods."""
        t = F.col("id").cast("int")
        return spark.range(first, first + (self.n if n is None else n)).select(t.alias("t"), self.begins(t).cast("date").alias("period_start"), self.label(t).alias("label"))

    def _start(self) -> Column:
        return F.lit(self.start.isoformat(sep=" ")).cast("timestamp_ntz")


def _between(unit: str, a: Column, b: Column) -> Column:
    """Whole periods from a, a period's start, to b."""
    if unit in ("month", "quarter", "year"):
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        return F.floor(months / {"month": 1, "quarter": 3, "year": 12}[unit]).cast("int")
    if unit == "hour":
        return F.timestamp_diff("HOUR", a, b).cast("int")
    return F.floor(F.datediff(b, a) / {"day": 1, "week": 7}[unit]).cast("int")
