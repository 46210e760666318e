"""Getis-Ord Gi*, Mann-Kendall trends and emerging hotspots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.functions.grid import GridSpec
from cellwise.functions.numerics import kendall_s
from cellwise.functions.stats import two_sided_p, z_threshold
from cellwise.operators.forecast import by_length, series_of
from cellwise.operators.neighbors import neighbour_sums


def gi_star(cube: DataFrame, spec: GridSpec) -> DataFrame:
    """The cube with gi_z, per period. Binary queen weights with the cell itself; 0 where a period has no variance.

    Neighbour sums and the cell's own value come out of one shuffle; a period's mean and deviation out of a small aggregate.
    """
    n = spec.n_cells
    sums = neighbour_sums(cube, spec, "count", with_self=True)
    per_t = cube.groupBy("t").agg(F.avg("count").alias("mean"), F.stddev_pop("count").alias("sd"))
    joined = cube.join(sums, ["t", "row", "col"]).join(per_t, "t")
    spread = F.sqrt((n * F.col("deg") - F.col("deg") * F.col("deg")) / F.lit(float(max(n - 1, 1))))
    z = (F.col("n_sum") - F.col("mean") * F.col("deg")) / (F.col("sd") * spread)
    return joined.select("t", "row", "col", "flat_idx", "count", F.when((F.col("sd") == 0) | (spread == 0), 0.0).otherwise(z).alias("gi_z"))


def mann_kendall_columns(n: Column, s: Column, alpha: float = 0.05) -> dict[str, Column]:
    """z without a correction for ties, its sign as the trend, and whether it is significant; under four values there is none."""
    var = n * (n - 1) * (2 * n + 5) / 18.0
    z = F.when((n < 4) | (s == 0), 0.0).otherwise((s - F.signum(s)) / F.sqrt(var))
    significant = F.abs(z) > z_threshold(alpha)
    trend = F.when(z > 0, "increasing").when(z < 0, "decreasing").otherwise("no trend")
    return {"z": z, "trend": trend, "significant": significant}


def mann_kendall(panel: DataFrame, value: str = "count", keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Per series: n, s, z, trend, significant. A task's series are counted together, each in n log n steps; pairs never become rows."""
    series = series_of(panel.where(F.col(value).isNotNull()), *keys, value=value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, x in by_length(pdf):
                yield rows[list(keys)].assign(n=np.int32(x.shape[1]), s=kendall_s(x).astype(float))

    rows = series.mapInPandas(run, T.StructType([*series.select(*keys).schema.fields, T.StructField("n", T.IntegerType()), T.StructField("s", T.DoubleType())]))
    return rows.withColumns(mann_kendall_columns(F.col("n"), F.col("s")))


def with_p(trends: DataFrame) -> DataFrame:
    return trends.withColumn("p", F.when(F.col("n") < 4, 1.0).otherwise(two_sided_p(F.col("z"))))


def classify(gi: DataFrame, spec: GridSpec, n_periods: int, alpha: float = 0.05, persistent: float = 0.9, recent_two_steps: bool = False) -> DataFrame:
    """Per cell its emerging-hotspot category, from gi_z of all periods and the Mann-Kendall trend of it.

    recent_two_steps: a historical spot is one outside the last two periods; else, outside the last and the first.
    """
    limit = z_threshold(alpha)
    z = F.round("gi_z", 9)
    signs = gi.select("t", "row", "col", "flat_idx", "count", "gi_z", (z > limit).alias("hot"), (z < -limit).alias("cold"))
    last, before = n_periods - 1, n_periods - 2 if recent_two_steps else 0

    def at(flag: str, t: int) -> Column:
        return F.bool_or(F.when(F.col("t") == t, F.col(flag)).otherwise(False))

    facts = signs.groupBy("row", "col", "flat_idx").agg(
        F.sum("count").alias("total_count"),
        F.avg("gi_z").alias("mean_gi_z"),
        F.max_by("gi_z", "t").alias("last_gi_z"),
        *[
            made.alias(f"{flag}_{name}")
            for flag in ("hot", "cold")
            for name, made in {
                "any": F.bool_or(flag),
                "share": F.avg(F.col(flag).cast("double")),
                "last": at(flag, last),
                "two": at(flag, max(n_periods - 2, 0)),
                "gone": at(flag, max(before, 0)),
                "old": F.bool_or(F.when(F.col("t") < last, F.col(flag)).otherwise(False)),
            }.items()
        ],
    )
    trends = mann_kendall(gi.withColumn("gi_z", F.round("gi_z", 9)), "gi_z").select("row", "col", F.col("z").alias("mk_z"), F.col("trend").alias("mk_trend"), "significant")

    def kind(flag: str, name: str, up: str, down: str) -> Column:
        f = lambda x: F.col(f"{flag}_{x}")
        return (
            F.when(f("share") >= persistent, F.when(F.col("significant") & (F.col("mk_trend") == up), f"INTENSIFYING_{name}").when(F.col("significant") & (F.col("mk_trend") == down), f"DIMINISHING_{name}").otherwise(f"PERSISTENT_{name}"))
            .when(~f("last") & ~f("gone"), f"HISTORICAL_{name}")
            .when(f("last") & ~f("old"), f"NEW_{name}")
            .when(f("last") & f("two"), f"CONSECUTIVE_{name}")
            .otherwise(f"SPORADIC_{name}")
        )

    category = (
        F.when(F.col("hot_any") & F.col("cold_any"), "OSCILLATING_HOTSPOT")
        .when(F.col("hot_any"), kind("hot", "HOTSPOT", "increasing", "decreasing"))
        .when(F.col("cold_any"), kind("cold", "COLDSPOT", "decreasing", "increasing"))
        .otherwise("NO_PATTERN")
    )
    return facts.join(trends, ["row", "col"]).select("flat_idx", "row", "col", "total_count", "mean_gi_z", "last_gi_z", "mk_z", "mk_trend", category.alias("category"))


def summary(categories: DataFrame) -> DataFrame:
    return categories.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def top_cells(gi: DataFrame, k: int = 10) -> DataFrame:
    """The k hottest cells of the last period: ties by cell."""
    last = gi.join(gi.agg(F.max("t").alias("t")), "t")
    return last.orderBy(F.desc("gi_z"), "flat_idx").limit(k)
