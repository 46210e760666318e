"""Per-cell forecasts, their smoothing over the grid, risk and hotspot masks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.functions import numerics
from cellwise.functions.grid import GridSpec
from cellwise.operators.quantile import percentiles

Z95 = 1.96


def mean_forecast(cube: DataFrame, train_end: int) -> DataFrame:
    """Per cell: yhat, lower, upper from the mean and the deviation of the periods before train_end."""
    rows = cube.where(F.col("t") < train_end).groupBy("row", "col", "flat_idx").agg(F.avg("count").alias("m"), F.stddev_pop("count").alias("s"))
    m = F.greatest("m", F.lit(0.0))
    return rows.select("flat_idx", "row", "col", m.alias("yhat"), F.greatest(m - Z95 * F.col("s"), F.lit(0.0)).alias("lower"), (m + Z95 * F.col("s")).alias("upper"))


def route(cube: DataFrame, train_end: int, min_obs_arima: int = 8, use_seasonal: bool = False) -> DataFrame:
    """Per cell the model that its training series is for."""
    rows = cube.where(F.col("t") < train_end).groupBy("row", "col", "flat_idx")
    facts = rows.agg(F.sum("count").alias("total"), F.sum((F.col("count") > 0).cast("int")).alias("nonzero"), F.count("*").alias("n"))
    some, n = F.col("nonzero"), F.col("n")
    choice = F.when(F.col("total") == 0, "zero")
    if use_seasonal:
        choice = choice.when((some >= 12) & (n >= 18), "seasonal")
    choice = choice.when((some >= min_obs_arima) & (n >= 12), "arima").when(some >= 3, "ses").otherwise("mean")
    return facts.select("flat_idx", "row", "col", "total", some.cast("long").alias("nonzero"), choice.alias("model"))


def model_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("model").agg(F.count("*").alias("n"))


MODELS = ("seasonal", "arima", "ses", "mean")


def _predicted(x: np.ndarray, model: str, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point, lower and upper of each lane (series of one length) under one model; not finite where it fails."""
    if model == "seasonal":
        return tuple(np.stack(v) for v in zip(*(numerics.seasonal(own, steps) for own in x), strict=True))
    if model == "arima":
        point, spread = np.full((len(x), steps), np.nan), np.full((len(x), steps), np.nan)
        still = numerics.adf_many(x)[1] < 0.05
        for d, lanes in ((0, np.flatnonzero(still)), (1, np.flatnonzero(~still))):
            if len(lanes):
                point[lanes], spread[lanes] = numerics.arima_many(x[lanes], d, steps)
    else:
        level, sd = numerics.ses_many(x) if model == "ses" else (x.mean(axis=1), x.std(axis=1))
        point, spread = np.repeat(level[:, None], steps, axis=1), np.repeat(sd[:, None], steps, axis=1)
    point = np.maximum(point, 0)
    return point, point - Z95 * spread, point + Z95 * spread


def predict_many(x: np.ndarray, models: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The model that worked for each lane (a failing one falls through to the next), and point, lower and upper (lanes x 3 x steps), none below 0."""
    used, out = models.astype(object), np.zeros((len(x), 3, steps))
    for model, following in zip(MODELS, (*MODELS[1:], None), strict=True):
        lanes = np.flatnonzero(used == model)
        if not len(lanes):
            continue
        with np.errstate(all="ignore"):
            out[lanes] = np.stack(_predicted(x[lanes], model, steps), axis=1)
        failed = lanes[~np.isfinite(out[lanes]).all(axis=(1, 2))]
        if following and len(failed):
            used[failed] = following
    return used, np.maximum(out, 0)


def series_of(cube: DataFrame, *keys: str, value: str = "count") -> DataFrame:
    """keys and x, the values of each cell in the order of periods: a row a cell."""
    return cube.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", F.col(value).cast("double").alias("v")))), lambda p: p["v"]).alias("x"))


def by_length(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows with series of one length, and these as lanes."""
    for n, rows in pdf.groupby(pdf["x"].map(len)):
        yield rows, np.stack(rows["x"]).reshape(len(rows), n)


def forecast_cells(cube: DataFrame, train_end: int, steps: int, min_obs_arima: int = 8, use_seasonal: bool = False) -> DataFrame:
    """step, flat_idx, row, col, model, yhat, lower, upper: cells are routed beforehand; a task's cells are forecast together."""
    keys = ["flat_idx", "row", "col"]
    models = route(cube, train_end, min_obs_arima, use_seasonal).select("flat_idx", "model")
    series = series_of(cube.where(F.col("t") < train_end), *keys).join(models, "flat_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, x in by_length(pdf):
                used, found = predict_many(x, rows["model"].to_numpy(), steps)
                head = {c: np.repeat(rows[c].to_numpy(), steps) for c in keys}
                values = {c: found[:, k].reshape(-1) for k, c in enumerate(("yhat", "lower", "upper"))}
                yield pd.DataFrame({"step": np.tile(np.arange(steps, dtype="int32"), len(rows)), **head, "model": np.repeat(used, steps), **values})

    return series.mapInPandas(run, "step int, flat_idx int, row int, col int, model string, yhat double, lower double, upper double")


def taps(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights of the Gaussian filter: to four deviations, normalised."""
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [(k - radius, w / sum(weights)) for k, w in enumerate(weights)]


def gaussian_smooth(grid: DataFrame, spec: GridSpec, value: str, sigma: float = 0.8, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, value smoothed; the border reflects half a cell out, so the sum stays. Rows first, then columns."""
    out = grid.select(*keys, "row", "col", F.col(value).cast("double").alias(value))
    if sigma <= 0:
        return out
    array = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in taps(sigma)])
    for axis, n in (("row", spec.nrows), ("col", spec.ncols)):
        # A value goes to the cells that see it, at its place and at its mirror images.
        other = "col" if axis == "row" else "row"
        spot = F.pmod(F.col(axis) + F.col("tap.k"), F.lit(2 * n))
        folded = F.when(spot >= n, 2 * n - 1 - spot).otherwise(spot)
        sent = out.select(*keys, F.col(axis), other, value, F.explode(array).alias("tap")).withColumn("_to", folded.cast("int"))
        out = sent.groupBy(*keys, F.col("_to").alias(axis), other).agg(F.sum(F.col(value) * F.col("tap.w")).alias(value)).select(*keys, "row", "col", value)
    return out


def fit_predict(cube: DataFrame, spec: GridSpec, train_end: int, steps: int, sigma: float = 0.8, **options) -> DataFrame:
    """step, row, col, yhat, lower, upper: forecasts of every cell, each surface smoothed on its own."""
    cells = forecast_cells(cube, train_end, steps, **options)
    smooth = [gaussian_smooth(cells, spec, c, sigma, ("step",)) for c in ("yhat", "lower", "upper")]
    return smooth[0].join(smooth[1], ["step", "row", "col"]).join(smooth[2], ["step", "row", "col"])


def uncertainty(forecast: DataFrame) -> DataFrame:
    return forecast.withColumn("width", F.col("upper") - F.col("lower"))


def summed(forecast: DataFrame, value: str = "yhat") -> DataFrame:
    """The steps' forecasts of a cell added up."""
    return forecast.groupBy("row", "col").agg(F.sum(value).alias(value))


def risk_surface(grid: DataFrame, value: str = "yhat") -> DataFrame:
    """grid with risk: 0 at the least value, 1 at the greatest; 0 everywhere on a flat grid."""
    ends = grid.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    risk = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return grid.join(F.broadcast(ends)).withColumn("risk", risk).drop("_lo", "_hi")


def hotspot_mask(grid: DataFrame, percentile: float = 80, value: str = "risk") -> DataFrame:
    """grid with hotspot: value at or over its percentile, ties included."""
    limit = percentiles(grid, value, [percentile / 100]).select(F.round("percentile", 9).alias("_limit"))
    return grid.join(F.broadcast(limit)).withColumn("hotspot", F.round(value, 9) >= F.col("_limit")).drop("_limit")
