"""Regression on the panel: OLS, spatial lag (two-stage least squares), spatial error (moments), geographically weighted.

Spark reduces the panel to cross products; only matrices of a few columns are solved on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.grid import GridSpec
from cellwise.functions.numerics import nelder_mead
from cellwise.operators.neighbors import neighbour_sums
from cellwise.operators.spatial_join import block_pairs

FEATURES = ["y_lag1", "sp_lag", "trend", "sin", "cos"]


def features(cube: DataFrame, spec: GridSpec) -> DataFrame:
    """t, row, col, flat_idx, y and FEATURES: the cell's last count, its neighbours' mean of last counts, trend and season.

    Before the first period stands the first period itself.
    """
    series = Window.partitionBy("flat_idx").orderBy("t")
    lagged = cube.withColumn("y_lag1", F.coalesce(F.lag("count").over(series), F.col("count")))
    sums = neighbour_sums(lagged, spec, "y_lag1", with_self=False)
    turn = F.col("t") % 12 * (2 * math.pi / 12)
    joined = lagged.join(sums, ["t", "row", "col"], "left")
    return joined.select(
        "t",
        "row",
        "col",
        "flat_idx",
        F.col("count").alias("y"),
        "y_lag1",
        F.coalesce(F.col("n_sum") / F.col("deg"), F.lit(0.0)).alias("sp_lag"),
        F.col("t").cast("double").alias("trend"),
        F.sin(turn).alias("sin"),
        F.cos(turn).alias("cos"),
    )


def gram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, value: sums of products of the columns (i <= j), in one aggregate without a shuffle of rows."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"_{n}") for n, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"_{n}").alias("value")) for n, (a, b) in enumerate(pairs)])).alias("g")).select("g.*")


def _matrix(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """The Gram matrix of the columns on the driver: a few dozen numbers."""
    out = np.zeros((len(columns), len(columns)))
    for r in gram(rows, columns).collect():
        i, j = columns.index(r["i"]), columns.index(r["j"])
        out[i, j] = out[j, i] = r["value"] or 0.0
    return out


@dataclass(frozen=True)
class Fit:
    """Coefficients by name; rho or lambda for the spatial models; a share of variance explained."""

    names: tuple[str, ...]
    beta: tuple[float, ...]
    r2: float
    spatial: float = 0.0

    def table(self, spark) -> DataFrame:
        rows = [*zip(self.names, map(float, self.beta), strict=True), ("spatial", float(self.spatial)), ("r2", float(self.r2))]
        return spark.createDataFrame(rows, "name string, value double")

    def linear(self) -> Column:
        terms = [F.lit(b) if n == "one" else F.col(n) * b for n, b in zip(self.names, self.beta, strict=True)]
        return reduce(lambda a, b: a + b, terms)


def _training(rows: DataFrame, train_end: int) -> DataFrame:
    return rows.where((F.col("t") >= 1) & (F.col("t") < train_end)).withColumn("one", F.lit(1.0))


def fit_ols(rows: DataFrame, train_end: int) -> Fit:
    names = ["one", *FEATURES]
    g = _matrix(_training(rows, train_end), [*names, "y"])
    k = len(names)
    beta = np.linalg.pinv(g[:k, :k]) @ g[:k, k]
    rss = g[k, k] - 2 * beta @ g[:k, k] + beta @ g[:k, :k] @ beta
    tss = g[k, k] - g[0, k] ** 2 / g[0, 0]
    return Fit(tuple(names), tuple(beta), 1 - rss / tss if tss > 1e-12 else 0.0)


def predict(fit: Fit, rows: DataFrame) -> DataFrame:
    """One step ahead from the actual last counts, none below 0: yhat beside the rows' keys."""
    return rows.withColumn("one", F.lit(1.0)).withColumn("yhat", F.greatest(fit.linear(), F.lit(0.0))).drop("one")


def _with_lags(rows: DataFrame, spec: GridSpec, columns: list[str]) -> DataFrame:
    """rows with w_<column>: the neighbours' mean within the period, the block-diagonal panel weights times the column."""
    out = rows
    for c in columns:
        sums = neighbour_sums(rows, spec, c, with_self=False).select("t", "row", "col", (F.col("n_sum") / F.col("deg")).alias(f"w_{c}"))
        out = out.join(sums, ["t", "row", "col"], "left").fillna(0.0, [f"w_{c}"])
    return out


def fit_sar(rows: DataFrame, spec: GridSpec, train_end: int) -> Fit:
    """Spatial lag by 2SLS with X and WX as instruments; the dependent ones among them count once (pseudo-inverse)."""
    own = _with_lags(_training(rows, train_end), spec, ["y", *FEATURES])
    x = ["one", *FEATURES]
    z, h = [*x, "w_y"], [*x, *[f"w_{f}" for f in FEATURES]]
    names = [*dict.fromkeys([*h, *z]), "y"]
    g = _matrix(own, names)
    at = lambda a, b: g[np.ix_([names.index(i) for i in a], [names.index(j) for j in b])]
    project = at(z, h) @ np.linalg.pinv(at(h, h), rcond=1e-10)
    beta = np.linalg.pinv(project @ at(h, z), rcond=1e-12) @ project @ at(h, ["y"])[:, 0]
    n = g[0, 0]
    fitted, both, yy = beta @ at(z, z) @ beta, beta @ at(z, ["y"])[:, 0], at(["y"], ["y"])[0, 0]
    my, mf = at(["one"], ["y"])[0, 0] / n, beta @ at(z, ["one"])[:, 0] / n
    spread = (fitted / n - mf**2) * (yy / n - my**2)
    return Fit(tuple(x), tuple(beta[:-1]), (both / n - my * mf) ** 2 / spread if spread > 1e-12 else 0.0, float(beta[-1]))


def predict_sar(fit: Fit, rows: DataFrame) -> DataFrame:
    """X beta / (1 - rho), none below 0."""
    scale = 1 / (1 - fit.spatial) if abs(1 - fit.spatial) > 1e-6 else 1.0
    return predict(Fit(fit.names, tuple(b * scale for b in fit.beta), fit.r2), rows)


def fit_sem(rows: DataFrame, spec: GridSpec, train_end: int) -> Fit:
    """Spatial error model: lambda by the moments of Kelejian and Prucha (1999), then least squares on filtered data."""
    train = _training(rows, train_end)
    ols = fit_ols(rows, train_end)
    u = _with_lags(train.withColumn("u", F.col("y") - ols.linear()), spec, ["u"])
    u = _with_lags(u, spec, ["w_u"])
    g = _matrix(u, ["one", "u", "w_u", "w_w_u"])
    n = g[0, 0]
    uu, ub, bb, uc, bc, cc = g[1, 1], g[1, 2], g[2, 2], g[1, 3], g[2, 3], g[3, 3]
    weights = train.select("row", "col").distinct()
    line = lambda c, m: F.when(F.col(c) > 0, 1).otherwise(0) + F.when(F.col(c) < m - 1, 1).otherwise(0) + 1
    deg = line("row", spec.nrows) * line("col", spec.ncols) - 1
    trace = (weights.agg(F.sum(F.when(deg > 0, 1.0 / deg).otherwise(0.0))).first()[0] or 0.0) / max(spec.n_cells, 1)
    left = np.array([[2 * ub / n, -bb / n, 1.0], [2 * bc / n, -cc / n, trace], [(uc + bb) / n, -bc / n, 0.0]])
    right = np.array([uu / n, bb / n, ub / n])
    cost = lambda p: float(((right - left @ np.array([np.tanh(p[0]), np.tanh(p[0]) ** 2, math.exp(p[1])])) ** 2).sum())
    lam = float(np.tanh(nelder_mead(cost, np.array([0.1, math.log(max(uu / n, 1e-9))]))[0]))
    both = _with_lags(train, spec, ["y", *FEATURES])
    cut = both.select((F.col("one") * (1 - lam)).alias("one"), *[(F.col(c) - lam * F.col(f"w_{c}")).alias(c) for c in ["y", *FEATURES]])
    names = ["one", *FEATURES]
    m = _matrix(cut, [*names, "y"])
    k = len(names)
    return Fit(tuple(names), tuple(np.linalg.pinv(m[:k, :k], rcond=1e-12) @ m[:k, k]), ols.r2, lam)


def gwr_features(cube: DataFrame, spec: GridSpec, t: int) -> DataFrame:
    """flat_idx, row, col, cx, cy, y, y_lag, dist_center (0 to 1) and seasonal of period t (at least 1)."""
    t = max(t, 1)
    y = cube.where(F.col("t").isin(t, t - 1)).groupBy("flat_idx").agg(F.sum(F.when(F.col("t") == t, F.col("count"))).alias("y"), F.sum(F.when(F.col("t") == t - 1, F.col("count"))).alias("y_lag"))
    mx, my = spec.minx + spec.ncols * spec.cell_size / 2, spec.miny + spec.nrows * spec.cell_size / 2
    cells = spec.cells(cube.sparkSession).select("flat_idx", "row", "col", "cx", "cy", F.sqrt(F.pow(F.col("cx") - mx, 2) + F.pow(F.col("cy") - my, 2)).alias("d"))
    far = cells.agg(F.max("d").alias("far"))
    joined = cells.join(F.broadcast(far)).join(y, "flat_idx", "left")
    dist = F.when(F.col("far") > 0, F.col("d") / F.col("far")).otherwise(0.0)
    season = math.sin(2 * math.pi * (t % 12) / 12)
    return joined.select("flat_idx", "row", "col", "cx", "cy", F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("y_lag", F.lit(0.0)).alias("y_lag"), dist.alias("dist_center"), F.lit(season).alias("seasonal"))


def cell_distance_quantiles(cells: DataFrame, shares: list[float]) -> DataFrame:
    """Percentiles of the distances between different cells. Equal steps of rows and columns are one weighted distance.

    On a grid the distance depends on the steps alone, so (nrows x ncols) weighted rows stand for all pairs.
    """
    n = cells.agg(F.max("row").alias("r"), F.max("col").alias("c"), (F.max("cx") - F.min("cx")).alias("wx"), (F.max("cy") - F.min("cy")).alias("wy"))
    steps = n.select("*", F.explode(F.sequence(F.lit(0), F.col("r"))).alias("dr")).select("*", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("dc")).where("dr + dc > 0")
    size = F.when(F.col("c") > 0, F.col("wx") / F.col("c")).otherwise(F.col("wy") / F.col("r"))
    many = (F.col("r") + 1 - F.col("dr")) * (F.col("c") + 1 - F.col("dc")) * F.when((F.col("dr") > 0) & (F.col("dc") > 0), 2).otherwise(1)
    rows = steps.select((size * F.sqrt(F.pow("dr", 2) + F.pow("dc", 2))).alias("d"), many.cast("long").alias("n"))
    return rows.agg(F.percentile("d", F.array(*map(F.lit, shares)), F.col("n")).alias("q")).select(F.posexplode("q").alias("k", "distance")).select(F.element_at(F.array(*map(F.lit, shares)), F.col("k") + 1).alias("share"), "distance")


COLUMNS = ["one", "y_lag", "dist_center", "seasonal"]
#: The products that a local regression needs: of each two columns, and of each with y, and y's square.
PAIRS = [(a, b) for a in range(5) for b in range(a, 5)]
#: Places of a line of cells whose kernel is worked out at once.
LINE = 512


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    whole = np.column_stack([x, y])
    return np.stack([whole[:, a] * whole[:, b] for a, b in PAIRS], axis=1)


def _design(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """y_lag, dist_center, seasonal and y as the columns with a constant, and y."""
    return np.column_stack([np.ones(len(values[0])), *values[:3]]), values[3]


def _steps(rows: DataFrame) -> tuple[int, int, float, float]:
    """Rows and columns of the grid, and the distances between neighbouring ones."""
    r, c, x, y = rows.agg(F.max("row"), F.max("col"), F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).first()
    return (r or 0) + 1, (c or 0) + 1, (y or 0.0) / max(r or 1, 1), (x or 0.0) / max(c or 1, 1)


def gaussian_sums(rows: DataFrame, bandwidths: list[float]) -> DataFrame:
    """bandwidth, row, col and sums: for every cell and bandwidth, the products of all cells under the Gaussian kernel around it.

    The kernel of a distance is that of its rows times that of its columns, so the sums are made along each row of the grid
    first and then along each column: a line of cells is a task's at a time, and no pair of cells becomes a row.
    """
    nrows, ncols, high, wide = _steps(rows)
    m = [F.expr(e) for e in ("CAST(1 AS double)", "y_lag", "dist_center", "seasonal", "y")]
    made = rows.select("row", "col", F.array(*[m[a] * m[b] for a, b in PAIRS]).alias("sums"))

    def line(pdf: pd.DataFrame, axis: str, n: int, step: float, widths: list[float]) -> pd.DataFrame:
        place, sums = pdf[axis].to_numpy(), np.stack(pdf["sums"])
        other = "row" if axis == "col" else "col"
        out = []
        for width in widths:
            for a in range(0, n, LINE):
                to = np.arange(a, min(a + LINE, n))
                weight = np.exp(-0.5 * ((to[:, None] - place[None, :]) * (step / width)) ** 2)
                out.append(pd.DataFrame({"bandwidth": width, other: pdf[other].iloc[0], axis: to.astype("int32"), "sums": list(weight @ sums)}))
        return pd.concat(out)[["bandwidth", "row", "col", "sums"]]

    schema = "bandwidth double, row int, col int, sums array<double>"
    across = made.groupBy("row").applyInPandas(lambda pdf: line(pdf, "col", ncols, wide, bandwidths), schema)
    return across.groupBy("bandwidth", "col").applyInPandas(lambda pdf: line(pdf, "row", nrows, high, [float(pdf["bandwidth"].iloc[0])]), schema)


def compact_sums(rows: DataFrame, bandwidths: list[float]) -> DataFrame:
    """gaussian_sums for the bisquare kernel, which is 0 from the bandwidth on: by pairs of blocks of cells within that distance."""
    out = None
    for width in map(float, bandwidths):

        def sums(_, a: np.ndarray, b: np.ndarray, one: bool, width: float = width) -> list[np.ndarray]:
            u = np.sqrt((a[0][:, None] - b[0]) ** 2 + (a[1][:, None] - b[1]) ** 2) / width
            weight = np.where(u < 1, (1 - u * u) ** 2, 0.0)
            found = [(a, weight @ _moments(*_design(list(b[3:]))))]
            if not one:
                found.append((b, weight.T @ _moments(*_design(list(a[3:])))))
            return [np.concatenate([p[2].view(np.int64) for p, _ in found]), *np.concatenate([s for _, s in found]).T]

        values = ("y_lag", "dist_center", "seasonal", "value")
        points = rows.select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("flat_idx").cast("long").alias("id"), "y_lag", "dist_center", "seasonal", F.col("y").cast("double").alias("value"))
        names = [f"s{k}" for k in range(len(PAIRS))]
        found = block_pairs(points.withColumn("y_lag", F.col("y_lag").cast("double")), width, (), ("id", *values), sums, ", ".join(["id long", *[f"{x} double" for x in names]]))
        whole = found.groupBy("id").agg(*[F.sum(x).alias(x) for x in names])
        placed = rows.select("row", "col", F.col("flat_idx").cast("long").alias("id")).join(whole, "id")
        part = placed.select(F.lit(width).alias("bandwidth"), "row", "col", F.array(*names).alias("sums"))
        out = part if out is None else out.unionByName(part)
    return out


def _local_sums(rows: DataFrame, bandwidths: list[float], kind: str) -> DataFrame:
    sums = (gaussian_sums if kind == "gaussian" else compact_sums)(rows, [float(b) for b in bandwidths])
    return rows.select("flat_idx", "row", "col", "y_lag", "dist_center", "seasonal", "y").join(sums, ["row", "col"])


def _solved(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of sums the matrix of the columns, the coefficients (of least norm where columns are collinear), and all products."""
    m = np.empty((len(sums), 5, 5))
    for k, (a, b) in enumerate(PAIRS):
        m[:, a, b] = m[:, b, a] = sums[:, k]
    beta = (np.linalg.pinv(m[:, :4, :4], rcond=1e-12, hermitian=True) @ m[:, :4, 4:])[:, :, 0]
    return m[:, :4, :4], beta, m


def gwr(rows: DataFrame, bandwidth: float, kind: str = "gaussian") -> DataFrame:
    """flat_idx, row, col, the four local coefficients, yhat, residual, local_r2 for gwr_features' rows, for grids of any size.

    Each cell is a small weighted regression over all cells, from sums of products that are made along the grid's lines
    (Gaussian kernel) or by pairs of blocks (bisquare), and solved where they are. Collinear columns get the least-norm solution.
    """

    def solve(batches):
        for pdf in batches:
            x, y = _design([pdf[c].to_numpy(float) for c in ("y_lag", "dist_center", "seasonal", "y")])
            inner, beta, m = _solved(np.stack(pdf["sums"]) if len(pdf) else np.zeros((0, len(PAIRS))))
            own = (x * beta).sum(axis=1)
            squares = m[:, 4, 4] - 2 * (beta * m[:, :4, 4]).sum(axis=1) + np.einsum("na,nab,nb->n", beta, inner, beta)
            total = m[:, 4, 4] - m[:, 0, 4] ** 2 / np.maximum(m[:, 0, 0], 1e-12)
            r2 = np.where(total > 1e-12, 1 - squares / np.where(total > 1e-12, total, 1.0), 0.0)
            out = pdf[["flat_idx", "row", "col"]].copy()
            out[["intercept", "temporal_lag", "dist_center", "seasonal_sin"]] = beta
            yield out.assign(yhat=own, residual=y - own, local_r2=np.clip(r2, 0.0, 1.0))

    return _local_sums(rows, [bandwidth], kind).mapInPandas(solve, "flat_idx int, row int, col int, intercept double, temporal_lag double, dist_center double, seasonal_sin double, yhat double, residual double, local_r2 double")


def gcv_scores(rows: DataFrame, candidates: int = 12, kind: str = "gaussian") -> DataFrame:
    """bandwidth and gcv of candidates between the 5th and the 50th percentile of distances: all of them in one plan."""
    lo, hi = (r["distance"] for r in cell_distance_quantiles(rows, [0.05, 0.5]).orderBy("share").collect())

    def solve(batches):
        for pdf in batches:
            x, y = _design([pdf[c].to_numpy(float) for c in ("y_lag", "dist_center", "seasonal", "y")])
            inner, beta, _ = _solved(np.stack(pdf["sums"]) if len(pdf) else np.zeros((0, len(PAIRS))))
            hat = np.einsum("na,nab,nb->n", x, np.linalg.pinv(inner + 1e-10 * np.eye(4), hermitian=True), x)
            yield pd.DataFrame({"bandwidth": pdf["bandwidth"], "e2": (y - (x * beta).sum(axis=1)) ** 2, "h": hat})

    each = _local_sums(rows, list(np.linspace(lo, hi, candidates)), kind).mapInPandas(solve, "bandwidth double, e2 double, h double")
    return each.groupBy("bandwidth").agg((F.avg("e2") / F.pow(1 - F.avg("h"), 2)).alias("gcv"))


def gcv_bandwidth(rows: DataFrame, **options) -> DataFrame:
    """The bandwidth with the least score; of equal ones the smallest."""
    return gcv_scores(rows, **options).orderBy("gcv", "bandwidth").limit(1)


def describe(fitted: DataFrame) -> DataFrame:
    """statistic and its value for each local coefficient, yhat and local_r2 of gwr: count, mean, deviation, least, quartiles, greatest."""
    columns = ["intercept", "temporal_lag", "dist_center", "seasonal_sin", "yhat", "local_r2"]
    made = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, **{f"{q}%": lambda c, q=q: F.percentile(c, F.lit(q / 100)) for q in (25, 50, 75)}, "max": F.max}
    one = fitted.agg(*[F.struct(*[f(c).cast("double").alias(c) for c in columns]).alias(name) for name, f in made.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("statistic"), F.col(f"`{name}`").alias("s")) for name in made])
    return one.select(F.explode(rows).alias("r")).select("r.statistic", "r.s.*")
