"""The batch analysis from an event table to scores, as one composition of lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.functions.grid import GridSpec
from cellwise.functions.period import Periods
from cellwise.operators import cluster, cube, evaluate, forecast, hotspot, regress
from cellwise.operators.explore import moran_global
from cellwise.sources import sinks


@dataclass(frozen=True)
class BatchConfig:
    cell_size: float = 500.0
    freq: str = "M"
    alpha: float = 0.05
    persistent: float = 0.9
    eps_spatial: float = 1500.0
    eps_days: float = 45.0
    min_samples: int = 8
    #: Clusters come from all events; from a sample of so many only on request.
    cluster_sample: int | None = None
    train_periods: int = 20
    steps: int = 4
    sigma: float = 0.8
    percentile: float = 80.0


@dataclass
class BatchResult:
    """Lazy tables; the cube is persisted until close()."""

    spec: GridSpec
    periods: Periods
    cube: DataFrame
    categories: DataFrame
    moran: DataFrame
    clusters: DataFrame
    forecast: DataFrame
    scores: DataFrame
    pai_curve: DataFrame

    def write(self, path: str) -> None:
        """The CSV tables of a run."""
        sinks.write_csv(self.categories, f"{path}/emerging_hotspots")
        sinks.write_csv(self.clusters, f"{path}/clusters")
        sinks.write_parquet(self.forecast, f"{path}/forecast")
        sinks.write_csv(self.pai_curve, f"{path}/pai_curve")
        sinks.write_csv(self.scores, f"{path}/model_comparison")

    def close(self) -> None:
        self.cube.unpersist()


def run(events: DataFrame, config: BatchConfig | None = None, bbox: tuple[float, float, float, float] | None = None) -> BatchResult:
    c = config or BatchConfig()
    spec = GridSpec.of_bbox(bbox, c.cell_size) if bbox else GridSpec.fit(events, c.cell_size)
    periods = Periods.fit(events, c.freq)
    counts = cube.count_cube(events, spec, periods).persist()
    train = min(c.train_periods, periods.n)
    gi = hotspot.gi_star(counts, spec)
    categories = hotspot.classify(gi, spec, periods.n, c.alpha, c.persistent)
    moran = moran_global(cube.time_slice(counts, -1, periods.n), spec)
    sample = cube.exact_sample(events, c.cluster_sample) if c.cluster_sample else events
    clustered = cluster.fit_transform(sample, eps_spatial=c.eps_spatial, eps_seconds=c.eps_days * 86400, min_samples=c.min_samples)
    point = forecast.fit_predict(counts, spec, train, c.steps, c.sigma)
    rows = regress.features(counts, spec)
    ahead = rows.where((F.col("t") >= train) & (F.col("t") < train + c.steps))
    sar = regress.fit_sar(rows, spec, train)
    summed = {
        "ARIMA": forecast.summed(point),
        "OLS": forecast.summed(regress.predict(regress.fit_ols(rows, train), ahead)),
        "Spatial Lag": forecast.summed(regress.predict_sar(sar, ahead)),
    }
    later = test_events(events, periods, train)
    pairs = {name: evaluate.scored(grid, later, spec) for name, grid in summed.items()}
    scored = {**pairs, "Naive": evaluate.uniform_baseline(pairs["ARIMA"])}
    return BatchResult(spec, periods, counts, categories, moran, cluster.cluster_summary(clustered), point, evaluate.compare_models(scored, c.percentile), evaluate.pai_curve(pairs["ARIMA"]))


def test_events(events: DataFrame, periods: Periods, train: int) -> DataFrame:
    """Events from the period after the training on; all if there is none."""
    return events if train >= periods.n else events.where(F.col("datetime") >= periods.begins(F.lit(train)))


test_events.__test__ = False
