import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise.functions import numerics
from cellwise.functions.grid import GridSpec
from cellwise.functions.period import Periods
from cellwise.operators import cube, hotspot, neighbors

SPEC = GridSpec.of_bbox((0.0, 0.0, 50.0, 40.0), 10.0)
EVENTS = "event_id long, x double, y double, datetime timestamp_ntz"


def grid_cube(spark, array, spec):
    """A dense (t, row, col) array as a cube."""
    rows = [(t, r, c, r * spec.ncols + c, float(array[t, r, c])) for t in range(array.shape[0]) for r in range(spec.nrows) for c in range(spec.ncols)]
    return spark.createDataFrame(rows, "t int, row int, col int, flat_idx int, count double")


def dense(rows, spec, n, value):
    out = np.zeros((n, spec.nrows, spec.ncols))
    for r in rows:
        out[r["t"], r["row"], r["col"]] = r[value]
    return out


def test_cube_keeps_edges_gaps_and_drops_nulls(spark):
    at = lambda m, d=1: dt.datetime(2024, m, d, 12)
    rows = [(1, 50.0, 40.0, at(1)), (2, -5.0, 99.0, at(3)), (3, 0.0, 0.0, at(3, 31)), (4, 1.0, 1.0, None), (5, None, 1.0, at(2))]
    events = spark.createDataFrame(rows, EVENTS)
    periods = Periods.fit(events, "ME")
    assert (SPEC.nrows, SPEC.ncols, periods.n) == (4, 5, 3)
    got = dense(cube.count_cube(events, SPEC, periods).collect(), SPEC, 3, "count")
    assert got[0, 3, 4] == 1 and got[2, 3, 0] == 1 and got[2, 0, 0] == 1 and got.sum() == 3 and got[1].sum() == 0
    assert cube.count_cube(events, SPEC, periods, drop_outside=True).agg(F.sum("count")).first()[0] == 2
    assert cube.count_cube(events, SPEC, periods).count() == 60
    labels = [r.label for r in periods.table(spark, 0, 4).orderBy("t").collect()]
    assert labels == ["2024-01", "2024-02", "2024-03", "2024-04"]
    assert cube.event_counts(events, SPEC).agg(F.sum("actual")).first()[0] == 4


@pytest.mark.parametrize(("freq", "n"), [("D", 60), ("W", 10), ("H", 1441), ("Q", 1), ("Y", 1), ("M", 3)])
def test_periods(spark, freq, n):
    rows = [(1, 0.0, 0.0, dt.datetime(2024, 1, 1)), (2, 0.0, 0.0, dt.datetime(2024, 3, 1, 0, 30))]
    events = spark.createDataFrame(rows, EVENTS)
    periods = Periods.fit(events, freq)
    expected = {"D": 61, "W": 9, "H": 1441, "Q": 1, "Y": 1, "M": 3}[freq]
    assert periods.n == expected
    got = events.select(periods.index(F.col("datetime")).alias("t"), periods.begins(periods.index(F.col("datetime"))).alias("b"), "datetime").collect()
    assert [r.t for r in got] == [0, expected - 1]
    assert all(r.b <= r.datetime for r in got)


def test_empty_events(spark):
    events = spark.createDataFrame([], EVENTS)
    periods = Periods.fit(events, "M")
    assert periods.n == 0 and cube.count_cube(events, SPEC, periods).count() == 0


def plain_gi(x):
    out = np.zeros_like(x)
    n = x.size
    if x.std() == 0:
        return out
    for r in range(x.shape[0]):
        for c in range(x.shape[1]):
            own = x[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2]
            w = own.size
            out[r, c] = (own.sum() - x.mean() * w) / (x.std() * math.sqrt((n * w - w * w) / (n - 1)))
    return out


def test_gi_star_against_numpy(spark):
    rng = np.random.default_rng(0)
    array = rng.poisson(2, (3, SPEC.nrows, SPEC.ncols)).astype(float)
    array[1] = 4.0
    got = dense(hotspot.gi_star(grid_cube(spark, array, SPEC), SPEC).collect(), SPEC, 3, "gi_z")
    assert np.allclose(got, np.stack([plain_gi(a) for a in array])) and (got[1] == 0).all()


def test_degree_and_edges(spark):
    edges = neighbors.edges(SPEC.cells(spark), SPEC).groupBy("src").agg(F.count("*").alias("n"), F.sum("w_std").alias("s")).collect()
    assert sorted(r.n for r in edges) == [3] * 4 + [5] * 10 + [8] * 6 and all(abs(r.s - 1) < 1e-12 for r in edges)


def test_mann_kendall_goldens(spark):
    series = {(0, 0): [1, 2, 3, 4, 5], (0, 1): [5, 4, 3, 2, 1], (0, 2): [2, 2, 2, 2, 2], (0, 3): [1, 2, 3]}
    rows = [(r, c, t, float(v)) for (r, c), xs in series.items() for t, v in enumerate(xs)]
    got = {(r["row"], r["col"]): r for r in hotspot.with_p(hotspot.mann_kendall(spark.createDataFrame(rows, "row int, col int, t int, count double"))).collect()}
    up = got[0, 0]
    assert up["s"] == 10 and abs(up["z"] - 2.2045) < 1e-4 and up["trend"] == "increasing" and up["significant"] and abs(up["p"] - 0.0275) < 1e-4
    assert got[0, 1]["trend"] == "decreasing" and got[0, 1]["s"] == -10
    assert got[0, 2]["trend"] == "no trend" and got[0, 2]["p"] == 1
    assert got[0, 3]["trend"] == "no trend" and got[0, 3]["p"] == 1


H, C, N = 3.0, -3.0, 0.0
LABELS = {
    "OSCILLATING_HOTSPOT": [H, C, N, N, H],
    "INTENSIFYING_HOTSPOT": [3, 3.1, 3.2, 3.3, 3.4],
    "DIMINISHING_HOTSPOT": [3.4, 3.3, 3.2, 3.1, 3],
    "PERSISTENT_HOTSPOT": [3, 3.2, 3.1, 3.2, 3],
    "HISTORICAL_HOTSPOT": [N, H, N, H, N],
    "NEW_HOTSPOT": [N, N, N, N, H],
    "CONSECUTIVE_HOTSPOT": [N, N, N, H, H],
    "SPORADIC_HOTSPOT": [N, H, N, N, H],
    "INTENSIFYING_COLDSPOT": [-3, -3.1, -3.2, -3.3, -3.4],
    "DIMINISHING_COLDSPOT": [-3.4, -3.3, -3.2, -3.1, -3],
    "PERSISTENT_COLDSPOT": [-3, -3.2, -3.1, -3.2, -3],
    "HISTORICAL_COLDSPOT": [N, C, N, C, N],
    "NEW_COLDSPOT": [N, N, N, N, C],
    "CONSECUTIVE_COLDSPOT": [N, N, N, C, C],
    "SPORADIC_COLDSPOT": [N, C, N, N, C],
    "NO_PATTERN": [N, 1, N, -1, N],
}


def test_every_label(spark):
    spec = GridSpec(1.0, 0.0, 0.0, 1, len(LABELS))
    rows = [(t, 0, c, c, 1.0, float(z)) for c, zs in enumerate(LABELS.values()) for t, z in enumerate(zs)]
    gi = spark.createDataFrame(rows, "t int, row int, col int, flat_idx int, count double, gi_z double")
    found = hotspot.classify(gi, spec, 5)
    got = {r["col"]: r["category"] for r in found.collect()}
    assert [got[c] for c in range(len(LABELS))] == list(LABELS)
    assert sum(r.n for r in hotspot.summary(found).collect()) == len(LABELS)
    recent = {r["col"]: r["category"] for r in hotspot.classify(gi, spec, 5, recent_two_steps=True).collect()}
    assert recent[list(LABELS).index("HISTORICAL_HOTSPOT")] == "SPORADIC_HOTSPOT"


def test_sample_is_exact_and_repeatable(spark):
    events = spark.range(1000).withColumnRenamed("id", "event_id")
    one, two = ([r.event_id for r in cube.exact_sample(events.repartition(k), 100).collect()] for k in (2, 7))
    assert sorted(one) == sorted(two) and len(set(one)) == 100


def test_kendall_counts_of_long_and_short_series():
    rng = np.random.default_rng(12)
    for n in (1, 2, 3, 7, 32, 61):
        x = rng.integers(0, 6, (9, n)).astype(float)
        plain = [sum(np.sign(v[j] - v[i]) for i in range(n) for j in range(i + 1, n)) for v in x]
        assert numerics.kendall_s(x).tolist() == plain
    long = np.arange(100_000.0)[None]
    assert numerics.kendall_s(np.concatenate([long, -long, long * 0])).tolist() == [99_999 * 50_000, -99_999 * 50_000, 0]
