import math

import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from cellwise.functions import numerics
from cellwise.functions.grid import GridSpec
from cellwise.operators import cluster, explore, spatial_join
from cellwise.operators.lineage import connected_components
from cellwise.operators.spatial_join import band_join, neighbour_counts
from tests.test_cube_and_hotspots import SPEC, dense, grid_cube


def points(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "event_id long, x double, y double")


def test_kde_against_numpy(spark):
    xy = np.random.default_rng(1).uniform(0, 40, (200, 2))
    h = np.concatenate([xy[:, 0], xy[:, 1]]).std() * 200 ** (-1 / 6)
    df = points(spark, xy)
    assert abs(explore.kde_bandwidth(df) - h) < 1e-9
    got = {r["flat_idx"]: r["density"] for r in explore.kde(df.repartition(3), SPEC).collect()}
    for i in range(SPEC.n_cells):
        c = np.array([(i % 5 + 0.5) * 10, (i // 5 + 0.5) * 10])
        d2 = ((xy - c) ** 2).sum(axis=1)
        assert abs(got[i] - np.exp(-d2 / (2 * h * h)).mean() / (2 * math.pi * h * h)) < 1e-12
    assert explore.kde(df.limit(0), SPEC, 5.0).agg(F.sum("density")).first()[0] == 0


def queen(nrows, ncols):
    n = nrows * ncols
    w = np.zeros((n, n))
    for a in range(n):
        for b in range(n):
            w[a, b] = a != b and abs(a // ncols - b // ncols) <= 1 and abs(a % ncols - b % ncols) <= 1
    return w


def test_moran_against_matrices(spark):
    x = np.random.default_rng(2).poisson(3, (1, 4, 5)).astype(float)
    w, z, n = queen(4, 5), x.reshape(-1) - x.mean(), 20.0
    s0 = w.sum()
    i = n / s0 * (z @ w @ z) / (z @ z)
    s1, s2 = 0.5 * ((w + w.T) ** 2).sum(), ((w.sum(0) + w.sum(1)) ** 2).sum()
    for flag in (False, True):
        k = (z**4).sum() / (z**2).sum() ** 2 * (1 if flag else n)
        var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - 1 / (n - 1) ** 2
        r = explore.moran_global(grid_cube(spark, x, SPEC), SPEC, reference_variance=flag).first()
        assert abs(r["I"] - i) < 1e-12 and abs(r["E_I"] + 1 / 19) < 1e-12
        assert abs(r["z"] - (i + 1 / 19) / math.sqrt(max(var, 1e-12))) < 1e-9 and abs(r["p_value"] - math.erfc(abs(r["z"]) / math.sqrt(2))) < 1e-12


def test_lisa(spark):
    x = np.random.default_rng(3).poisson(3, (2, 4, 5)).astype(float)
    x[1] = 2.0
    rows = explore.lisa(grid_cube(spark, x, SPEC), SPEC).collect()
    got = dense(rows, SPEC, 2, "local_i")
    w = queen(4, 5)
    z = x[0].reshape(-1) - x[0].mean()
    lag = (w / w.sum(1, keepdims=True)) @ z
    assert np.allclose(got[0].reshape(-1), z * lag / (z**2).mean()) and (got[1] == 0).all()
    every = dense(rows, SPEC, 2, "quadrant_all")[0].reshape(-1)
    plain = [1 if a > 0 < b else 2 if a < 0 < b else 3 if a < 0 > b else 4 if a > 0 > b else 0 for a, b in zip(np.round(z, 9), np.round(lag, 9), strict=True)]
    assert every.tolist() == plain
    p = explore.lisa_p_values(grid_cube(spark, x, SPEC), SPEC, permutations=49)
    again = explore.lisa_p_values(grid_cube(spark, x, SPEC), SPEC, permutations=49)
    assert np.allclose(dense(p.withColumn("row", F.expr("flat_idx DIV 5")).withColumn("col", F.expr("flat_idx % 5")).collect(), SPEC, 2, "local_i"), got)
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, again.collect())) and all(1 / 50 <= r.p_sim <= 1 for r in p.collect())


def test_permutations_are_the_same_for_any_dealing(spark):
    x = np.random.default_rng(8).poisson(3, (2, 4, 5)).astype(float)
    cube = grid_cube(spark, x, SPEC)
    rows = [sorted(map(tuple, explore.lisa_p_values(c, SPEC, permutations=99, block=b).collect())) for c, b in ((cube, 1024), (cube.repartition(7), 3))]
    assert rows[0] == rows[1] and len(rows[0]) == 40
    plan = explore.lisa_p_values(cube, SPEC, block=3)
    assert plan.rdd.getNumPartitions() > 1
    picks = explore.drawn(42, np.arange(400), 199, 8, 39)
    assert picks.min() == 0 and picks.max() == 38 and all(len(set(p)) == 8 for p in picks[:50].reshape(-1, 8).tolist())
    share = np.bincount(picks.reshape(-1), minlength=39) / picks.size
    assert np.abs(share - 1 / 39).max() < 0.001
    assert not (explore.drawn(43, np.arange(400), 199, 8, 39) == picks).all()
    # Against permutations drawn by numpy: the same shares of simulated values at or over the observed one.
    z = x[0].reshape(-1) - x[0].mean()
    rng, m2 = np.random.default_rng(1), (z**2).mean()
    many = {r[1]: r for r in map(tuple, explore.lisa_p_values(cube.where("t = 0"), SPEC, permutations=1999).collect())}
    w = queen(4, 5)
    for i in (0, 7, 12, 19):
        other, deg = np.delete(z, i), int(w[i].sum())
        sim = np.array([z[i] * rng.choice(other, deg, replace=False).mean() / m2 for _ in range(4000)])
        share = (sim >= many[i][2]).mean()
        assert abs(many[i][3] - min(share, 1 - share)) < 0.05


def test_ripley_against_brute_force(spark):
    xy = np.round(np.random.default_rng(4).uniform(0, 40, (150, 2)))
    df = points(spark, xy)
    d = np.hypot(*(xy[:, None] - xy[None, :]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    steps = [1.0, 3.0, 7.5, 10.0]
    got = {r["distance"]: r for r in explore.ripley(df, steps, 1600.0).collect()}
    for s in steps:
        k = 1600.0 * (d <= s).sum() / (150 * 149)
        assert abs(got[s]["K"] - k) < 1e-9 and abs(got[s]["L"] - (math.sqrt(k / math.pi) - s)) < 1e-9
    env = explore.ripley_envelope(df, steps, (0.0, 0.0, 40.0, 40.0), 5).collect()
    assert all(r.K_lower <= r.K_upper and r.K_upper > 0 for r in env) and len(env) == 4
    assert all(r.K_lower is None for r in explore.ripley_envelope(df, steps, (0.0, 0.0, 40.0, 40.0), 0).collect())
    # A random pattern's K is near pi d^2.
    assert all(abs((r.K_lower + r.K_upper) / 2 / (math.pi * r.distance**2) - 1) < 0.6 for r in env if r.distance > 3)


def test_stationarity(spark):
    rng = np.random.default_rng(5)
    noise, walk = rng.normal(0, 1, 300), rng.normal(0, 1, 300).cumsum()
    assert numerics.stationarity(noise)["verdict"] == "Stationary"
    assert numerics.stationarity(walk)["verdict"] == "Non-stationary (unit root)"
    assert numerics.stationarity(noise[:5])["verdict"] == "Insufficient data"
    assert numerics.stationarity(np.ones(50))["adf_stationary"]
    x = rng.poisson(3, (30, 4, 5)).astype(float)
    x[:, 0, 0] = 0
    report = explore.stationarity(grid_cube(spark, x, SPEC)).toPandas()
    assert len(report) == 19 and report["verdict"].is_monotonic_increasing


def test_band_join_against_brute_force(spark):
    rng = np.random.default_rng(6)
    a = np.column_stack([rng.uniform(-30, 30, (80, 2)), rng.uniform(0, 100, 80)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "id long, x double, y double, ts double")
    got = {(r.a, r.b) for r in band_join(df, df, 7.0, 20.0).collect()}
    assert got == {(i, j) for i in range(80) for j in range(80) if math.hypot(*(a[i, :2] - a[j, :2])) <= 7 and abs(a[i, 2] - a[j, 2]) <= 20}


def test_band_join_of_two_sides_in_one_bucket(spark, monkeypatch):
    """Different sides that share ids, nulls, repeated rows, points at one place; small blocks, and a table cut while it is sent."""
    for name, value in (("BLOCK", 32), ("SPLIT", 2), ("SENT", 100)):
        monkeypatch.setattr(spatial_join, name, value)
    rng = np.random.default_rng(8)
    sides = [[(int(i), *map(float, rng.uniform(0, 3, 2))) for i in range(n)] + [(5, 1.0, 1.0)] * 2 for n in (200, 150)]
    a, b = (spark.createDataFrame([*rows, (1000, None, 1.0)], "id long, x double, y double") for rows in sides)
    got = sorted((r.a, r.b) for r in band_join(a, b, 1.0).collect())
    assert got == sorted((p[0], q[0]) for p in sides[0] for q in sides[1] if math.hypot(p[1] - q[1], p[2] - q[2]) <= 1.0)
    own = sides[0][:200]
    near = {p[0]: sum(q[0] != p[0] and math.hypot(p[1] - q[1], p[2] - q[2]) <= 0.2 for q in own) for p in own}
    alone = spark.createDataFrame(own, "id long, x double, y double")
    assert {r.id: r.n for r in neighbour_counts(alone, 0.2).collect()} == {k: n for k, n in near.items() if n}
    assert band_join(a.limit(0), b, 1.0).count() == 0


def plain_stdbscan(a, eps, eps_t, least):
    """In row order: a core event without a cluster opens the next and takes what it reaches."""
    n = len(a)
    near = [[j for j in range(n) if j != i and math.hypot(*(a[i, :2] - a[j, :2])) <= eps and abs(a[i, 2] - a[j, 2]) <= eps_t] for i in range(n)]
    label, k = [-1] * n, -1
    for i in range(n):
        if label[i] != -1 or len(near[i]) < least:
            continue
        k += 1
        label[i], stack = k, list(near[i])
        while stack:
            j = stack.pop()
            if label[j] == -1:
                label[j] = k
                if len(near[j]) >= least:
                    stack += near[j]
    return label


def test_stdbscan_against_the_sequential_procedure(spark):
    rng = np.random.default_rng(7)
    a = np.column_stack([rng.uniform(0, 40, (150, 2)), rng.uniform(0, 100, 150)])
    base = pd.Timestamp("2024-01-01")
    rows = [(i, *map(float, r[:2]), (base + pd.Timedelta(seconds=float(r[2]))).floor("us").to_pydatetime()) for i, r in enumerate(a)]
    events = spark.createDataFrame([*rows, (900, None, 1.0, base.to_pydatetime())], "event_id long, x double, y double, datetime timestamp_ntz")
    for least in (3, 5):
        got = {r.event_id: r.cluster for r in cluster.stdbscan(events, 6.0, 30.0, least).collect()}
        assert [got[i] for i in range(150)] == plain_stdbscan(a, 6.0, 30.0, least) and got[900] == -1
    whole = cluster.fit_transform(events, eps_spatial=6.0, eps_seconds=30.0, min_samples=3)
    counts = whole.where("cluster >= 0").groupBy("cluster").count().collect()
    assert {r.cluster: r.n_events for r in cluster.cluster_summary(whole).collect()} == {r.cluster: r["count"] for r in counts}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (7, 7)], "a long, b long").unionByName(spark.range(100, 180).selectExpr("id AS a", "id + 1 AS b"))
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {2: 1, 3: 1, 6: 5} | {k: 100 for k in range(101, 181)}  # roots have no row


def test_grid_fit_bounds(spark):
    spec = GridSpec.fit(points(spark, [(1, 2), (11, 32)]), 10.0)
    assert (spec.ncols, spec.nrows, spec.minx, spec.miny) == (1, 3, 1.0, 2.0)


def test_block_pairs_of_hot_buckets(spark, monkeypatch):
    """Many points at a few places: buckets of many blocks, dealt over parts, count the pairs as single blocks do."""
    from cellwise.operators import spatial_join

    rng = np.random.default_rng(8)
    xy = np.round(np.concatenate([rng.uniform(0, 40, (60, 2)), rng.normal(20, 0.5, (140, 2))]), 1)
    d = np.hypot(*(xy[:, None] - xy[None, :]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    for block, split, fill in ((1024, 8, 64), (8, 2, 1)):
        monkeypatch.setattr(spatial_join, "BLOCK", block)
        monkeypatch.setattr(spatial_join, "SPLIT", split)
        monkeypatch.setattr(spatial_join, "FILL", fill)
        got = {r["distance"]: r["pairs"] for r in explore.pair_counts(points(spark, xy), [1.0, 5.0]).collect()}
        assert got == {s: int((d <= s).sum()) for s in (1.0, 5.0)}
    assert explore.pair_counts(points(spark, xy).limit(0), [1.0]).first()["pairs"] == 0


def test_largest_and_described(spark):
    from cellwise.operators import cube, regress

    summary = spark.createDataFrame([(k, n) for k, n in enumerate((5, 9, 9, 1))], "cluster int, n_events long")
    assert [r.cluster for r in cluster.largest(summary, 3).collect()] == [1, 2, 0]
    rows = spark.createDataFrame([tuple(float(k + j) for j in range(6)) for k in range(5)], "intercept double, temporal_lag double, dist_center double, seasonal_sin double, yhat double, local_r2 double")
    expected = rows.toPandas().describe()
    got = regress.describe(rows).toPandas().set_index("statistic")
    assert np.allclose(got.loc[expected.index, expected.columns], expected)
    counts = grid_cube(spark, np.arange(20.0).reshape(1, 4, 5), SPEC)
    assert [r.flat_idx for r in cube.most_active(counts).collect()] == [19, 18, 17]


def test_rows_of_one_event_id_stay_apart(spark):
    from datetime import datetime

    rows = [(7, 10.0, 10.0, datetime(2024, 1, 1))] * 12 + [(8, 5000.0, 5000.0, datetime(2024, 1, 1))] * 3
    df = spark.createDataFrame(rows, "event_id long, x double, y double, datetime timestamp_ntz")
    found = cluster.fit_transform(df, min_samples=5).collect()
    assert len(found) == 15 and sorted((r.event_id, r.cluster) for r in found) == [(7, 0)] * 12 + [(8, -1)] * 3
    assert sorted(map(tuple, cluster.stdbscan(df, min_samples=5).collect())) == [(7, 0)] * 12 + [(8, -1)] * 3


def test_pairs_by_groups_of_points_against_brute_force():
    """Weights, points at one place, and distances and times that lie on a limit; few points and many."""
    rng = np.random.default_rng(11)
    limits = np.array([spatial_join.squared(d) for d in (5.0, 10.0, 10.5, 25.0)])
    for n, m in ((1, 1), (5, 300), (700, 1030)):
        a, b = (np.stack([*np.round(rng.uniform(0, 40, (2, k))), rng.integers(1, 4, k).view(np.float64), np.round(rng.uniform(0, 60, k))]) for k in (n, m))
        a, b = (x[:, spatial_join.halved([x[0], x[1]])] for x in (a, b))
        dist = np.sqrt((a[0][:, None] - b[0]) ** 2 + (a[1][:, None] - b[1]) ** 2)
        w = a[2].view(np.int64)[:, None] * b[2].view(np.int64)
        assert np.cumsum(spatial_join.pairs_upto(a, b, limits)).tolist() == [int(w[dist <= d].sum()) for d in (5.0, 10.0, 10.5, 25.0, 1e9)]
        for seconds in (None, 7.0):
            near = dist <= 10.0
            if seconds:
                near &= np.abs(a[3][:, None] - b[3]) <= seconds
            own, other = spatial_join.near_counts(a, b, spatial_join.squared(10.0), seconds)
            assert own.tolist() == near.sum(axis=1).tolist() and other.tolist() == near.sum(axis=0).tolist()
    assert math.sqrt(spatial_join.squared(0.1)) <= 0.1 < math.sqrt(np.nextafter(spatial_join.squared(0.1), 1))


def test_band_counts_of_two_sides(spark, monkeypatch):
    rng = np.random.default_rng(12)
    for name, value in (("BLOCK", 16), ("SPLIT", 2)):
        monkeypatch.setattr(spatial_join, name, value)
    sides = [[(int(i), *map(float, rng.uniform(0, 3, 2))) for i in range(n)] for n in (90, 130)]
    a, b = (spark.createDataFrame([*rows, (1000, None, 1.0)], "id long, x double, y double") for rows in sides)
    near = {p[0]: sum(math.hypot(p[1] - q[1], p[2] - q[2]) <= 0.3 for q in sides[1]) for p in sides[0]}
    assert {r.id: r.n for r in spatial_join.band_counts(a, b, 0.3).collect()} == {k: n for k, n in near.items() if n}


def test_a_row_of_paired_blocks_carries_one_block(spark):
    """Rows that carry two blocks filled an executor's Python with whole batches of them."""
    made = neighbour_counts(spark.createDataFrame([(i, i % 7 + 0.0, i % 5 + 0.0) for i in range(50)], "id long, x double, y double"), 2.0)
    assert "data2" not in made._jdf.queryExecution().toString() and "data" in made._jdf.queryExecution().toString()
    assert spatial_join.BLOCK <= 256


def test_stdbscan_of_dense_cells(spark, monkeypatch):
    """Dense places at, just under and just over the reach of each other, lone events between: labels of the plain procedure, and few events meet in blocks."""
    seen = []
    monkeypatch.setattr(cluster, "block_pairs", lambda points, *rest: seen.append(points.count()) or spatial_join.block_pairs(points, *rest))
    rng = np.random.default_rng(13)
    blobs = [np.column_stack([x + rng.uniform(-w, w, n), y + rng.uniform(-w, w, n), rng.uniform(0, 25, n)]) for x, y, w, n in ((0, 0, 2, 120), (10, 0, 2, 120), (30, 0, 1, 60), (38, 0, 1, 60), (-25, 0, 0, 15), (-19, 0, 0, 15), (-12.999, 0, 0, 4))]
    a = np.concatenate([*blobs, np.column_stack([rng.uniform(-40, 50, (40, 2)), rng.uniform(0, 90, 40)])])
    a = np.round(a[rng.permutation(len(a))], 3)
    base = pd.Timestamp("2024-01-01")
    rows = [(i, float(x), float(y), (base + pd.Timedelta(milliseconds=round(t * 1000))).to_pydatetime()) for i, (x, y, t) in enumerate(a)]
    events = spark.createDataFrame([*rows, (900, float("nan"), 1.0, base.to_pydatetime())], "event_id long, x double, y double, datetime timestamp_ntz")
    got = {r.event_id: r.cluster for r in cluster.stdbscan(events, 6.0, 30.0, 5).collect()}
    assert [got[i] for i in range(len(a))] == plain_stdbscan(a, 6.0, 30.0, 5) and got[900] == -1
    assert seen and max(seen) < len(a) / 2


@pytest.mark.parametrize(("n", "bbox", "steps", "size"), [(2000, (0.0, 0.0, 40.0, 40.0), [1.0, 3.0, 10.0], 150), (600, (-5.0, 3.0, 1000.0, 300.0), [50.0, 100.0], 64), (3, (0.0, 0.0, 9.0, 9.0), [50.0], 64)])
def test_pairs_of_random_patterns_by_tiles_against_brute_force(spark, monkeypatch, n, bbox, steps, size):
    # Patterns are drawn tile by tile and their pairs counted there: no drawn point is a row.
    monkeypatch.setattr(explore, "TILE", size)
    nx, ny = explore.tile_sides(n, steps[-1], bbox[2] - bbox[0], bbox[3] - bbox[1])
    assert nx * ny > 1 or n < 10
    got = {(r.sim, r.distance): r.pairs for r in explore.random_pair_counts(spark, n, steps, bbox, 3, 7).collect()}
    for sim in range(3):
        m = np.concatenate(explore.tile_points(n, (nx, ny), bbox, 7, sim, [(i, j) for j in range(ny) for i in range(nx)]), axis=1)
        assert m.shape[1] == n and (m[0] >= bbox[0]).all() and (m[0] <= bbox[2]).all() and (m[1] >= bbox[1]).all() and (m[1] <= bbox[3]).all()
        d = np.hypot(m[0][:, None] - m[0], m[1][:, None] - m[1])
        np.fill_diagonal(d, np.inf)
        assert [got[sim, s] for s in steps] == [(d <= s).sum() for s in steps]


def test_random_patterns_are_uniform_and_differ():
    tiles, bbox = (4, 3), (0.0, 0.0, 40.0, 30.0)
    one, two = (np.concatenate(explore.tile_points(24_000, tiles, bbox, 7, sim, [(i, j) for j in range(3) for i in range(4)]), axis=1) for sim in (0, 1))
    assert not np.isin(one[0], two[0]).any() and len(np.unique(one[0])) == 24_000
    counts = np.histogram2d(one[0], one[1], bins=(16, 12), range=((0, 40), (0, 30)))[0]
    # 192 cells of 125 points: chi-square of 191 degrees of freedom.
    assert 120 < ((counts - 125) ** 2 / 125).sum() < 280 and counts.reshape(4, 4, 3, 4).sum(axis=(1, 3)).std() > 5


def test_pairs_by_strips_against_brute_force():
    rng = np.random.default_rng(9)
    limits = np.array([spatial_join.squared(d) for d in (1.0, 2.0, 5.0)])
    for place in (rng.uniform(0, 30, (2, 700)), np.round(rng.uniform(0, 30, (2, 700))), np.zeros((2, 50)), np.stack([np.arange(60.0), np.zeros(60)]), np.stack([np.full(60, 1e6), np.arange(60.0)]), rng.uniform(0, 1e-7, (2, 40)) + 20_000):
        w = rng.integers(1, 4, place.shape[1])
        a = np.stack([*place, w.view(np.float64)])
        for x, y in ((a, a), (a[:, ::2], a[:, 1::2]), (a[:, :5], a)):
            d2 = (x[0][:, None] - y[0]) ** 2 + (x[1][:, None] - y[1]) ** 2
            both = x[2].view(np.int64)[:, None] * y[2].view(np.int64)
            want = [both[d2 <= k].sum() for k in limits]
            assert np.cumsum(spatial_join.pairs_upto(x, y, limits)).tolist() == [*want, both.sum()]
