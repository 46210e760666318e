import math

import numpy as np
from pyspark.sql import functions as F

from cellwise.functions import numerics
from cellwise.functions.grid import GridSpec
from cellwise.operators import evaluate, forecast, regress
from tests.test_cube_and_hotspots import SPEC, dense, grid_cube
from tests.test_explore_and_cluster import queen


def test_smoothing_against_numpy(spark):
    x = np.random.default_rng(0).uniform(0, 9, (2, 4, 5))
    weights = dict(forecast.taps(0.8))
    assert len(weights) == 7 and abs(weights[0] - 0.498676) < 1e-6 and abs(weights[3] - 0.000441) < 1e-6
    fold = lambda k, n: (k % (2 * n)) if k % (2 * n) < n else 2 * n - 1 - k % (2 * n)
    expected = x.copy()
    for axis, n in ((1, 4), (2, 5)):
        expected = np.stack([sum(w * np.take(expected, fold(i + k, n), axis=axis) for k, w in weights.items()) for i in range(n)], axis=axis)
    got = dense(forecast.gaussian_smooth(grid_cube(spark, x, SPEC), SPEC, "count", 0.8, ("t",)).collect(), SPEC, 2, "count")
    assert np.allclose(got, expected) and np.allclose(got.sum(), x.sum())
    tiny = GridSpec(1.0, 0.0, 0.0, 1, 1)
    assert abs(forecast.gaussian_smooth(grid_cube(spark, np.full((1, 1, 1), 7.0), tiny), tiny, "count").first()["count"] - 7) < 1e-12


def test_routing_and_models(spark):
    rng = np.random.default_rng(1)
    x = np.zeros((24, 4, 5))
    x[:, 0, 0] = rng.poisson(5, 24)
    x[:4, 0, 1] = 2
    x[0, 0, 2] = 1
    counts = grid_cube(spark, x, SPEC)
    models = {(r["row"], r["col"]): r["model"] for r in forecast.route(counts, 20).collect()}
    assert [models[0, c] for c in range(4)] == ["arima", "ses", "mean", "zero"]
    assert {(r["row"], r["col"]): r["model"] for r in forecast.route(counts, 20, use_seasonal=True).collect()}[0, 0] == "seasonal"
    rows = forecast.forecast_cells(counts, 20, 3).collect()
    assert len(rows) == 60 and all(0 <= r.lower <= r.yhat <= r.upper for r in rows)
    assert all(r.yhat == 0 for r in rows if (r["row"], r["col"]) == (1, 1))
    mean = {(r["row"], r["col"]): r for r in forecast.mean_forecast(counts, 20).collect()}[0, 0]
    own = x[:20, 0, 0]
    assert abs(mean["yhat"] - own.mean()) < 1e-12 and abs(mean["upper"] - own.mean() - 1.96 * own.std()) < 1e-12
    smooth = forecast.fit_predict(counts, SPEC, 20, 3)
    assert smooth.count() == 60 and abs(forecast.summed(smooth).agg(F.sum("yhat")).first()[0] - sum(r.yhat for r in rows)) < 1e-9


def test_arima_finds_the_process():
    rng = np.random.default_rng(2)
    e = rng.normal(0, 1, 3000)
    y = np.zeros(3000)
    for t in range(1, 3000):
        y[t] = 0.7 * y[t - 1] + e[t] + 0.3 * e[t - 1]
    point, se = numerics.arima_11(y + 10, 0, 40)
    assert abs(point[-1] - (y.mean() + 10)) < 0.2 and abs(se[0] - 1) < 0.05
    assert abs(se[-1] - math.sqrt((1 + 2 * 0.7 * 0.3 + 0.09) / (1 - 0.49))) < 0.15
    walk = e.cumsum()
    point, se = numerics.arima_11(walk, 1, 4)
    assert abs(point[0] - walk[-1]) < 1 and np.allclose(se / se[0], np.sqrt(np.arange(1, 5)), atol=0.15)
    assert numerics.arima_11(np.full(20, 3.0), 1, 2)[0].tolist() == [3, 3]


def test_arma_likelihood_against_the_covariance_matrix():
    y = np.random.default_rng(3).normal(0, 1, 12)
    phi, theta = 0.5, -0.2
    g0 = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    g1 = (1 + phi * theta) * (phi + theta) / (1 - phi**2)
    cov = np.array([[g0 if i == j else g1 * phi ** (abs(i - j) - 1) for j in range(12)] for i in range(12)])
    e, f, _ = (v[0] for v in numerics.arma_filter(y[None], np.array([phi]), np.array([theta])))
    assert abs((e * e / f).sum() - y @ np.linalg.solve(cov, y)) < 1e-9
    assert abs(np.log(f).sum() - np.linalg.slogdet(cov)[1]) < 1e-9


def test_lanes_give_what_each_series_gives_alone():
    rng = np.random.default_rng(6)
    x = rng.poisson(4, (40, 30)).astype(float)
    x[:10] = x[:10].cumsum(axis=1)
    x[10], x[11], x[12] = 0, 5, np.arange(30)
    for many, one in ((numerics.ses_many, numerics.ses), (numerics.adf_many, numerics.adf)):
        assert np.allclose(np.stack(many(x), axis=1), [one(v) for v in x], rtol=1e-7, atol=1e-9)
    for d in (0, 1):
        point, spread = numerics.arima_many(x, d, 5)
        for k, v in enumerate(x):
            a, b = numerics.arima_11(v, d, 5)
            assert np.allclose(point[k], a, rtol=1e-7, atol=1e-9) and np.allclose(spread[k], b, rtol=1e-7, atol=1e-9)
    for a, b in zip(numerics.stationarity_many(x), map(numerics.stationarity, x), strict=True):
        assert a == b
    models = np.array(["arima", "ses", "mean", "seasonal"] * 9 + ["zero"] * 4)
    used, found = forecast.predict_many(x, models, 3)
    for k in (0, 1, 2, 3, 12, 39):
        own, alone = forecast.predict_many(x[k : k + 1], models[k : k + 1], 3)
        assert own[0] == used[k] and np.allclose(alone[0], found[k], rtol=1e-7, atol=1e-9)
    assert (found[36:] == 0).all() and (used[36:] == "zero").all() and (found[:, 1] <= found[:, 0]).all() and (found[:, 0] <= found[:, 2]).all()


def test_ses_is_the_best_of_its_family():
    x = np.random.default_rng(4).normal(5, 1, 60)
    level, sd = numerics.ses(x)
    assert abs(level - x.mean()) < 0.5 and sd <= 1.01 * x.std()
    assert numerics.ses(np.arange(40.0))[0] > 37


def panel(spark, seed=5, periods=14):
    x = np.random.default_rng(seed).poisson(4, (periods, 4, 5)).astype(float)
    return x, regress.features(grid_cube(spark, x, SPEC), SPEC)


def design(x, t, w):
    last = x[max(t - 1, 0)].reshape(-1)
    n = last.size
    return np.column_stack([np.ones(n), last, (w / w.sum(1, keepdims=True)) @ last, np.full(n, float(t)), np.full(n, math.sin(2 * math.pi * (t % 12) / 12)), np.full(n, math.cos(2 * math.pi * (t % 12) / 12))])


def test_ols_against_least_squares(spark):
    x, rows = panel(spark)
    w = queen(4, 5)
    a, y = np.vstack([design(x, t, w) for t in range(1, 12)]), np.concatenate([x[t].reshape(-1) for t in range(1, 12)])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    fit = regress.fit_ols(rows, 12)
    assert np.allclose(fit.beta, beta, atol=1e-6)
    assert abs(fit.r2 - (1 - ((y - a @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-8
    ahead = dense(regress.predict(fit, rows.where("t >= 12")).collect(), SPEC, 14, "yhat")
    assert np.allclose(ahead[12].reshape(-1), np.maximum(design(x, 12, w) @ beta, 0), atol=1e-6)


def test_sar_against_matrices(spark):
    x, rows = panel(spark, 6)
    w = queen(4, 5)
    ws = w / w.sum(1, keepdims=True)
    a = np.vstack([design(x, t, w) for t in range(1, 12)])
    y = np.concatenate([x[t].reshape(-1) for t in range(1, 12)])
    wy = np.concatenate([ws @ x[t].reshape(-1) for t in range(1, 12)])
    wx = np.vstack([ws @ design(x, t, w)[:, 1:] for t in range(1, 12)])
    z, h = np.column_stack([a, wy]), np.column_stack([a, wx])
    zh = h @ np.linalg.lstsq(h, z, rcond=1e-10)[0]
    beta = np.linalg.lstsq(zh, y, rcond=1e-9)[0]
    fit = regress.fit_sar(rows, SPEC, 12)
    assert np.allclose([*fit.beta, fit.spatial], beta, atol=1e-4)
    ahead = regress.predict_sar(fit, rows.where("t = 12"))
    assert ahead.where("yhat < 0").count() == 0


def test_sem_recovers_lambda(spark):
    spec = GridSpec(1.0, 0.0, 0.0, 12, 12)
    rng = np.random.default_rng(7)
    w = queen(12, 12)
    ws = w / w.sum(1, keepdims=True)
    solve = np.linalg.inv(np.eye(144) - 0.6 * ws)
    x = np.stack([20 + (solve @ rng.normal(0, 1, 144)).reshape(12, 12) for _ in range(20)])
    fit = regress.fit_sem(regress.features(grid_cube(spark, x, spec), spec), spec, 20)
    assert abs(fit.spatial - 0.6) < 0.15


def test_gwr_against_weighted_least_squares(spark):
    x, _ = panel(spark, 8)
    rows = regress.gwr_features(grid_cube(spark, x, SPEC), SPEC, 7)
    table = rows.orderBy("flat_idx").toPandas()
    a = np.column_stack([np.ones(20), x[6].reshape(-1), table["dist_center"], table["seasonal"]])
    assert abs(table["dist_center"].max() - 1) < 1e-12 and table["y"].tolist() == x[7].reshape(-1).tolist()
    for kind in ("gaussian", "bisquare"):
        got = {r.flat_idx: r for r in regress.gwr(rows, 25.0, kind).collect()}
        for i in range(20):
            d = np.hypot(table["cx"] - table["cx"][i], table["cy"] - table["cy"][i]).to_numpy() / 25
            k = np.exp(-0.5 * d * d) if kind == "gaussian" else np.where(d < 1, (1 - d * d) ** 2, 0)
            beta = np.linalg.lstsq(a * np.sqrt(k)[:, None], x[7].reshape(-1) * np.sqrt(k), rcond=None)[0]
            assert abs(got[i].yhat - a[i] @ beta) < 1e-8 and 0 <= got[i].local_r2 <= 1
    scores = regress.gcv_scores(rows, 4).collect()
    assert len(scores) == 4 and regress.gcv_bandwidth(rows, candidates=4).first().gcv == min(s.gcv for s in scores)
    pairs = [math.hypot(table["cx"][i] - table["cx"][j], table["cy"][i] - table["cy"][j]) for i in range(20) for j in range(i)]
    assert abs(regress.cell_distance_quantiles(rows, [0.25]).first()["distance"] - np.percentile(pairs, 25)) < 1e-9


def test_gwr_of_a_quarter_of_a_million_cells(spark):
    spec = GridSpec(1.0, 0.0, 0.0, 500, 500)
    cell = spec.cells(spark)
    y = (F.pmod(F.col("row") * 7 + F.col("col") * 3, F.lit(11)) + F.col("row") / 100).cast("double")
    rows = cell.select("flat_idx", "row", "col", "cx", "cy", y.alias("y"), F.pmod(F.col("row") + F.col("col") * 5, F.lit(7)).cast("double").alias("y_lag"), (F.abs(F.col("cx") - 250) / 250).alias("dist_center"), F.lit(0.5).alias("seasonal"))
    fitted = regress.gwr(rows, 20.0).where("flat_idx IN (0, 125250, 249999)").collect()
    table = rows.toPandas()
    a = np.column_stack([np.ones(len(table)), table["y_lag"], table["dist_center"], table["seasonal"]])
    assert len(fitted) == 3
    for r in fitted:
        own = table.iloc[r.flat_idx]
        w = np.exp(-0.5 * ((table["cx"] - own["cx"]) ** 2 + (table["cy"] - own["cy"]) ** 2) / 400).to_numpy()
        beta = np.linalg.lstsq(a * np.sqrt(w)[:, None], table["y"] * np.sqrt(w), rcond=1e-10)[0]
        at = a[r.flat_idx]
        mean = (w * table["y"]).sum() / w.sum()
        r2 = 1 - (w * (table["y"] - a @ beta) ** 2).sum() / (w * (table["y"] - mean) ** 2).sum()
        assert abs(r.yhat - at @ beta) < 1e-6 and abs(r.local_r2 - r2) < 1e-6 and abs(r.temporal_lag - beta[1]) < 1e-6


def test_additive_model_finds_a_change_of_slope_and_the_season():
    t = np.arange(72)
    truth = lambda at: 20 + 0.8 * at - 1.3 * np.maximum(at - 30, 0) + 4 * np.sin(2 * np.pi * at / 12) + 2 * np.cos(4 * np.pi * at / 12)
    x = truth(t) + np.random.default_rng(3).normal(0, 0.3, 72)
    model = numerics.fit_additive(x)
    near = np.abs(model.knots * 71 - 30) < 6
    assert abs(model.changes[near].sum() + 1.3) < 0.15 and np.abs(model.changes[~near]).sum() < 0.15
    assert 0.15 < model.noise < 0.6
    point, low, high = numerics.seasonal(x, 12)
    ahead = truth(np.arange(72, 84))
    assert np.abs(point - ahead).max() < 1.5 and (low < ahead).all() and (ahead < high).all()
    assert (np.diff(high - low)[1:] > -0.2).all() and high[-1] - low[-1] > high[0] - low[0]
    again = numerics.seasonal(x, 12)
    assert all((a == b).all() for a, b in zip((point, low, high), again, strict=True))
    for flat in (np.zeros(24), np.full(24, 5.0), np.arange(3.0)):
        point, low, high = numerics.seasonal(flat, 3)
        assert np.isfinite([point, low, high]).all() and (low <= high).all()
    assert np.abs(numerics.seasonal(np.full(24, 5.0), 3)[0] - 5).max() < 0.05


def test_penalised_least_squares_meets_its_conditions():
    rng = np.random.default_rng(4)
    a, y = rng.normal(size=(40, 6)), rng.normal(size=40)
    ridge, lasso = np.array([0.5, 0, 0, 2, 0, 0]), np.array([0, 0, 9.0, 0, 3, 200])
    b = numerics.shrunk(a.T @ a, a.T @ y, ridge, lasso)
    slope = a.T @ (y - a @ b) - ridge * b
    assert b[5] == 0 and (np.abs(slope) <= lasso + 1e-6).all()
    assert np.allclose(slope[b != 0], (lasso * np.sign(b))[b != 0], atol=1e-6)


def scored(spark, pred, actual):
    return spark.createDataFrame([(i, 0, i, float(p), float(a)) for i, (p, a) in enumerate(zip(pred, actual, strict=True))], "flat_idx int, row int, col int, pred double, actual double")


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(9)
    pred, actual = np.round(rng.uniform(0, 5, 60), 1), rng.poisson(1.5, 60)
    pairs = scored(spark, pred, actual)
    r = evaluate.report(pairs, 80).first()
    hot = pred >= np.percentile(pred, 80)
    hr, af = actual[hot].sum() / actual.sum(), hot.mean()
    assert np.allclose([r.hit_rate, r.area_fraction, r.pai, r.pei], [hr, af, hr / af, (hr - af) / (1 - af)])
    assert np.allclose([r.rmse, r.mae, r.pearson_r], [np.sqrt(((pred - actual) ** 2).mean()), np.abs(pred - actual).mean(), np.corrcoef(pred, actual)[0, 1]])
    truth = actual > 1
    wins = sum((p > q) + 0.5 * (p == q) for p in pred[truth] for q in pred[~truth]) / (truth.sum() * (~truth).sum())
    assert abs(evaluate.auc(pairs).first()[0] - wins) < 1e-9
    ap, seen = 0.0, 0.0
    for s in sorted(set(pred), reverse=True):
        at = pred >= s
        recall = truth[at].sum() / truth.sum()
        ap, seen = ap + (recall - seen) * truth[at].mean(), recall
    assert abs(evaluate.average_precision(pairs).first()[0] - ap) < 1e-9
    c = evaluate.confusion(pairs).first()
    assert (c.TP, c.FP, c.FN, c.TN) == ((hot & truth).sum(), (hot & ~truth).sum(), (~hot & truth).sum(), (~hot & ~truth).sum())
    whole = evaluate.bundle(pairs).first()
    assert whole.auc == evaluate.auc(pairs).first()[0] and whole.TP == c.TP
    assert evaluate.pai_curve(pairs).count() == 10


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(11)
    by = rng.permutation(5000)[:3000].tolist()
    a = rng.integers(-5, 50, 3000).tolist()
    found = evaluate.running_sums(spark.createDataFrame(list(zip(by, a, strict=True)), "by int, a long").repartition(5), "by", ["a"])
    assert found.columns == ["by", "a", "upto_a"]
    order = np.argsort(by)[::-1]
    assert [(r.by, r.upto_a) for r in found.orderBy(F.desc("by")).collect()] == list(zip(np.array(by)[order].tolist(), np.cumsum(np.array(a)[order]).tolist(), strict=True))
    assert evaluate.running_sums(spark.createDataFrame([], "by int, a long"), "by", ["a"]).count() == 0


def test_uniform_prediction(spark):
    pairs = evaluate.uniform_baseline(scored(spark, range(10), [0, 1, 2, 3, 0, 1, 2, 3, 0, 5]))
    r = evaluate.report(pairs).first()
    assert (r.area_fraction, r.hit_rate, r.pai, r.pei, r.pearson_r) == (1, 1, 1, 0, 0) and evaluate.auc(pairs).first()[0] == 0.5
    single = evaluate.confusion(scored(spark, range(5), [0] * 5)).first()
    assert single.TN + single.FP == 5 and single.precision == 0
    both = evaluate.compare_models({"a": pairs, "b": scored(spark, range(10), range(10))})
    assert {r.model for r in both.collect()} == {"a", "b"}
