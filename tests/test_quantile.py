import numpy as np

from cellwise.operators import quantile

SHARES = [0.0, 0.1, 0.5, 0.8, 0.999, 1.0]


def test_against_numpy(spark, monkeypatch):
    """Ties, a far outlier (which leaves all others in one bin), nulls, what is not finite, groups of one value; few values at a time."""
    monkeypatch.setattr(quantile, "FEW", 20)
    monkeypatch.setattr(quantile, "BINS", 8)
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=500), "b": np.round(rng.normal(size=400), 1), "c": np.r_[rng.random(300), 1e300, -1e300], "d": [7.0] * 100, "e": [3.5]}
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    rows += [("a", None), ("a", float("nan")), ("a", float("inf")), ("f", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r.g, r.k): r.percentile for r in quantile.percentiles(df, "v", SHARES, ("g",)).collect()}
    for g, values in groups.items():
        assert np.allclose([got[g, k] for k in range(len(SHARES))], np.quantile(values, SHARES), rtol=1e-9, atol=1e-12), g
    assert {got["f", k] for k in range(len(SHARES))} == {None}
    one = [r.percentile for r in quantile.percentiles(df.where("g = 'b'"), "v", SHARES).orderBy("k").collect()]
    assert one == [got["b", k] for k in range(len(SHARES))]


def test_equal_to_sparks_own(spark):
    df = spark.range(100_000).selectExpr("pow(id % 977, 3) / 7 AS v")
    own = df.selectExpr("percentile(v, array(0.1, 0.25, 0.8)) AS p").first().p
    assert [r.percentile for r in quantile.percentiles(df, "v", [0.1, 0.25, 0.8]).orderBy("k").collect()] == own


def test_empty(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert [r.percentile for r in quantile.percentiles(none, "v", [0.5]).collect()] == [None]
    assert quantile.percentiles(none, "v", [0.5], ("g",)).count() == 0
