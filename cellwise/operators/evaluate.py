"""Scores of a predicted grid against the events that came: a table with row, col, pred and actual."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.grid import GridSpec
from cellwise.operators import quantile
from cellwise.operators.cube import event_counts
from cellwise.operators.lineage import saved


def scored(prediction: DataFrame, events: DataFrame, spec: GridSpec, value: str = "yhat") -> DataFrame:
    """prediction (row, col, value) beside the number of events in each cell."""
    actual = event_counts(events, spec)
    return prediction.select("row", "col", F.col(value).alias("pred")).join(actual, ["row", "col"]).select("flat_idx", "row", "col", "pred", "actual")


def _limits(pairs: DataFrame, percentiles: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """pairs once per percentile, with hot: the prediction is at or over it."""
    rows = quantile.percentiles(pairs, "pred", [p / 100 for p in percentiles], keys)
    named = F.element_at(F.array(*[F.lit(float(p)) for p in percentiles]), F.col("k") + 1)
    rows = rows.select(*keys, named.alias("_named"), F.round("percentile", 9).alias("limit")).withColumnRenamed("_named", "percentile")
    joined = pairs.join(F.broadcast(rows), list(keys)) if keys else pairs.join(F.broadcast(rows))
    return joined.withColumn("hot", F.round("pred", 9) >= F.col("limit"))


def _rates(hot: Column) -> dict[str, Column]:
    total = F.sum("actual")
    hit = F.when(total == 0, 0.0).otherwise(F.sum(F.when(hot, F.col("actual")).otherwise(0.0)) / total)
    area = F.avg(hot.cast("double"))
    return {
        "area_fraction": area,
        "hit_rate": hit,
        "pai": F.when(area == 0, 0.0).otherwise(hit / area),
        "pei": F.when(area == 1, 0.0).otherwise((hit - area) / (1 - area)),
    }


def _errors() -> dict[str, Column]:
    gap = F.col("pred") - F.col("actual")
    spread = F.stddev_pop("pred") * F.stddev_pop("actual")
    flat = (F.stddev_pop("pred") < 1e-12) | (F.stddev_pop("actual") < 1e-12)
    return {"rmse": F.sqrt(F.avg(gap * gap)), "mae": F.avg(F.abs(gap)), "pearson_r": F.when(flat, 0.0).otherwise(F.covar_pop("pred", "actual") / F.when(spread > 0, spread))}


def report(pairs: DataFrame, percentile: float = 80, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (per keys) of all scores at a percentile."""
    made = _rates(F.col("hot")) | _errors() | {"n_actual": F.sum("actual").cast("long"), "threshold_pct": F.first("percentile")}
    rows = _limits(pairs, [percentile], keys)
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg(*[c.alias(n) for n, c in made.items()])


def hit_rate(pairs: DataFrame, percentile: float = 80) -> DataFrame:
    return report(pairs, percentile).select("hit_rate")


def pai(pairs: DataFrame, percentile: float = 80) -> DataFrame:
    return report(pairs, percentile).select("pai")


def pei(pairs: DataFrame, percentile: float = 80) -> DataFrame:
    return report(pairs, percentile).select("pei")


def errors(pairs: DataFrame) -> DataFrame:
    return pairs.agg(*[c.alias(n) for n, c in _errors().items()])


def pai_curve(pairs: DataFrame, percentiles: tuple[float, ...] = tuple(range(50, 100, 5))) -> DataFrame:
    rates = _rates(F.col("hot"))
    return _limits(pairs, list(percentiles)).groupBy("percentile").agg(*[rates[n].alias(n) for n in ("area_fraction", "hit_rate", "pai")])


def running_sums(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """rows (one for each value of by) with upto_<value>: the sums from the greatest by down to the row's own.

    The rows are cut into ranges of by, each summed up in a task of its own, and get what the ranges before it have in all: a
    row a range. No task sees all rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(rows.repartitionByRange(parts, F.desc(by)).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])
    listed = totals.agg(F.collect_list(F.struct("_part", *values)).alias("_all"))

    def before(value: str) -> Column:
        return F.aggregate(F.filter("_all", lambda x: x["_part"] < F.col("_part")), F.lit(0).cast("long"), lambda a, x: a + x[value])

    ahead = totals.select("_part").join(F.broadcast(listed)).select("_part", *[before(v).alias(f"_{v}") for v in values])
    own = Window.partitionBy("_part").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumns({f"upto_{v}": F.sum(v).over(own) for v in values})
    whole = inside.join(F.broadcast(ahead), "_part")
    return whole.withColumns({f"upto_{v}": F.col(f"upto_{v}") + F.col(f"_{v}") for v in values}).drop("_part", *[f"_{v}" for v in values])


def _cumulative(pairs: DataFrame, least_actual: float) -> DataFrame:
    """Per distinct score: own_tp and own_fp, tp and fp from the highest score down, and all there are (p, n). A row a score, as many as cells at most."""
    truth = (F.col("actual") > least_actual).cast("long")
    scores = pairs.groupBy(F.round("pred", 9).alias("threshold")).agg(F.sum(truth).alias("own_tp"), F.sum(1 - truth).alias("own_fp"))
    found = running_sums(scores, "threshold", ["own_tp", "own_fp"])
    whole = scores.agg(F.sum("own_tp").alias("p"), F.sum("own_fp").alias("n"))
    return found.select("threshold", "own_tp", "own_fp", F.col("upto_own_tp").alias("tp"), F.col("upto_own_fp").alias("fp")).join(F.broadcast(whole))


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def roc_curve(pairs: DataFrame, least_actual: float = 1) -> DataFrame:
    """fpr, tpr, threshold, truth being more than least_actual events; the origin is left to the reader of the curve."""
    return _cumulative(pairs, least_actual).select("threshold", _share(F.col("fp"), F.col("n")).alias("fpr"), _share(F.col("tp"), F.col("p")).alias("tpr"))


def auc(pairs: DataFrame, least_actual: float = 1) -> DataFrame:
    """Area under the ROC curve by trapezoids."""
    # What came before a score is what has come with it, less its own.
    rows = _cumulative(pairs, least_actual)
    tpr, before = _share(F.col("tp"), F.col("p")), _share(F.col("tp") - F.col("own_tp"), F.col("p"))
    return rows.select((_share(F.col("own_fp"), F.col("n")) * (tpr + before) / 2).alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc"))


def pr_curve(pairs: DataFrame, least_actual: float = 1) -> DataFrame:
    found = F.col("tp") + F.col("fp")
    return _cumulative(pairs, least_actual).select("threshold", _share(F.col("tp"), found).alias("precision"), _share(F.col("tp"), F.col("p")).alias("recall"))


def average_precision(pairs: DataFrame, least_actual: float = 1) -> DataFrame:
    precision, step = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("own_tp"), F.col("p"))
    return _cumulative(pairs, least_actual).select((step * precision).alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("average_precision"))


def confusion(pairs: DataFrame, percentile: float = 80, least_actual: float = 1) -> DataFrame:
    """TP, FP, FN, TN and the rates made of them; counted also where only one class occurs."""
    rows = _limits(pairs, [percentile]).select("hot", (F.col("actual") > least_actual).alias("true"))
    count = lambda c: F.sum(c.cast("long"))
    hot, true = F.col("hot"), F.col("true")
    n = rows.agg(count(hot & true).alias("TP"), count(hot & ~true).alias("FP"), count(~hot & true).alias("FN"), count(~hot & ~true).alias("TN"))
    p, r = _share(F.col("TP"), F.col("TP") + F.col("FP")), _share(F.col("TP"), F.col("TP") + F.col("FN"))
    out = n.select("*", p.alias("precision"), r.alias("recall"), _share(F.col("TP") + F.col("TN"), F.col("TP") + F.col("FP") + F.col("FN") + F.col("TN")).alias("accuracy"))
    return out.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def bundle(pairs: DataFrame, percentile: float = 80, least_actual: float = 1) -> DataFrame:
    """report, AUC, average precision and the confusion matrix in one row."""
    parts = [report(pairs, percentile), auc(pairs, least_actual), average_precision(pairs, least_actual), confusion(pairs, percentile, least_actual)]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)


FULL = ["pai", "hit_rate", "auc", "f1", "precision", "recall", "rmse", "mae"]


def compare_in_full(models: dict[str, DataFrame], percentile: float = 80, least_actual: float = 1) -> DataFrame:
    """model and eight scores of several scored tables, those of hotspots at a percentile and of the ROC curve among them."""
    return reduce(DataFrame.unionByName, [bundle(pairs, percentile, least_actual).select(F.lit(name).alias("model"), *FULL) for name, pairs in models.items()])


def compare_models(models: dict[str, DataFrame], percentile: float = 80) -> DataFrame:
    """model, hit_rate, pai, pei, rmse, mae, pearson_r of several scored tables: one plan over their union."""
    tagged = [df.select(F.lit(name).alias("model"), "pred", "actual") for name, df in models.items()]
    rows = report(reduce(DataFrame.unionByName, tagged), percentile, ("model",))
    return rows.select("model", "hit_rate", "pai", "pei", "rmse", "mae", "pearson_r")


def uniform_baseline(pairs: DataFrame) -> DataFrame:
    """The same prediction for every cell: the mean of the actual counts."""
    mean = pairs.agg(F.avg("actual").alias("pred"))
    return pairs.drop("pred").join(F.broadcast(mean))
