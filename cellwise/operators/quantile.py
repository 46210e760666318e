"""Exact percentiles of any number of values, by histograms that are refined where the wanted ranks lie.

Spark's percentile holds every different value of a group in one buffer. Here a pass counts the values of the ranges that hold a
wanted rank in BINS bins, each with its least and greatest value, until such a range has few values or only one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.operators.lineage import dropped, saved

#: Bins of a range, and values of a range that are put in order at once.
BINS, FEW = 4096, 1 << 15


def percentiles(rows: DataFrame, value: str, shares: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, k (the share's place in shares) and percentile, between two neighbouring values in proportion, as Spark's percentile.

    Nulls and values that are not finite don't count; a group without others has null, as has an empty table without keys; rows
    with a null key are no group; ties are values of their own. What is kept between passes has two rows a share and key.
    """
    own = rows.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("v"))
    own = saved(own.withColumn("v", F.when(F.abs("v") < float("inf"), F.col("v"))), "values")
    by = [f"_g{i}" for i in range(len(keys))]
    ends = own.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("s")) for k, s in enumerate(shares)]))
    spot = F.when(F.col("n") > 0, F.col("share.s") * (F.col("n") - 1))
    wanted = ends.withColumn("share", each).select(*by, "n", "lo", "hi", F.col("share.k").alias("k"), spot.alias("spot"))
    wanted = saved(wanted.withColumns({"first": F.floor("spot"), "second": F.ceil("spot")}), "wanted")
    ranks = wanted.where("n > 0").select(*by, F.explode(F.array("first", "second")).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("m"), "lo", "hi").distinct()
    used = [own, wanted]
    wide = f"m > {FEW} AND lo < hi"
    while not (open_ := ranks.where(wide)).isEmpty():
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bins = _within(own, open_, by).withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        ranks = saved(ranks.where(f"NOT ({wide})").unionByName(_found(open_, bins, by, "bin")), "ranks")
        used.append(ranks)
    single = ranks.where("lo = hi").select(*by, "rank", F.col("lo").alias("v"))
    few = ranks.where("lo < hi")
    at = single.unionByName(_found(few, _within(own, few, by), by, "v").select(*by, "rank", F.col("lo").alias("v")))
    first, second = (at.select(*by, F.col("rank").alias(c), F.col("v").alias(f"v_{c}")) for c in ("first", "second"))
    made = wanted.join(first, [*by, "first"], "left").join(second, [*by, "second"], "left")
    between = (F.col("second") - F.col("spot")) * F.col("v_first") + (F.col("spot") - F.col("first")) * F.col("v_second")
    made = made.withColumn("percentile", F.when(F.col("v_first") == F.col("v_second"), F.col("v_first")).otherwise(between))
    out = saved(made.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], "k", "percentile"), "percentiles")
    for table in used:
        dropped(table)
    return out


def _within(own: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """The values that lie in a range of ranks, with it. Without keys there are two ranges a share at most, which are sent to the values."""
    ranges = ranks.select(*by, "below", "lo", "hi").distinct()
    if not by:
        return own.join(F.broadcast(ranges), F.col("v").between(F.col("lo"), F.col("hi")))
    return own.join(ranges, by).where(F.col("v").between(F.col("lo"), F.col("hi")))


def _found(ranks: DataFrame, values: DataFrame, by: list[str], part: str) -> DataFrame:
    """Each rank with the part of its range that it lies in: the values below it, in it, its least and its greatest value."""
    where = [*by, "below", "lo", "hi"]
    counts = values.groupBy(*where, part).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    upto = F.sum("c").over(Window.partitionBy(*where).orderBy(part)) + F.col("below")
    placed = counts.withColumn("upto", upto)
    there = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))
    both = ranks.join(placed, where).where(there)
    return both.select(*by, "rank", (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("m"), F.col("least").alias("lo"), F.col("most").alias("hi"))
