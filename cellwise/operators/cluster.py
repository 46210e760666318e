"""Density clustering of events in space and time (ST-DBSCAN), order-free."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.operators.lineage import connected_components, saved
from cellwise.operators.spatial_join import block_pairs


def _near(a: np.ndarray, b: np.ndarray, one: bool, eps: float, seconds: float) -> np.ndarray:
    """Which of block a's events (rows x, y, .., ts) are neighbours of b's; none of itself."""
    near = np.sqrt((a[0][:, None] - b[0]) ** 2 + (a[1][:, None] - b[1]) ** 2) <= eps
    near &= np.abs(a[-1][:, None] - b[-1]) <= seconds
    if one:
        np.fill_diagonal(near, False)
    return near


def _keyed(events: DataFrame) -> DataFrame:
    """events with _row, which tells rows apart whatever their event_id; written, so that it stays."""
    return saved(events.withColumn("_row", F.monotonically_increasing_id()), "events")


def stdbscan(events: DataFrame, eps_spatial: float = 1000.0, eps_seconds: float = 30 * 86400.0, min_samples: int = 10) -> DataFrame:
    """event_id and cluster of every event, a row each also where event_ids repeat; -1 is noise. See labelled."""
    return labelled(_keyed(events.select("event_id", "x", "y", "datetime")), eps_spatial, eps_seconds, min_samples).select("event_id", "cluster")


#: A cell's side as a part of eps_spatial: its diagonal is shorter than that, so that all events of a cell are neighbours.
SIDE = 0.7
CELL = ["_cx", "_cy", "_ct"]
#: Cells that events within reach may lie in.
AROUND = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in (-1, 0, 1)]


def _celled(events: DataFrame, eps: float, micros: int) -> DataFrame:
    """events with _ts, in microseconds, and their cell; nulls without event_id, place or time."""
    rows = events.withColumn("_ts", F.unix_micros(F.col("datetime").cast("timestamp")))
    known = F.expr("event_id IS NOT NULL AND _ts IS NOT NULL AND x - x = 0 AND y - y = 0")
    span = max(1, micros)
    cell = [F.floor(F.col("x") / (SIDE * eps)), F.floor(F.col("y") / (SIDE * eps)), F.expr(f"(_ts - pmod(_ts, {span})) DIV {span}")]
    return rows.withColumns({c: F.when(known, v) for c, v in zip(CELL, cell, strict=True)})


def _sent(rows: DataFrame, around: list[tuple[int, int, int]], eps: float | None = None) -> DataFrame:
    """rows once for each cell around their own; with eps, of a place's only those whose square it reaches."""
    moves = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("ijk", m, strict=True)]) for m in around]))
    to = rows.withColumn("_m", moves).withColumns({c: F.col(c) + F.col(f"_m.{m}") for c, m in zip(CELL, "ijk", strict=True)}).drop("_m")
    if eps is None:
        return to
    gap = [F.greatest(F.col(c) * (SIDE * eps) - F.col(v), F.col(v) - (F.col(c) + 1) * (SIDE * eps), F.lit(0.0)) for c, v in (("_cx", "x"), ("_cy", "y"))]
    # A little more than eps, as a cell's border is rounded.
    return to.where(gap[0] * gap[0] + gap[1] * gap[1] <= (1.001 * eps) ** 2)


def labelled(events: DataFrame, eps_spatial: float = 1000.0, eps_seconds: float = 30 * 86400.0, min_samples: int = 10) -> DataFrame:
    """events, which have _row, with the cluster of each; -1 is noise.

    An event is core with min_samples neighbours or more, itself not counted. Clusters are the components of core events
    within reach of each other, numbered by their smallest event_id; a border event belongs to the smallest-numbered
    cluster it reaches. Events without place or time are noise.

    All events of a small cell are neighbours. So those of a cell of more than min_samples are core, and the core events of a
    cell are of one cluster: only events of other cells are compared with those around, and clusters are components of
    cells, linked by a few events of each; core events are compared only where cells around are then still apart.
    """
    eps, micros = float(eps_spatial), int(round(eps_seconds * 1e6, 3))
    placed = _celled(events, eps, micros)
    points = placed.where("_cx IS NOT NULL").select(F.col("_row").alias("id"), "event_id", "x", "y", F.col("_ts").alias("ts"), *CELL)
    many = saved(points.groupBy(*CELL).agg(F.count("*").alias("n")), "cells")
    near = F.expr(f"sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) <= {eps!r}D AND abs(ts - ts2) <= {micros}L")

    few = points.join(many.where(F.col("n") <= min_samples), CELL)
    other = points.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("ts").alias("ts2"), *CELL)
    met = _sent(few, [m for m in AROUND if m != (0, 0, 0)], eps).join(other, CELL).where(near)
    lone = saved(met.groupBy("id", "n").agg(F.count("*").alias("met")).where(F.col("met") + F.col("n") - 1 >= min_samples).select("id"), "core")
    judged = points.join(many, CELL).join(lone.withColumn("found", F.lit(True)), "id", "left").withColumn("core", (F.col("n") > min_samples) | F.col("found").isNotNull()).drop("n", "found")
    core = judged.where("core")

    # Of each cell's core events: some at its corners and ends, and the bounds.
    ends = [f(F.struct("x", "y", "ts"), v) for v in (F.col("x") + F.col("y"), F.col("x") - F.col("y"), F.col("ts")) for f in (F.min_by, F.max_by)]
    bounds = {f"{c}_{e}": f(c) for c in ("x", "y", "ts") for e, f in (("a", F.min), ("b", F.max))}
    cells = saved(core.groupBy(*CELL).agg(F.min("id").alias("node"), F.min("event_id").alias("least"), F.array_distinct(F.array(*ends)).alias("some"), *[v.alias(c) for c, v in bounds.items()]), "core-cells")
    twin = cells.select(*CELL, *[F.col(c).alias(f"{c}2") for c in ("node", "some", *bounds)])
    apart = _gap("x") * _gap("x") + _gap("y") * _gap("y")
    both = _sent(cells, [m for m in AROUND if m > (0, 0, 0)]).join(twin, CELL).where((F.sqrt(apart) <= eps) & (_gap("ts") <= micros))
    linked = both.where(F.exists("some", lambda p: F.exists("some2", lambda q: _reach(p, q, eps, micros)))).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    parts = connected_components(linked)
    rooted = saved(cells.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")

    far = rooted.select(*CELL, *[F.col(c).alias(f"{c}2") for c in ("root", *bounds)])
    own = ["root", *bounds]
    open_pairs = _sent(rooted.select(*CELL, *own), [m for m in AROUND if m != (0, 0, 0)]).join(far, CELL).where("root <> root2").where((F.sqrt(apart) <= eps) & (_gap("ts") <= micros))
    left = core.join(open_pairs.select(*CELL, "root2", *[F.col(c).alias(f"{c}1") for c in bounds], F.col("root").alias("root1")), CELL)
    within = [F.greatest(F.col(f"{c}_a1") - F.col(c), F.col(c) - F.col(f"{c}_b1"), F.lit(0)) for c in ("x", "y", "ts")]
    left = left.where((F.sqrt(within[0] * within[0] + within[1] * within[1]) <= eps) & (within[2] <= micros))
    left = left.select("id", F.col("root2").alias("root"), "x", "y", F.col("ts").cast("double").alias("ts")).distinct()

    def link(_, a, b, one):
        near = _near(a, b, one, eps, micros)
        ids = np.r_[a[2], b[2]].view(np.int64)
        i, j = np.nonzero(near & (a[2].view(np.int64)[:, None] != b[2].view(np.int64)))
        found = np.unique(np.stack([ids[i], ids[j + len(a[2])]]), axis=1)
        return [found[0], found[1]] if len(i) else []

    again = connected_components(block_pairs(left, eps, (), ("root",), link, "a long, b long", float(max(1, micros))))
    final = rooted.join(again.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("root", F.coalesce("top", "root"))
    final = saved(final.select(*CELL, "root", "least"), "final")
    roots = final.groupBy("root").agg(F.min("least").alias("least"))
    # One row a cluster: far fewer than events; numbered in the order of their smallest event.
    numbers = roots.withColumn("cluster", (F.row_number().over(Window.orderBy("least", "root")) - 1).cast("int"))
    named = saved(final.join(numbers, "root").select(*CELL, "cluster"), "named")

    border = _sent(judged.where("NOT core").select("id", "x", "y", "ts", *CELL), AROUND, eps)
    theirs = core.join(named, CELL).select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("ts").alias("ts2"), "cluster", *CELL)
    reached = border.join(theirs, CELL).where(near).groupBy(F.col("id").alias("_row")).agg(F.min("cluster").alias("_near"))
    told = placed.join(many.select(*CELL, (F.col("n") > min_samples).alias("_all")), CELL, "left").join(named, CELL, "left")
    told = told.join(lone.select(F.col("id").alias("_row"), F.lit(True).alias("_core")), "_row", "left").join(reached, "_row", "left")
    cluster = F.when(F.coalesce("_all", F.lit(False)) | F.col("_core").isNotNull(), F.col("cluster")).otherwise(F.coalesce("_near", F.lit(-1)))
    return told.select(*events.columns, cluster.cast("int").alias("cluster"))


def _gap(c: str) -> Column:
    """How far the bounds of one cell's events are from those of another's."""
    return F.greatest(F.col(f"{c}_a2") - F.col(f"{c}_b"), F.col(f"{c}_a") - F.col(f"{c}_b2"), F.lit(0))


def _reach(p: Column, q: Column, eps: float, micros: int) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return (F.sqrt(dx * dx + dy * dy) <= eps) & (F.abs(p["ts"] - q["ts"]) <= micros)


def clusters_of(events: DataFrame, eps_spatial: float = 1000.0, eps_seconds: float = 30 * 86400.0, min_samples: int = 10) -> DataFrame:
    """_row and cluster of every event; see labelled."""
    return labelled(events, eps_spatial, eps_seconds, min_samples).select("_row", "cluster")


def fit_transform(events: DataFrame, **options) -> DataFrame:
    """events with their cluster: as many rows as before, also where event_ids repeat."""
    return labelled(_keyed(events), **options).drop("_row")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Per cluster: events, first and last date, centroid, whole days between the first and the last event."""
    rows = clustered.where("cluster <> -1").groupBy("cluster")
    out = rows.agg(F.count("*").alias("n_events"), F.min("datetime").alias("a"), F.max("datetime").alias("b"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"))
    days = F.timestamp_diff("DAY", F.col("a"), F.col("b")).cast("int")
    return out.select("cluster", "n_events", F.to_date("a").alias("start_date"), F.to_date("b").alias("end_date"), "centroid_x", "centroid_y", days.alias("duration_days"))


def largest(summary: DataFrame, k: int = 10) -> DataFrame:
    """The k clusters with most events: ties by number."""
    return summary.orderBy(F.desc("n_events"), "cluster").limit(k)


def monthly_activity(clustered: DataFrame) -> DataFrame:
    """Events per cluster and month, months between without any included."""
    months = clustered.where("cluster <> -1").groupBy("cluster", F.to_date(F.date_trunc("month", "datetime")).alias("month")).agg(F.count("*").alias("n"))
    ends = months.groupBy("cluster").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = ends.select("cluster", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return every.join(months, ["cluster", "month"], "left").select("cluster", "month", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
