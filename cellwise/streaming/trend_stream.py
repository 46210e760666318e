"""Trends kept up to date from a stream: each cell's Mann-Kendall sum goes on from window to window in its state."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cellwise.functions.grid import GridSpec
from cellwise.operators.hotspot import mann_kendall_columns
from cellwise.streaming.cube_stream import write_counts

STATE = "first long, last long, s long, positive long, seen array<long>, times array<long>"
ROWS = "flat_idx int, t long, first long, n long, s long, positive long"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Trend(StatefulProcessor):
    """Of a cell: its first and last window, the sum of signs over all pairs of windows between them, how many are not empty, and how often each count was seen.

    A window is compared with the counts seen, not with the windows; windows without events in between count as zeros.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trend", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("t")
        first, last, s, positive, seen, times = self.state.get() if self.state.exists() else (int(new["t"].iloc[0]), int(new["t"].iloc[0]) - 1, 0, 0, [], [])
        counts, out = Counter(dict(zip(seen, times, strict=True))), []
        for t, n in zip(new["t"].tolist(), new["n"].tolist(), strict=True):
            empty = t - last - 1
            s -= empty * positive
            counts[0] += empty
            s += sum(k if value < n else -k if value > n else 0 for value, k in counts.items())
            counts[n] += 1
            positive += n > 0
            last = t
            out.append((key[0], t, first, n, s, positive))
        self.state.update((first, last, s, positive, list(counts), list(counts.values())))
        yield pd.DataFrame(out, columns=["flat_idx", "t", "first", "n", "s", "positive"])

    def close(self) -> None:
        pass


def running_trends(counts: DataFrame, seconds: int = 86400) -> DataFrame:
    """streaming_counts with windows of so many seconds: a row per final window and cell with events, with the state of the cell's trend after it."""
    rows = counts.select("flat_idx", F.floor(F.unix_seconds("period_start") / seconds).alias("t"), "n")
    return rows.groupBy("flat_idx").transformWithStateInPandas(Trend(), ROWS, "Append", "None")


def write_trends(trends: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """As write_counts; the state is RocksDB's, which this kind of operator needs."""
    conf = trends.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKS)
    try:
        return write_counts(trends, path, checkpoint, available_now)
    finally:
        conf.set(STORE, before)


def trends_at(rows: DataFrame, spec: GridSpec, first: int, last: int) -> DataFrame:
    """row, col, n, s, z, trend, significant of every cell over the windows first to last, as mann_kendall of the whole cube gives them.

    rows are those of running_trends up to last. Empty windows before a cell's first and after its last one with events are
    below or equal to all others, so they only add or take the number of windows with events. A cell without events has s 0.
    """
    known = rows.where(F.col("t").between(first, last)).groupBy("flat_idx").agg(F.max_by(F.struct("t", "first", "s", "positive"), "t").alias("r"))
    ends = F.col("r.s") + (F.col("r.first") - first - (last - F.col("r.t"))) * F.col("r.positive")
    every = spec.cells(rows.sparkSession).select("flat_idx", "row", "col").join(known, "flat_idx", "left")
    made = every.select("row", "col", F.lit(last - first + 1).cast("int").alias("n"), F.coalesce(ends, F.lit(0)).cast("double").alias("s"))
    return made.withColumns(mann_kendall_columns(F.col("n"), F.col("s")))
