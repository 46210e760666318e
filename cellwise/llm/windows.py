"""Repeated windows of tokens: anchors, and a count-min sketch that says which may repeat.

The anchor of a window is its gram (some consecutive tokens) with the lowest hash, the leftmost of equal ones. Equal
windows have equal anchors, and neighbouring windows mostly share one, so a text has far fewer anchors than
windows. The sketch counts anchors: its estimate for a window's anchor is never below the number of documents' windows
with that content at different places, so a window whose estimate is one can't repeat.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellwise.llm.common import lowest, mix64

#: Rows of the sketch; bits of a slice, which one task merges: there are as many slices as the sketch has bits for.
DEPTH, SLICE_BITS = 2, 20
#: Anchors that a task gathers before it gives a sketch.
GATHERED = 4_000_000
SALTS = (0x51ED270B7F4A7C15, 0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Plan:
    """Sizes of a sketch. rounds: beyond the largest sketch, anchors are taken in so many parts, one after the other.

    There are few rounds at most; beyond them the sketch gets fuller, and more that does not repeat is shuffled and sorted.
    """

    window: int
    gram: int
    bits: int
    rounds: int

    @staticmethod
    def of(tokens: int, window: int, gram: int, most_bits: int = 30, most_rounds: int = 4) -> Plan:
        """Four cells an anchor, up to 2**most_bits cells a row of the sketch (a bit each, in memory of every task)."""
        anchors = max(1, 2 * tokens // (window - gram + 2))
        bits = min(most_bits, max(16, math.ceil(math.log2(4 * anchors))))
        return Plan(window, gram, bits, min(most_rounds, math.ceil(anchors / (1 << most_bits))))


def anchor_runs(grams: np.ndarray, rows: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows inside rows, as runs with one anchor: first start, number of windows, row, place of the anchor."""
    span = plan.window - plan.gram + 1
    if len(grams) < span:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    low = lowest((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), span)
    ends = np.maximum(rows[1:] - plan.window + 1, rows[:-1])  # after a row's last window
    heads = np.unique(np.concatenate([np.flatnonzero(low[1:] != low[:-1]) + 1, rows[:-1], ends]))
    heads = heads[heads < len(low)]
    sizes = np.diff(np.r_[heads, len(low)])
    row = np.searchsorted(rows, heads, side="right") - 1
    inside = heads < ends[np.minimum(row, len(ends) - 1)]
    heads, sizes, row = heads[inside], sizes[inside], row[inside]
    return heads, sizes, row, (low[heads] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def in_round(grams: np.ndarray, plan: Plan, turn: int) -> np.ndarray:
    return (grams >> np.uint64(7)) % np.uint64(plan.rounds) == np.uint64(turn) if plan.rounds > 1 else np.ones(len(grams), bool)


def _cells(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix64(grams ^ np.uint64(SALTS[row])) >> np.uint64(64 - bits)


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers, a byte each: a number is the sum of its bytes, all 255 but the last."""
    times = numbers // 255
    out = np.full(len(numbers) + int(times.sum()), 255, np.uint8)
    out[np.cumsum(times + 1) - 1] = numbers % 255
    return out.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers' running sum, and the numbers."""
    raw = np.frombuffer(data, np.uint8)
    total = np.cumsum(raw, dtype=np.int64)[raw != 255]
    return total, np.diff(np.r_[0, total])


def _slice_bits(bits: int) -> int:
    return min(SLICE_BITS, bits - 6)


def sketch_rows(grams: np.ndarray, bits: int) -> pa.RecordBatch:
    """A partition's sketch: for each slice of a row, its cells that are not zero (as gaps) and their counts, less one."""
    slices, cells, counts = [], [], []
    low = _slice_bits(bits)
    parts = 1 << (bits - low)
    for row in range(DEPTH):
        cell, count = np.unique(_cells(grams, row, bits), return_counts=True)
        of = (cell >> np.uint64(low)).astype(np.int64)
        ends = np.searchsorted(of, np.arange(parts + 1))
        inside = (cell & np.uint64((1 << low) - 1)).astype(np.int64)
        for k in range(parts):
            if ends[k] < ends[k + 1]:
                slices.append(row * parts + k)
                own = slice(ends[k], ends[k + 1])
                cells.append(_packed(np.diff(np.r_[0, inside[own]])))
                counts.append(_packed(count[own] - 1))
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], ["slice", "cells", "counts"])


@dataclass
class Sketch:
    """The merged sketch, as far as it is asked: cells of two or more, and the few cells over the levels (cell * 4 + level)."""

    bits: int
    twice: np.ndarray
    busy: list[np.ndarray]

    def repeated(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which grams may occur twice or more, and how many levels they may have reached."""
        yes, level = np.ones(len(grams), bool), np.full(len(grams), 3)
        for row in range(DEPTH):
            cell = _cells(grams, row, self.bits).astype(np.int64)
            yes &= (self.twice[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
            own = np.zeros(len(grams), np.int64)
            if len(busy := self.busy[row]):
                at = np.minimum(np.searchsorted(busy >> 2, cell), len(busy) - 1)
                own = np.where(busy[at] >> 2 == cell, busy[at] & 3, 0)
            level = np.minimum(level, own)
        return yes, level


def merged_sketch(rows: DataFrame, make: Callable[[pa.Table], np.ndarray], plan: Plan, parts: Callable, levels: tuple[int, ...] = ()) -> Sketch:
    """The sketch of what make finds in the parts of rows. Partition sketches are added slice by slice, never whole.

    Two bits of 2**plan.bits cells come to the driver, at most 2 * 2**30 bits, and the cells whose counts reach a level
    (at most the input's anchors by the lowest level).
    """
    low = _slice_bits(plan.bits)
    slices = 1 << (plan.bits - low)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts(batches):
            held.append(make(part))
            size += len(held[-1])
            if size > GATHERED:
                yield sketch_rows(np.concatenate(held), plan.bits)
                held, size = [], 0
        if size:
            yield sketch_rows(np.concatenate(held), plan.bits)

    def done(at: int, total: np.ndarray) -> pa.RecordBatch:
        level = sum(((total >= x).astype(np.uint32) for x in levels), np.zeros(len(total), np.uint32))
        cells = np.flatnonzero(level).astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary()), pa.array([(cells << 2 | level[cells]).tobytes()], pa.binary())], ["slice", "twice", "busy"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = -1, np.zeros(0, np.uint32)
        for batch in batches:
            for k, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != at:
                    if at >= 0:
                        yield done(at, total)
                    at, total = k, np.zeros(1 << low, np.uint32)
                cell, more = _unpacked(cells)[0], _unpacked(counts)[1] + 1
                total[cell] = np.minimum(total[cell].astype(np.int64) + more, 2**32 - 1)
        if at >= 0:
            yield done(at, total)

    partial = rows.mapInArrow(count, "slice int, cells binary, counts binary")
    whole = partial.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, twice binary, busy binary")
    twice, busy = np.zeros((DEPTH, max(1, (1 << plan.bits) >> 3)), np.uint8), [[] for _ in range(DEPTH)]
    width = (1 << low) >> 3
    for k, bits, cells in whole.toLocalIterator():
        row, at = divmod(k, slices)
        twice[row, at * width : (at + 1) * width] = np.frombuffer(bits, np.uint8)
        busy[row].append(np.frombuffer(cells, np.uint32).astype(np.int64) + (at << low << 2))
    return Sketch(plan.bits, twice, [np.sort(np.concatenate(b)) if b else np.zeros(0, np.int64) for b in busy])


def runs(starts: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of consecutive starts; breaks: a value that changes between rows."""
    if not len(starts):
        return starts, starts
    heads = np.flatnonzero(np.r_[True, (starts[1:] != starts[:-1] + 1) | (breaks[1:] != breaks[:-1])])
    return heads, np.diff(np.r_[heads, len(starts)])


def covered(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marks of the n places inside any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + sizes, n), -1)
    return np.cumsum(edge[:n]) > 0


def merged(spans: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of what spans (start << 32 | number of windows) cover together; what touches is one."""
    spans = np.sort(spans)
    starts, ends = spans >> 32, np.maximum.accumulate((spans >> 32) + (spans & 0xFFFFFFFF) + window - 1)
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]


def broadcast(spark: SparkSession, value: object):
    return spark.sparkContext.broadcast(value)
