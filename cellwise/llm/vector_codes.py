"""Vector code compression: product quantization whose codebooks are made by Yinyang Lloyd rounds in integers.

A vector is cut into equal parts, and each part position has a codebook. The entries of a codebook are put into groups once.
A vector keeps, for each part and group, one lower bound of its distance to the entries of that group (without the one it is
assigned to). When entries move, the bound falls by the group's largest move; only groups whose bound does not exceed the
distance to the vector's own entry are scanned. Bounds are floats, rounded so that they never exclude too much; which entry is
nearest, ties included, is decided in integers.

The vectors and their bounds are a table that each round reads and writes. Sums per entry are added up inside tasks first;
the driver holds only codebooks (parts x entries vectors).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import dropped, extended, saved

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries in a group, about.
GROUP = 16
#: Relative slack of the bounds, above the rounding of 32-bit floats.
SLACK = 1e-6
#: Rows worked on at once.
ROWS = 4096
#: Larger integers are held as this.
LARGEST = 2**62


def _small(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether all sums in a squared distance are integers below 2**53."""
    most = max((int(np.abs(a).max()) for a in (x, y) if a.size), default=0)
    return 8 * max(1, x.shape[1]) * most * most < 2**53


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all x to all entries: in 64 bits where they fit, in Python's integers elsewhere."""
    if _small(x, entries):
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    a, b = x.astype(object), entries.astype(object)
    return np.stack([((a - e) ** 2).sum(axis=1) for e in b], axis=1)


def squared_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distance of each x to its y."""
    gap = x - y if _small(x, y) else x.astype(object) - y.astype(object)
    return (gap * gap).sum(axis=1) if x.shape[1] else np.zeros(len(x), np.int64)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def group_entries(entries: np.ndarray, size: int = GROUP, rounds: int = 5) -> np.ndarray:
    """The group of each entry, by a few rounds of k-means over the entries. Any grouping is right; a close one skips more."""
    count = max(1, len(entries) // size)
    x = entries.astype(np.float64)
    centres = x[:: max(1, len(x) // count)][:count]
    for _ in range(rounds):
        of = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([x[of == g].mean(axis=0) if (of == g).any() else centres[g] for g in range(len(centres))])
    return of


@dataclass
class Codebook:
    """A part's entries, the group of each, and how far at most an entry of each group moved in the last update."""

    entries: np.ndarray
    of: np.ndarray
    moved: np.ndarray

    @staticmethod
    def start(entries: np.ndarray) -> Codebook:
        of = group_entries(entries)
        return Codebook(entries, of, np.zeros(int(of.max()) + 1))

    def updated(self, entries: np.ndarray) -> Codebook:
        moves = np.array([float(sum(int(d) ** 2 for d in a.astype(object) - b.astype(object))) ** 0.5 for a, b in zip(entries, self.entries, strict=True)])
        return Codebook(entries, self.of, np.array([moves[self.of == g].max(initial=0.0) for g in range(len(self.moved))]))


def assign(x: np.ndarray, book: Codebook, code: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each x (ties to the lower index), the bounds, the squared distances, and how many were worked out.

    code and lower are those of the round before; a bound below zero says nothing.
    """
    lower = lower - book.moved[None, :] * (1 + SLACK)
    own, done = squared_pairs(x, book.entries[code]), len(x)
    best, found, least = own.copy(), code.copy(), _root(own) * (1 + SLACK)
    first, second = np.full(lower.shape, np.inf), np.full(lower.shape, np.inf)
    open_ = lower <= least[:, None]
    for g in range(lower.shape[1]):
        at = np.flatnonzero(open_[:, g])
        members = np.flatnonzero(book.of == g)
        if not len(at) or not len(members):
            continue
        d = squared(x[at], book.entries[members])
        done += d.size
        near = _root(d)
        near[members[None, :] == code[at][:, None]] = np.inf
        lowest = np.partition(near, min(1, near.shape[1] - 1), axis=1)
        first[at, g] = lowest[:, 0]
        if near.shape[1] > 1:
            second[at, g] = lowest[:, 1]
        k = d.argmin(axis=1)  # the first of equal ones: the lowest index
        least_d, least_k = d[np.arange(len(at)), k], members[k]
        better = (least_d < best[at]) | ((least_d == best[at]) & (least_k < found[at]))
        best[at[better]], found[at[better]] = least_d[better], least_k[better]
    lower = np.where(open_, first * (1 - SLACK), lower)
    changed = np.flatnonzero(found != code)
    if len(changed):
        new, old = book.of[found[changed]], book.of[code[changed]]
        # The new entry no longer counts for its group, the old one does for its own. A root tied with the new one's stays in second.
        lower[changed, new] = second[changed, new] * (1 - SLACK)
        lower[changed, old] = np.minimum(lower[changed, old], _root(own[changed]) * (1 - SLACK))
    return found, np.nan_to_num(lower, posinf=3e38), best, done


def _whole(batch: pa.RecordBatch, name: str, width: int, kind: type) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(batch.num_rows, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def integers(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Adds v, floor(SCALE * x) of _vector, filled up with zeros to width, and drops _vector."""
    for batch in batches:
        column = batch.column("_vector")
        sizes = np.asarray(column.value_lengths()).astype(np.int64)
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        whole = np.zeros((batch.num_rows, width), np.int64)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        with np.errstate(over="ignore"):  # what passes the largest double is over LARGEST
            whole[row, np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(np.floor(SCALE * x), -LARGEST, LARGEST).astype(np.int64)
        yield batch.drop_columns("_vector").append_column("v", _lists(whole, pa.int64()))


def kept_vectors(vectors: DataFrame, keep: list[str], vector: str) -> DataFrame:
    """keep's columns and v (integers) of the rows whose vector is whole and finite, as a table."""
    infinite = F.lit(float("inf"))
    rows = vectors.select(*keep, F.col(vector).alias("_vector")).where(F.col("_vector").isNotNull() & F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)))
    longest = rows.agg(F.max(F.size("_vector"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    schema = extended(rows.drop("_vector"), "v array<bigint>")
    return saved(rows.mapInArrow(lambda batches: integers(batches, width), schema), "codes-vectors")


def _state(rows: DataFrame, books: list[Codebook] | None, keep: list[str]) -> DataFrame:
    """rows with the codes, bounds and distances under the codebooks; rows without codes yet start with the first entry."""
    parts, groups = len(books), [len(b.moved) for b in books]
    new = "code" not in rows.columns
    schema = extended(rows.select(*keep, "v"), "code array<int>, lower array<float>, error bigint")
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for large in batches:
            for at in range(0, large.num_rows, ROWS):
                batch = large.slice(at, ROWS)
                n = batch.num_rows
                width = sum(b.entries.shape[1] for b in books)
                v = _whole(batch, "v", width, np.int64).reshape(n, parts, -1)
                code = np.zeros((n, parts), np.int64) if new else _whole(batch, "code", parts, np.int64)
                lower = np.full((n, sum(groups)), -1.0) if new else _whole(batch, "lower", sum(groups), np.float64)
                found, bounds, error = [], [], 0
                for k, (a, b) in enumerate(zip(np.cumsum(groups) - groups, np.cumsum(groups), strict=True)):
                    c, low, d, _ = assign(v[:, k], books[k], code[:, k], lower[:, a:b])
                    found.append(c)
                    bounds.append(low)
                    error = error + d.astype(object)
                whole = pa.array([int(e) if e < 2**63 else None for e in error], pa.int64())
                out = batch.select([*keep, "v"]).append_column("code", _lists(np.stack(found, axis=1), pa.int32()))
                yield out.append_column("lower", _lists(np.concatenate(bounds, axis=1).astype(np.float32), pa.float32())).append_column("error", whole)

    return rows.mapInArrow(run, schema)


def _sums(state: DataFrame, entries: int, width: int) -> DataFrame:
    """cell (part * entries + entry), n, and the sums of the upper and lower 32 bits of each component: a row per cell and task."""
    size = width // PARTS
    names = [f"{h}{j}" for h in ("h", "l") for j in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS * entries, 1 + 2 * size), np.int64)
        for batch in batches:
            v = _whole(batch, "v", width, np.int64).reshape(batch.num_rows, PARTS, size)
            code = _whole(batch, "code", PARTS, np.int64)
            for k in range(PARTS):
                order = np.argsort(code[:, k], kind="stable")
                own = code[order, k]
                heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
                part = v[order, k]
                row = np.concatenate([np.ones((len(own), 1), np.int64), part >> 32, part & 0xFFFFFFFF], axis=1)
                if len(heads):
                    total[k * entries + own[heads]] += np.add.reduceat(row, heads, axis=0)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(total[used, j]) for j in range(1 + 2 * size))], ["cell", "n", *names])

    partial = state.select("v", "code").mapInArrow(run, ", ".join(["cell int", "n bigint", *(f"{x} bigint" for x in names)]))
    return partial.groupBy("cell").agg(*[F.sum(F.col(x).cast("decimal(20,0)")).alias(x) for x in ["n", *names]])


def updated(books: list[Codebook], state: DataFrame) -> list[Codebook]:
    """Every entry becomes the componentwise floor of its parts' mean; unused ones stay."""
    entries = len(books[0].entries)
    size = books[0].entries.shape[1]
    new = [b.entries.copy() for b in books]
    for r in _sums(state, entries, PARTS * size).collect():  # parts x entries rows at most
        k, e = divmod(r["cell"], entries)
        n = int(r["n"])
        new[k][e] = [((int(r[f"h{j}"]) << 32) + int(r[f"l{j}"])) // n for j in range(size)]
    return [b.updated(x) for b, x in zip(books, new, strict=True)]


def digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b.entries for x in e).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row whose vector is whole and finite.

    Null ids come last among the first ids; rows of one id, or equal rows, each count and each give a row (equal ids are
    ordered by their integers). With fewer rows than entries the codebooks are smaller; an empty table gives an empty result.
    Shorter vectors are filled up with zeros to the longest, and that to a multiple of the parts; empty vectors are all
    zeros. Integers past 2**62 count as that; an error that 64 bits can't hold is null. Other columns are not carried.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    keep = ["vec_id", "label"]
    vectors = kept_vectors(rows, keep, "embedding")
    first = [r["v"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    start = np.array(first, np.int64).reshape(len(first), PARTS, -1)
    books = [Codebook.start(start[:, k]) for k in range(PARTS)]
    state = saved(_state(vectors, books, keep), "codes-state")
    dropped(vectors)
    for _ in range(rounds):
        books = updated(books, state)
        state, before = saved(_state(state, books, keep), "codes-state"), state
        dropped(before)
    code = F.concat_ws("", F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))))
    out = state.select("vec_id", "label", code.alias("code"), "error")
    totals = out.groupBy(F.col("label").alias("_label")).agg(F.expr("try_cast(sum(cast(error AS decimal(20,0))) AS bigint)").alias("label_error"))
    # No hint: a large table of labels is shuffled, and adaptive execution splits a hot label.
    return out.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
