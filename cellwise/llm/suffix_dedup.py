"""Exact substring deduplication over bytes by a depth-limited radix sort of suffixes.

Suffixes are told apart only through the threshold's bytes, by most-significant-digit passes: what is left in one
group after the last digit are exactly the repeated windows. The first pass, over the whole corpus, puts suffixes in
buckets by their anchor (see windows) and a count-min sketch drops those alone in theirs; neighbouring suffixes of
one bucket travel together with the bytes they need. Then Spark deals the buckets out, a task drops suffixes whose
whole surroundings are equal to a smaller document's, and sorts the rest by eight bytes a pass, leaving out at
each pass what has become unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import buffers, chunked, ints, joined_by_key, mix64, order_id, placed, rolling, saved, spread_ranges, text_key
from cellwise.llm.windows import Plan, anchor_runs, broadcast, in_round, merged, merged_sketch, runs

GRAM = 18
BASE = 0xD1342543DE82EF95
CHUNK, BLOCK = 6 << 20, 1 << 19
#: A bucket estimated to hold more anchors (some 50 MB of text), or more than a SHARE-th of all and LEAST_HOT, is dealt out window by
#: window instead of whole.
HOT, SHARE, LEAST_HOT = 400_000, 5_000, 10_000


def _blocks(data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BLOCK bytes: arrays of that size stay in the processor's cache."""
    at = 0
    while at < len(rows) - 1:
        to = max(at + 1, int(np.searchsorted(rows, rows[at] + BLOCK, side="right")) - 1)
        yield at, to
        at = to


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.Table]:
    """Parts of rows with _at 0; a text of over CHUNK bytes in pieces that share window - 1 bytes, _at their places in it."""
    for part in chunked(batches, CHUNK):
        text = part.column("_text")
        size = pc.sum(pc.binary_length(text)).as_py() or 0
        if part.num_rows > 1 or size <= CHUNK:
            yield part.append_column("_at", pa.array(np.zeros(part.num_rows, np.int64)))
            continue
        data, _ = buffers(text)
        for at in range(0, max(1, len(data) - window + 1), CHUNK):
            own = pa.array([data[at : at + CHUNK + window - 1].tobytes()], pa.binary())
            yield part.set_column(part.column_names.index("_text"), "_text", own).append_column("_at", pa.array([at], pa.int64()))


def _found(part: pa.Table, plan: Plan, turn: int, sketch=None):
    """Runs of windows by anchor: start, count, row, gram and level; with a sketch, only those that may repeat."""
    data, rows = buffers(part.column("_text"))
    out = []
    for a, b in _blocks(data, rows):
        own = rows[a : b + 1] - rows[a]
        grams = rolling(data[rows[a] : rows[b]].astype(np.uint64) + np.uint64(1), plan.gram, BASE)
        start, count, row, at = anchor_runs(grams, own, plan)
        gram = grams[at]
        may = in_round(gram, plan, turn)
        level = np.zeros(len(gram), np.int64)
        if sketch is not None:
            own = np.flatnonzero(may)
            may[own], level[own] = sketch.repeated(gram[own])
        out.append((start[may] + rows[a], count[may], row[may] + a, gram[may], level[may]))
    return data, rows, [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


def _grams(part: pa.Table, plan: Plan, turn: int) -> np.ndarray:
    return _found(part, plan, turn)[2][3].astype(np.uint64)


def _slices(n: int) -> Iterator[slice]:
    """Runs by the ten thousand: index arrays of all their bytes at once would take many times the text's memory."""
    return (slice(at, at + 10_000) for at in range(0, n, 10_000))


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of data one after the other."""
    return np.concatenate([data[spread_ranges(starts[k], sizes[k])] for k in _slices(len(starts))] or [data[:0]])


def _hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each piece of data."""
    out = [np.zeros(len(starts), np.uint64) for _ in range(2)]
    for k in _slices(len(starts)):
        own = sizes[k]
        heads = np.cumsum(own) - own
        value = data[spread_ranges(starts[k], own)]
        place = np.arange(len(value)) - np.repeat(heads, own)
        for o, values in zip(out, placed(value, place, BASE, 0x9E3779B97F4A7C15), strict=True):
            o[k] = mix64(np.add.reduceat(values, heads) ^ own.astype(np.uint64))
    return out[0], out[1]


def _smallest(ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that groups equal keys, smallest id first; the group of each place in it; whether its id is the group's smallest."""
    order = np.lexsort((ids, *keys))
    heads = np.zeros(len(order), bool)
    for key in keys:
        k = key[order]
        heads[1:] |= k[1:] != k[:-1]
    heads[:1] = True
    first = np.maximum.accumulate(np.where(heads, np.arange(len(order)), 0))
    least = ids[order] == ids[order[first]] if len(order) else heads
    return order, np.cumsum(heads) - 1, least


SCHEMA = "route int, id long, key long, place int, n int, bytes binary"


def _route(keys: np.ndarray) -> np.ndarray:
    """32 bits: buckets that share a route are told apart by their bytes."""
    return (mix64(keys.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _batch(route, ids, keys, place, n, data, offsets) -> pa.RecordBatch:
    """bytes is null for settled runs, which have no offsets."""
    settled = len(route) - (len(offsets) - 1)
    offsets = np.r_[offsets, np.full(settled, offsets[-1])].astype(np.int32)
    valid = pa.array(np.arange(len(route)) < len(route) - settled).buffers()[1]
    binary = pa.Array.from_buffers(pa.binary(), len(route), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(route, pa.int32()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(place, pa.int32()), pa.array(n, pa.int32()), binary], ["route", "id", "key", "place", "n", "bytes"])


def _emit(part: pa.Table, plan: Plan, turn: int, sketch) -> Iterator[pa.RecordBatch]:
    """Runs that may repeat, with their bytes; those equal to a smaller document's of this part are settled here."""
    data, rows, (start, count, row, gram, level) = _found(part, plan, turn, sketch)
    hot = level > 0
    if hot.any():
        single = spread_ranges(start[hot], count[hot])
        of = np.repeat(row[hot], count[hot])
        start, row = np.r_[start[~hot], single], np.r_[row[~hot], of]
        gram = np.r_[gram[~hot], _hashes(data, single, np.full(len(single), plan.window))[0]]
        count = np.r_[count[~hot], np.ones(len(single), np.int64)]
    ids, keys, base = ints(part.column("_id")), ints(part.column("_key")), ints(part.column("_at"))
    sizes = count + plan.window - 1
    order, _, least = _smallest(ids[row], *_hashes(data, start, sizes), gram)
    gone = np.sort(order[~least])
    gone = gone[np.argsort(start[gone], kind="stable")]
    starts = spread_ranges(start[gone], count[gone])
    of = np.repeat(row[gone], count[gone])
    head, n = runs(starts, of)
    starts, of = starts[head], of[head]
    kept = np.sort(order[least])
    kept_sizes = sizes[kept]
    yield _batch(
        np.r_[_route(gram[kept]), _route((starts + base[of]).view(np.uint64) ^ keys[of].view(np.uint64))],
        np.r_[ids[row[kept]], ids[of]],
        np.r_[keys[row[kept]], keys[of]],
        np.r_[start[kept] - rows[row[kept]] + base[row[kept]], starts - rows[of] + base[of]],
        np.r_[count[kept], n],
        _gather(data, start[kept], kept_sizes),
        np.r_[0, np.cumsum(kept_sizes)],
    )


def radix_groups(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (indices into starts) equal to another of their bucket through depth bytes, and the groups of equal ones.

    Passes from the most significant digit of eight bytes on; each keeps only groups of two or more.
    """
    padded = np.r_[data, np.zeros(16, np.uint8)].astype(np.uint64)
    digits = np.zeros(len(data) + 8, np.uint64)
    for k in range(8):
        digits |= padded[k : k + len(digits)] << np.uint64(56 - 8 * k)
    live, group = np.arange(len(starts)), bucket
    for at in range(0, depth, 8):
        digit = digits[starts[live] + at]
        if at + 8 > depth:
            digit = digit >> np.uint64(8 * (at + 8 - depth))
        order = np.lexsort((digit, group))
        live, digit, group = live[order], digit[order], group[order]
        heads = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])] if len(live) else np.zeros(0, bool)
        group = np.cumsum(heads) - 1
        more = np.bincount(group)[group] > 1 if len(live) else heads
        live, group = live[more], group[more]
    return live, group


def _sort_buckets(part: pa.Table, window: int) -> pa.RecordBatch:
    """Whole buckets: the runs of windows to remove."""
    settled = np.concatenate([c.is_null().to_numpy(zero_copy_only=False) for c in part.column("bytes").chunks])
    columns = [ints(part.column(c)) for c in ("route", "id", "key", "place", "n")]
    out = [[c[settled].astype(np.int64)] for c in columns[1:]]
    route, ids, keys, place, n = (c[~settled].astype(np.int64) for c in columns)
    data, offsets = buffers(part.column("bytes"))
    starts = offsets[:-1][~settled]
    order, group, least = _smallest(ids, *_hashes(data, starts, n + window - 1), route)
    lost = order[~least]
    for o, c in zip(out, (ids, keys, place, n), strict=True):
        o.append(c[lost])
    if len(order):
        # One of each kind of surroundings goes on, where its bucket has two kinds or more.
        first = np.r_[True, group[1:] != group[:-1]]
        one = order[first]
        kinds = np.r_[True, route[one][1:] != route[one][:-1]]
        bucket = np.cumsum(kinds) - 1
        many = np.bincount(bucket)[bucket] > 1
        kind, one, bucket = np.flatnonzero(many), one[many], bucket[many]
        suffix = spread_ranges(starts[one], n[one])
        owner = np.repeat(np.arange(len(one)), n[one])
        live, equal = radix_groups(data, suffix, bucket[owner], window)
        if len(live):
            by, _, low = _smallest(ids[one[owner[live]]], equal)
            hit = live[by[~low]]
            lost = np.zeros(len(suffix), bool)
            lost[hit] = True
            at = np.flatnonzero(lost)
            head, size = runs(suffix[at], owner[at])
            at, size = at[head], size
            # What is lost is lost at every place where the smallest document has these surroundings.
            rest = order[least]
            rest_kind = group[least]
            a = np.searchsorted(rest_kind, kind[owner[at]], side="left")
            b = np.searchsorted(rest_kind, kind[owner[at]], side="right")
            rows = rest[spread_ranges(a, b - a)]
            shift = np.repeat(suffix[at] - starts[one[owner[at]]], b - a)
            for o, c in zip(out, (ids[rows], keys[rows], place[rows] + shift, np.repeat(size, b - a)), strict=True):
                o.append(c)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["id", "key", "place", "n"])


def _whole_buckets(batches: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[pa.Table]:
    """Batches sorted by route, joined and cut where the route changes: what is held is looked at once, when it ends."""
    held: list[pa.RecordBatch] = []
    size, top = 0, None
    for batch in batches:
        route = batch.column("route")
        while batch.num_rows:
            if size >= rows and route[0].as_py() != top:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            take = batch.num_rows
            if size + take >= rows:  # up to where the route changes after rows rows
                own = route.to_numpy(zero_copy_only=False)
                value = own[max(0, rows - size - 1)] if size < rows else top
                take = int(np.searchsorted(own, value, side="right"))
            held.append(batch.slice(0, take))
            size += take
            top = route[take - 1].as_py()
            batch = batch.slice(take)
            route = batch.column("route")
    if held:
        yield pa.Table.from_batches(held)


def repeated_spans(rows: DataFrame, window: int) -> DataFrame:
    """_id, _key and spans (start and number of windows, in one long) of the windows to remove, for rows of _id, _key, _text."""
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    plan = Plan.of(size, window, min(GRAM, window))
    parts = partial(_pieces, window=window)
    hot = min(HOT, max(LEAST_HOT, size // plan.window // SHARE))
    found = None
    for turn in range(plan.rounds):
        sketch = broadcast(rows.sparkSession, merged_sketch(rows, partial(_grams, plan=plan, turn=turn), plan, parts, (hot,)))

        def emit(batches: Iterator[pa.RecordBatch], turn: int = turn, sketch=sketch) -> Iterator[pa.RecordBatch]:
            for part in parts(batches):
                yield from _emit(part, plan, turn, sketch.value)

        some = rows.mapInArrow(emit, SCHEMA)
        found = some if found is None else found.unionByName(some)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_buckets(batches):
            yield _sort_buckets(part, window)

    gone = found.repartition("route").sortWithinPartitions("route").mapInArrow(sort, "id long, key long, place long, n long")
    span = F.shiftleft("place", 32).bitwiseOR(F.col("n"))
    return gone.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list(span).alias("spans"))


def deduplicate(docs: DataFrame, window: int = 50, keep: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """doc_id (or keep's columns), n_bytes, n_removed, n_spans and kept (binary) of every row.

    A byte of the UTF-8 text goes if a string of window bytes over it also starts in a document with a smaller
    doc_id; strings are judged on the input. Null text is empty; texts shorter than the window keep all; null doc_ids
    come after all others, equal doc_ids take nothing from each other (repeated rows stay alike); an empty table gives
    an empty result; columns outside keep are not carried. kept may begin or end inside a character; with whole_characters a
    character stays unless all its bytes go. A text longer than CHUNK goes in pieces, at some four times its bytes of memory.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*keep, order_id().alias("_id"), text_key().alias("_key"), F.coalesce("text", F.lit("")).alias("_text"))
    spans = saved(repeated_spans(rows.select("_id", "_key", "_text"), window), "spans")
    joined = joined_by_key(rows, spans, ["_id", "_key"]).select(*keep, "_text", "spans")
    extra = (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, 1 << 23):
            data, offsets = buffers(part.column("_text"))
            total, gone, count, kept = [], [], [], []
            lists = pa.concat_arrays(part.column("spans").chunks)
            many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            every, to = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(many)]
            for k in range(part.num_rows):
                spans = every[to[k] : to[k + 1]]
                own = data[offsets[k] : offsets[k + 1]]
                total.append(len(own))
                n = 0
                if len(spans):
                    starts, ends = merged(spans, window)
                    if whole_characters:  # a span gives up the bytes of characters that begin before it or end after it
                        inner = np.append((own & 0xC0) == 0x80, False)
                        while len(at := np.flatnonzero(inner[starts])):
                            starts[at] += 1
                        while len(at := np.flatnonzero(inner[ends])):
                            ends[at] -= 1
                        starts, ends = starts[starts < ends], ends[starts < ends]
                    n = len(starts)
                    own = np.concatenate([own[a:b] for a, b in zip(np.r_[0, ends].tolist(), np.r_[starts, len(own)].tolist(), strict=True)])
                count.append(n)
                gone.append(total[-1] - len(own))
                kept.append(own.tobytes())
            out = part.select(keep)
            for (name, kind), column in zip(extra, (total, gone, count, kept), strict=True):
                out = out.append_column(name, pa.array(column, kind))
            yield from out.combine_chunks().to_batches()

    schema = rows.select(*keep).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return joined.mapInArrow(remove, schema)
