"""Exact substring deduplication over words, with a count-min prefilter.

First pass: every partition sketches the counts of its windows' anchors; the merged sketch overestimates how often a
window occurs. Second pass: only windows estimated to repeat are hashed (96 bits) and grouped exactly; a window is
removed where a document with a smaller id has it. What a task sees for itself (a copy beside its original) is
settled there, so a window of which half the corpus has a copy reaches the shuffle once per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.llm.common import SPACE, buffers, chunked, ints, joined_by_key, mix64, order_id, rolling, row_groups, saved, spread_ranges, text_key, token_blocks, word_pieces
from cellwise.llm.windows import Plan, anchor_runs, broadcast, covered, in_round, merged, merged_sketch, runs

GRAM = 8
CHUNK = 12 << 20


def _grams(block: tuple, plan: Plan, turn: int) -> np.ndarray:
    _, tokens, rows, _ = block
    grams = rolling(tokens, plan.gram, 0xD1342543DE82EF95)
    found = grams[anchor_runs(grams, rows, plan)[3]]
    return found[in_round(found, plan, turn)]


def _blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, int]]:
    """Rows of _text, their words, offsets and words before the block; long texts in blocks that share window - 1 words."""
    return ((part, *block) for part, blocks in token_blocks(batches, CHUNK, SPACE, window - 1) for block in blocks)


def _windows(block: tuple, plan: Plan, turn: int, sketch) -> pa.RecordBatch:
    """Windows that may repeat: of those equal in this block only the smallest document's stay, the others are settled."""
    part, tokens, rows, base = block
    grams = rolling(tokens, plan.gram, 0xD1342543DE82EF95)
    heads, sizes, _, at = anchor_runs(grams, rows, plan)
    may = in_round(grams[at], plan, turn)
    may[may] = sketch.repeated(grams[at[may]])[0]
    starts = spread_ranges(heads[may], sizes[may])
    ids, keys = ints(part.column("_id")), ints(part.column("_key"))
    one = rolling(tokens, plan.window, 0x9E3779B97F4A7C15)[starts]
    two = rolling(mix64(tokens + np.uint64(1)), plan.window, 0xC2B2AE3D27D4EB4F)[starts] & np.uint64(0xFFFFFFFF00000000)
    row = np.searchsorted(rows, starts, side="right") - 1
    order = np.lexsort((ids[row], two, one))
    one, two, starts, row = one[order], two[order], starts[order], row[order]
    heads = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(heads, np.arange(len(one)), 0))
    settled = ids[row] > ids[row[first]] if len(one) else heads
    s = np.sort(starts[settled])
    of = np.searchsorted(rows, s, side="right") - 1
    head, size = runs(s, of)
    s, of = s[head], of[head]
    open_ = ~settled
    columns = [
        np.r_[one[open_].view(np.int64), mix64((s + base).view(np.uint64) ^ keys[of].view(np.uint64)).view(np.int64)],
        np.r_[two[open_].view(np.int64), size],
        np.r_[ids[row[open_]], ids[of]],
        np.r_[keys[row[open_]], keys[of]],
        np.r_[starts[open_] - rows[row[open_]], s - rows[of]] + base,
    ]
    kinds = [np.int64, np.int64, np.int64, np.int64, np.int32]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], ["one", "two", "id", "key", "place"])


def repeated_spans(rows: DataFrame, window: int) -> DataFrame:
    """_id, _key and spans (start and number of windows, in one long) of the windows to remove, for rows of _id, _key, _text."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    plan = Plan.of(size // 6, window, min(GRAM, window))
    parts = partial(_blocks, window=window)
    found = None
    for turn in range(plan.rounds):
        sketch = broadcast(spark, merged_sketch(rows, partial(_grams, plan=plan, turn=turn), plan, parts))

        def emit(batches: Iterator[pa.RecordBatch], turn: int = turn, sketch=sketch) -> Iterator[pa.RecordBatch]:
            for block in parts(batches):
                yield _windows(block, plan, turn, sketch.value)

        some = rows.mapInArrow(emit, "one long, two long, id long, key long, place int")
        found = some if found is None else found.unionByName(some)
    least = F.min("id").over(Window.partitionBy("one", "two"))
    runs_ = F.col("two").bitwiseAND(0xFFFFFFFF)  # of a settled run its length; 0 for a single window
    removed = found.withColumn("least", least).where((runs_ > 0) | (F.col("id") > F.col("least")))
    span = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.greatest(runs_, F.lit(1)))
    return removed.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list(span).alias("spans"))


def _word_places(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last byte of each word, and the rows' offsets in words."""
    inside = SPACE[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    at = rows[:-1][rows[:-1] < len(data)]
    head[at] = inside[at]
    at = rows[1:][rows[1:] > 0] - 1
    tail[at] = inside[at]
    heads = np.flatnonzero(head)
    return heads, np.flatnonzero(tail) + 1, np.searchsorted(heads, rows)


def _without(data: np.ndarray, rows: np.ndarray, heads: np.ndarray, tails: np.ndarray, first: np.ndarray, gone: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words that are not gone, a space between those of a row, and the rows' offsets in that."""
    kept = np.flatnonzero(~gone)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[heads[kept]] += 1
    edge[tails[kept]] -= 1
    stays = np.cumsum(edge[:-1], dtype=np.int8) > 0
    row = np.searchsorted(first, kept, side="right") - 1
    between = tails[kept[:-1][row[1:] == row[:-1]]]
    stays[between] = True
    out = data.copy()
    out[between] = 0x20
    return out[stays].tobytes(), np.r_[0, np.cumsum(stays)][rows]


def _kept(part: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Words of each row, how many of them go, the texts that are left, and the rows' offsets in these."""
    data, offsets = buffers(part.column("_text"))
    lists = pa.concat_arrays(part.column("spans").chunks)
    many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    span, ends = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(many)]
    total, lost, texts, sizes = [], [], [], []
    for a, b in row_groups(offsets):
        own, rows, spans = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], span[ends[a] : ends[b]]
        if b > a + 1:
            heads, tails, first = _word_places(own, rows)
            start = (spans >> 32) + first[np.repeat(np.arange(b - a), many[a:b])]
            gone = covered(len(heads), start, (spans & 0xFFFFFFFF) + window - 1)
            text, to = _without(own, rows, heads, tails, first, gone)
            total.append(np.diff(first))
            lost.append(np.diff(np.r_[0, np.cumsum(gone)][first]))
            texts.append(text)
            sizes.append(np.diff(to))
            continue
        starts, stops = merged(spans, window) if len(spans) else (spans, spans)
        n, out, left = 0, 0, []
        for piece in word_pieces(own, SPACE):
            ends_ = np.array([0, len(piece)])
            heads, tails, first = _word_places(piece, ends_)
            here = slice(np.searchsorted(stops, n, side="right"), np.searchsorted(starts, n + len(heads)))
            start = np.maximum(starts[here] - n, 0)
            gone = covered(len(heads), start, stops[here] - n - start)
            left.append(_without(piece, ends_, heads, tails, first, gone)[0])
            n, out = n + len(heads), out + int(gone.sum())
        total.append(np.array([n]))
        lost.append(np.array([out]))
        texts.append(b" ".join(filter(None, left)))
        sizes.append(np.array([len(texts[-1])]))
    return np.concatenate(total), np.concatenate(lost), b"".join(texts), np.r_[0, np.cumsum(np.concatenate(sizes))]


def deduplicate(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by a space) of every row.

    A word goes if a window over it also starts in a document with a smaller doc_id; windows are judged on the
    input. Null text has no words; texts shorter than the window keep all; null doc_ids come after all others and
    equal doc_ids take nothing from each other (so repeated rows stay alike); an empty table gives an empty result;
    other columns are not carried. A text longer than CHUNK goes in blocks, at some two times its bytes of memory.
    """
    rows = docs.select("doc_id", order_id().alias("_id"), text_key().alias("_key"), F.coalesce("text", F.lit("")).alias("_text"))
    spans = saved(repeated_spans(rows.select("_id", "_key", "_text"), window), "spans")
    joined = joined_by_key(rows, spans, ["_id", "_key"]).select("doc_id", "_text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, CHUNK):
            total, gone, text, ends = _kept(part, window)
            kept = pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), kept], ["doc_id", "n_words", "n_removed", "kept_text"])

    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return joined.mapInArrow(remove, schema)
