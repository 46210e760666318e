"""Benchmark decontamination by suffix arrays of the training texts.

Every task builds the suffix array of its shard's words and binary-searches the window that each test suffix begins with, equal ones
once: the range found is every place where the window's words stand, and runs of neighbouring matches are the longest verbatim
matches. A match is a place and a window; only a row's different windows are turned into items. Nothing is shuffled; test items travel in blocks of bounded size, one pass over the documents a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import ALNUM, LOWER, buffers, extended, packed, spread_ranges, token_blocks, unpacked, words
from cellwise.llm.windows import merged

CHUNK = 6 << 20
#: Bytes of test items sent to the tasks at once.
BLOCK = 4 << 20
#: Items found that a task holds before it gives rows on.
SENT = 1 << 18


class TestSuffixes:
    """The words of some test items, the suffixes that begin a window, and the different windows among them."""

    __test__ = False  # no pytest class

    def __init__(self, ids: list[str], texts: list[str], window: int) -> None:
        data, offsets = buffers(pa.chunked_array([pa.array(texts, pa.string())]))
        tokens, rows = words(LOWER[data], offsets, ALNUM)
        self.ids = ids
        self.vocabulary = np.unique(tokens)
        codes = np.searchsorted(self.vocabulary, tokens) + 1
        sizes = np.diff(rows)
        width = np.minimum(sizes, window)
        count = np.where(sizes > 0, sizes - width + 1, 0)
        self.start = spread_ranges(rows[:-1], count)
        self.item = np.repeat(np.arange(len(ids)), count)
        self.depth = int(window)
        #: The codes of each suffix's window, 0 beyond it; equal ones are one window.
        place = self.start[:, None] + np.arange(self.depth)
        inside = np.arange(self.depth) < np.repeat(width, count)[:, None]
        self.codes, self.window = np.unique(np.where(inside, np.append(codes, 0)[np.minimum(place, len(codes))], 0), axis=0, return_inverse=True)
        self.window = self.window.reshape(-1)
        self.width = (self.codes > 0).sum(axis=1)
        #: The items of window w, each once: of[heads[w] : heads[w + 1]].
        pairs = np.unique(self.window * max(1, len(ids)) + self.item)
        self.of = pairs % max(1, len(ids))
        self.heads = np.searchsorted(pairs // max(1, len(ids)), np.arange(len(self.codes) + 1))


def suffix_array(codes: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """Places of the known words (codes over 0), ordered by the depth words from there on; by prefix doubling.

    Beyond a row's end stands 0, which is before every word.
    """
    ends = np.repeat(rows[1:], np.diff(rows))
    rank, width = codes.astype(np.int64), 1
    while width < depth:
        after = np.zeros(len(rank), np.int64)
        at = np.flatnonzero(np.arange(len(rank)) + width < ends)
        after[at] = rank[at + width]
        key = rank * (int(rank.max(initial=0)) + 1) + after
        known = np.flatnonzero(codes > 0)
        _, inverse = np.unique(key[known], return_inverse=True)
        rank = np.zeros(len(rank), np.int64)
        rank[known] = inverse + 1
        width *= 2
    known = np.flatnonzero(codes > 0)
    return known[np.argsort(rank[known], kind="stable")]


def search(codes: np.ndarray, rows: np.ndarray, order: np.ndarray, wanted: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted row of codes the range of order whose suffixes begin with its first width words."""
    ends = np.repeat(rows[1:], np.diff(rows))
    depth = wanted.shape[1]
    step = np.arange(depth)

    def below(at: np.ndarray, which: np.ndarray, equal_too: bool) -> np.ndarray:
        place = order[at][:, None] + step
        there = np.where(place < ends[order[at]][:, None], codes[np.minimum(place, len(codes) - 1)], 0)
        there = np.where(step < width[which][:, None], there, 0)
        differs = there != wanted[which]
        first = differs.argmax(axis=1)
        line = np.arange(len(at))
        return np.where(differs.any(axis=1), there[line, first] < wanted[which][line, first], equal_too)

    out = []
    for equal_too in (False, True):
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order))
        while len(which := np.flatnonzero(lo < hi)):
            mid = (lo[which] + hi[which]) // 2
            go = below(mid, which, equal_too)
            lo[which[go]] = mid[go] + 1
            hi[which[~go]] = mid[~go]
        out.append(lo)
    return out[0], out[1]


def _matches(blocks: Iterator[tuple[np.ndarray, np.ndarray, int]], test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the rows in words, and all matches, ordered: place in the shard's words, window. Of a width a place has one at most."""
    found, rows = [np.zeros(0, np.int64)], np.zeros(1, np.int64)
    for tokens, own, base in blocks:
        rows = own + base if not base else np.array([0, base + own[-1]])
        if not len(tokens) or not len(test.start):
            continue
        at = np.minimum(np.searchsorted(test.vocabulary, tokens), len(test.vocabulary) - 1)
        codes = np.where(test.vocabulary[at] == tokens, at + 1, 0)
        order = suffix_array(codes, own, test.depth)
        lo, hi = search(codes, own, order, test.codes, test.width)
        found.append((order[spread_ranges(lo, hi - lo)] + base) * len(test.codes) + np.repeat(np.arange(len(lo)), hi - lo))
    pairs = np.unique(np.concatenate(found))  # a match in the words that two blocks share is one
    return rows, *(np.divmod(pairs, len(test.codes)) if len(pairs) else (pairs, pairs))


class Runs:
    """Classes of runs of windows that follow each other in one line, each line's places ascending."""

    def __init__(self, line: np.ndarray, place: np.ndarray, window: np.ndarray) -> None:
        self.line, self.place, self.levels = line, place, [window]

    def pairs(self, level: int, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a run of the level begins and another one begins after places on: the index, and the classes of both."""
        known = self.levels[level]
        at = np.flatnonzero(known[: max(0, len(known) - after)] >= 0)
        at = at[(self.line[at + after] == self.line[at]) & (self.place[at + after] == self.place[at] + after) & (known[at + after] >= 0)]
        return at, known[at], known[at + after]


def _both(docs: Runs, items: Runs, level: int, after: int, size: int) -> tuple[np.ndarray, ...]:
    """Where a pair of the level's runs begins: in items, with its class, and in docs, where the pair is one of items', with its class."""
    at, a, b = items.pairs(level, after)
    known, kind = np.unique(a * size + b, return_inverse=True)
    here, a, b = docs.pairs(level, after)
    spot = np.minimum(np.searchsorted(known, a * size + b), max(0, len(known) - 1))
    same = known[spot] == a * size + b if len(known) else np.zeros(len(here), bool)
    return at, kind.reshape(-1), here[same], spot[same]


def _longest(place: np.ndarray, window: np.ndarray, test: TestSuffixes, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Words of each row's longest verbatim match.

    A run of 2k windows is a pair of runs of k, so runs get classes by doubling, in the text and in the items, as long as they
    stand in both; between two powers of two the length is found by halving, as a run is two overlapping ones of the power
    below. So no place is paired with the items that have its window.
    """
    out = np.zeros(n_rows, np.int64)
    np.maximum.at(out, row, test.width[window])
    whole = test.width[window] == test.depth
    if not whole.any():
        return out
    docs = Runs(row[whole], place[whole], window[whole])
    hit = np.zeros(len(test.codes), bool)
    hit[window[whole]] = True
    own = hit[test.window]
    items = Runs(test.item[own], test.start[own], test.window[own])
    reached = np.zeros(n_rows, np.int64)  # the level that a row's longest run has
    while True:
        level = len(docs.levels) - 1
        size = int(max(docs.levels[level].max(), items.levels[level].max())) + 1
        at, kind, here, same = _both(docs, items, level, 1 << level, size)
        if not len(here):
            break
        for runs, where, value in ((items, at, kind), (docs, here, same)):
            runs.levels.append(np.full(len(runs.line), -1))
            runs.levels[-1][where] = value
        reached[docs.line[here]] = level + 1
    length = 1 << reached
    rows = np.unique(docs.line)
    for step in reversed(range(len(docs.levels) - 1)):
        for level, tried in np.unique(np.stack([reached[rows], length[rows] + (1 << step)])[:, reached[rows] > step], axis=1).T.tolist():
            asked = (reached == level) & (length + (1 << step) == tried)
            size = int(max(docs.levels[level].max(), items.levels[level].max())) + 1
            here = _both(docs, items, level, tried - (1 << level), size)[2]
            further = np.unique(docs.line[here])
            length[further[asked[further]]] = tried
    out[rows] = np.maximum(out[rows], length[rows] - 1 + test.depth)
    return out


STATE = (("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("spans", pa.list_(pa.int64())))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs: doc_id (or keep's columns), n_words, n_hit, items (ids found), longest (words), spans.

    A word is hit inside any place of window consecutive words of an item (of a shorter item, all its words). spans
    are the hit runs, start << 32 | words. Null or wordless texts have and are no match; a null item_id counts as the
    empty string; repeated items are one; repeated rows stay; an empty table on either side is fine. A text longer than CHUNK has a
    suffix array for each block of its words, which overlap; matches across them are whole.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*keep, docs["text"].alias("_text"))
    schema = extended(rows, "n_words long, n_hit long, items array<string>, longest long, spans array<long>")
    for field in schema.fields[len(rows.columns) :]:
        rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    for block in _blocks(benchmark, window):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part, blocks in token_blocks(batches, CHUNK, ALNUM, window - 1, LOWER):
                for made in _marked(part, blocks, sent.value):
                    yield from made.combine_chunks().to_batches()

        rows = rows.mapInArrow(run, schema)
    return rows.select(*keep, "n_words", "n_hit", "items", "longest", "spans")


def _blocks(benchmark: DataFrame, window: int) -> Iterator[TestSuffixes]:
    """The test items in blocks; without any item one empty block."""
    ids, texts, size, made = [], [], 0, 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).toLocalIterator():
        if texts and size + len(r[1]) > BLOCK:
            yield TestSuffixes(ids, texts, window)
            ids, texts, size, made = [], [], 0, made + 1
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
    if texts or not made:
        yield TestSuffixes(ids, texts, window)


def _marked(part: pa.Table, blocks: Iterator[tuple[np.ndarray, np.ndarray, int]], test: TestSuffixes) -> Iterator[pa.Table]:
    rows, place, window = _matches(blocks, test)
    n = len(rows) - 1
    row = np.searchsorted(rows, place, side="right") - 1
    longest = _longest(place, window, test, row, n)
    ends = np.searchsorted(row, np.arange(n + 1))
    made, first, size = {name: [] for name, _ in STATE}, 0, 0

    def told(upto: int) -> pa.Table:
        out = part.slice(first, upto - first)
        out = out.select([c for c in out.column_names if c not in made])
        for name, kind in STATE:
            out = out.append_column(name, pa.array(made[name], kind))
        return out

    for k in range(n):
        items, most, old = (part.column(c)[k].as_py() for c in ("items", "longest", "spans"))
        items, old, hits = items or [], old or [], 0
        if ends[k] < ends[k + 1] or old:
            own = slice(ends[k], ends[k + 1])
            old = np.array(old, np.int64)
            start = np.r_[place[own] - rows[k], old >> 32]
            start, end = merged(start << 32 | np.r_[test.width[window[own]], old & 0xFFFFFFFF], 1)
            old, hits = (start << 32 | (end - start)).tolist(), int((end - start).sum())
            which = np.unique(window[own])
            found = np.unique(test.of[spread_ranges(test.heads[which], test.heads[which + 1] - test.heads[which])])
            items = sorted({test.ids[i] for i in found.tolist()} | set(items))
        for name, value in zip(made, (int(rows[k + 1] - rows[k]), hits, items, max(int(longest[k]), most or 0), old), strict=True):
            made[name].append(value)
        size += len(items)
        if size > SENT:
            yield told(k + 1)
            made, first, size = {name: [] for name in made}, k + 1, 0
    if first < n or not n:
        yield told(n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the documents in which a window of an item stands."""
    return unpacked(mark(packed(docs), benchmark, window, keep=["_doc"]).where("n_hit = 0"))
