"""Phrase collocations by a generalised suffix automaton per shard.

A shard is a task's part of the texts. A state of its automaton is a set of end positions with all the phrases that end
exactly there; its suffix link leads to the state of the phrase without its first word. States are made depth by depth: the
end positions of a state are split by the word before the phrase, down to the longest candidates. Where nothing is split
off, phrase and longer phrase are one state. Substrings are then listed state by state, each with the state's number of
end positions, and added up over all shards.

Most phrases are too rare to be candidates. A count-min sketch over words and pairs of words goes first: its estimates are
never too low, so a pair that it puts below the limit can't be in a candidate, and end positions are only followed over
pairs that may be frequent. Counts are then exact, over the phrases as text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.llm.common import LOWER, PIECE, buffers, chunked, mix64, placed, saved, spread_ranges, word_pieces
from cellwise.llm.windows import Plan, Sketch, merged_sketch

LEAST, LONGEST, FIRST = 100, 5, 2000
#: Bytes that end a piece, and those that only end a word.
PIECE_END = np.zeros(256, bool)
PIECE_END[[ord(c) for c in ".,;:!?"] + [*range(0x0A, 0x0E)]] = True
IN_WORD = ~PIECE_END
IN_WORD[[0x20, 0x09]] = False
UNKNOWN = "und"
SEED = 0x6A09E667F3BCC909
#: Bytes of text in a shard.
SHARD = 1 << 23


@dataclass
class Words:
    """The words of a shard: their text joined by single spaces with the places in it, hashes (with the language), and which begin a piece."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    key: np.ndarray
    head: np.ndarray
    row: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> Words:
    """langs: a hash of each row's language."""
    data = LOWER[data]
    inside = IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(data[:0], none, none, none.astype(np.uint64), none.astype(bool), none)
    row = np.searchsorted(offsets, starts, side="right") - 1
    kept = data[inside]
    at = np.cumsum(inside, dtype=np.int64)[starts] - 1
    sizes = np.diff(np.append(at, len(kept)))
    place = np.arange(len(kept)) - np.repeat(at, sizes)
    key = mix64(np.add.reduceat(placed(kept, place, SEED)[0], at) + sizes.astype(np.uint64))
    key = mix64(key ^ langs[row])
    ended = np.cumsum(PIECE_END[data], dtype=np.int32)[starts]
    head = np.ones(len(starts), bool)
    head[1:] = (ended[1:] != ended[:-1]) | (row[1:] != row[:-1])
    begins = at + np.arange(len(at))
    text = np.full(len(kept) + len(at), 0x20, np.uint8)
    text[np.arange(len(kept)) + np.repeat(np.arange(len(at)), sizes)] = kept
    return Words(text, begins, begins + sizes, key, head, row)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Words]]:
    """Parts of rows (_lang, _hash, _text) with their words; a text longer than a part comes in several, cut between pieces."""
    for part in chunked(batches, SHARD):
        data, offsets = buffers(part.column("_text"))
        langs = part.column("_hash").to_numpy().view(np.uint64)
        if len(data) <= SHARD:
            yield part, words_of(data, offsets, langs)
            continue
        held: list[np.ndarray] = []
        for piece in word_pieces(data, ~PIECE_END):
            held.append(piece)
            if sum(map(len, held)) > SHARD - PIECE:
                yield part, words_of(np.concatenate(held), np.array([0, sum(map(len, held))]), langs)
                held = []
        if held:
            yield part, words_of(np.concatenate(held), np.array([0, sum(map(len, held))]), langs)


def pair_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where the second word of a pair stands, and the pair's hash."""
    at = np.flatnonzero(~w.head)
    return at, mix64(w.key[at - 1] * np.uint64(0x9E3779B97F4A7C15) + w.key[at])


@dataclass
class States:
    """Phrases of one length: an end position of each, how many it has, and the phrase without its first word (the suffix link)."""

    end: np.ndarray
    count: np.ndarray
    link: np.ndarray


def automaton(w: Words, word_may: np.ndarray, pair_may: np.ndarray, longest: int) -> list[States]:
    """The states by phrase length, from one word on. word_may, pair_may: for each word, whether it, and it with the one before, may be frequent.

    The states of a length are those of the length before, split by the word before the phrase; a phrase with as many end
    positions as its suffix link is in one state with it.
    """
    ends = np.flatnonzero(word_may)
    _, which = np.unique(w.key, return_inverse=True)
    which = which.astype(np.int64)
    many = int(which.max()) + 1 if len(which) else 0
    of, link = which[ends], np.zeros(0, np.int64)
    out = []
    for length in range(1, longest + 1):
        ids, first, of, count = np.unique(of, return_index=True, return_inverse=True, return_counts=True)
        # An id is (state of the length before) * many + the word before.
        link = np.full(len(ids), -1) if length == 1 else ids // many
        out.append(States(ends[first], count, link))
        # A longer phrase goes one further back over a pair that may be frequent, inside the piece.
        at = ends - length + 1
        go = pair_may[at]
        ends, of = ends[go], of[go] * many + which[at[go] - 1]
        if not len(ends):
            break
    return out


def local_counts(rows: DataFrame, sketch: Sketch, longest: int, buckets: int) -> DataFrame:
    """Every shard's phrases that may be frequent, by bucket (of a hash of the phrase), lang and number of words: phrases, one a line,
    and their counts, eight bytes each. words 0 has the number of all words, with an empty phrase.
    """
    sent = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in shards(batches):
            if not len(w.key):
                continue
            lang = part.column("_lang").combine_chunks().dictionary_encode()
            names, code = lang.dictionary, lang.indices.to_numpy()
            word_may = sent.value.repeated(w.key)[1] > 0
            at, pairs = pair_keys(w)
            pair_may = np.zeros(len(w.key), bool)
            pair_may[at] = sent.value.repeated(pairs)[1] > 0
            many = np.bincount(code[w.row], minlength=len(names))
            some = np.flatnonzero(many)
            yield batch(np.zeros(len(some), np.int64), names.take(pa.array(some)), 0, [""] * len(some), [many[k : k + 1] for k in some])
            key = np.zeros(0, np.uint64)
            for words, s in enumerate(automaton(w, word_may, pair_may, longest), 1):
                first = w.key[s.end - words + 1]
                key = first if words == 1 else mix64(key[s.link] * np.uint64(0x9E3779B97F4A7C15) + first)
                own, bucket = code[w.row[s.end]], (key % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((own, bucket))
                own, bucket, end, count = own[order], bucket[order], s.end[order], s.count[order].astype(np.int64)
                sizes = w.ends[end] - w.starts[end - words + 1] + 1
                text = w.text[spread_ranges(w.starts[end - words + 1], sizes)]
                ends = np.cumsum(sizes)
                text[ends - 1] = 0x0A
                heads = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])])
                cuts = [*heads.tolist(), len(own)]
                lines = [text[ends[a] - sizes[a] : ends[b - 1] - 1].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield batch(bucket[heads], names.take(pa.array(own[heads])), words, lines, [count[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def batch(bucket: np.ndarray, lang: pa.Array, words: int, phrases: list[str], n: list[np.ndarray]) -> pa.RecordBatch:
        counts = pa.array([x.tobytes() for x in n], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), lang, pa.array(np.full(len(n), words, np.int32)), pa.array(phrases, pa.string()), counts], ["bucket", "lang", "words", "phrases", "counts"])

    return rows.mapInArrow(run, "bucket int, lang string, words int, phrases string, counts binary")


def added(local: DataFrame, least: int, held: int = 1 << 20) -> DataFrame:
    """lang, words, phrase and n of local_counts, added up over all shards: those of least or more. Each bucket is one task's."""

    def total(tables: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(tables).group_by(["lang", "words", "phrase"]).aggregate([("n", "sum")])
        return whole.select(["lang", "words", "phrase", "n_sum"]).rename_columns(["lang", "words", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, size, known = [], 0, 0
        for b in batches:
            lists = pc.split_pattern(b.column("phrases"), "\n")
            row = pa.array(np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths())))
            n = np.frombuffer(b"".join(b.column("counts").to_pylist()), np.int64)
            tables.append(pa.table([b.column("lang").take(row), b.column("words").take(row), lists.flatten(), pa.array(n)], ["lang", "words", "phrase", "n"]))
            size += len(n)
            if size > known + held:
                tables = [total(tables)]
                known = size = tables[0].num_rows
        if tables:
            found = total(tables)
            keep = pc.or_(pc.greater_equal(found["n"], least), pc.equal(found["words"], 0))
            yield from found.filter(keep).combine_chunks().to_batches(1 << 14)

    return local.repartition("bucket").mapInArrow(run, "lang string, words int, phrase string, n bigint")


def frequent_sketch(rows: DataFrame, least: int, most_bits: int = 28) -> Sketch:
    """Which words and pairs may occur least times. Four counts a cell, up to 2**most_bits cells a row; a cell of least or more is listed."""
    tokens = rows.agg(F.sum(F.length("_text"))).first()[0] or 0  # no more pairs and words than characters
    bits = min(most_bits, max(16, math.ceil(math.log2(max(1, tokens / 8)))))

    def make(found: tuple[pa.Table, Words]) -> np.ndarray:
        return np.concatenate([found[1].key, pair_keys(found[1])[1]])

    return merged_sketch(rows, make, Plan(1, 1, bits, 1), shards, levels=(least,))


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, words, phrase and n: the exact count of every phrase of 1 to longest words that occurs least times, and of all words (words 0)."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    rows = docs.select(lang.alias("_lang"), F.xxhash64(lang).alias("_hash"), F.col("text").alias("_text"))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(added(local_counts(rows, frequent_sketch(rows, least), longest, buckets), least), "phrases")


def _cut(phrase: Column, of: Column, k: Column) -> tuple[Column, Column]:
    """The first k words of a phrase of so many, and the rest."""
    return F.call_function("substring_index", phrase, F.lit(" "), k), F.call_function("substring_index", phrase, F.lit(" "), k - of)


def maximal(candidates: DataFrame) -> DataFrame:
    """candidates without those that stand inside a longer one with as many occurrences.

    A phrase inside a longer one of the same count is also inside every phrase between them, with that count: so only the
    suffix link and the prefix link of each candidate (without its first, without its last word) are looked at.
    """
    phrase, words = F.col("phrase"), F.col("words")
    inner = F.explode(F.array(_cut(phrase, words, F.lit(1))[1], _cut(phrase, words, words - 1)[0]))
    longer = candidates.where("words > 2").select("lang", inner.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    return candidates.join(longer, ["lang", "phrase"], "left").where("_longer IS NULL OR _longer < n").drop("_longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """Each language's first collocations: lang, rank, phrase, a, l, r, n, score.

    A null lang is und, as is a lang of that name; null, empty and blank texts have no words, and a table without candidates
    gives no rows; repeated rows count each; ties of score and count go by the phrase's bytes; other columns are not read. Texts longer
    than a shard are taken in parts cut between pieces (a piece without any of .,;:!? or a line end is never cut).
    """
    counts = phrase_counts(docs, least, longest)
    total = counts.where("words = 0").select("lang", F.col("n").alias("all"))
    known = counts.where("words > 0").select("lang", "phrase", "n")
    candidates = maximal(counts.where("words > 1").select("lang", "words", "phrase", F.col("n")))
    cuts = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    head, rest = _cut(F.col("phrase"), F.col("words"), F.col("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", head.alias("_head"), rest.alias("_rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_head"), F.col("n").alias("l")), ["lang", "_head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_rest"), F.col("n").alias("r")), ["lang", "_rest"])
    cuts = cuts.join(total, "lang")
    wide = "CAST({} AS decimal(16,0))"
    score = F.expr(f"CAST(1000 AS decimal(4,0)) * ({wide.format('a')} * {wide.format('`all`')}) DIV ({wide.format('l')} * {wide.format('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", F.col("all").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
