"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A language's profile is the list of its most frequent character n-grams of one to three letters, word ends included; a
document's profile is made alike, from its whole text. The prediction is the language whose profile is least out of
place: the sum, over the document's n-grams, of how far their ranks are apart, and the profile's length for one that it lacks.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.llm.common import chunked, mix64, packed, unpacked

#: N-grams of a profile.
RANKS = 300
#: About so many labelled documents of each language are learned from, chosen by a hash of their id.
TRAIN_DOCS = 4000
GRAM_BITS, COUNT_BITS, ROW_BITS = 33, 17, 14
UNKNOWN = "und"
#: Characters of a long text counted at once, and those it is cut before: no letters, and none that lower-casing looks at.
LONG, CUT = 1 << 20, re.compile(r"[\s0-9,;!?。,、]")
#: Texts of lower scores fit no learned language: of the test tables' labelled documents none is under 0.37, while letters at random are
#: under 0.25 from some fifty words on, and texts in other scripts have 0.
LEAST_SCORE = 0.25


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _gram_counts(texts: list[str]) -> np.ndarray:
    """row << GRAM_BITS | n-gram of all n-grams of the texts, sorted, and the count of each; at most 2**ROW_BITS texts."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower)))
    row = np.r_[0, row]
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes, row = np.where(letter, codes, 0)[keep].astype(np.uint64), row[keep].astype(np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, max(1, len(codes)), 1 << 20):
        n = min(1 << 20, len(codes) - at)
        c, r = codes[at : at + n + 2], row[at : at + n + 2]
        one = c[:n] > 0
        two, three = c[:n][: len(c) - 1] << np.uint64(21) | c[1 : n + 1], c[:n][: len(c) - 2] << np.uint64(42) | c[1 : n + 1][: len(c) - 2] << np.uint64(21) | c[2 : n + 2]
        own = np.where(c[:n] > 0, r[:n], np.r_[r[1 : n + 1], r[-1:]][:n])  # a gram that begins with a word's front belongs to that word's row
        keys = [(own[one], c[:n][one] | np.uint64(1 << 63))]
        both = (c[: len(two)] | c[1 : len(two) + 1]) > 0
        keys.append((own[: len(two)][both], two[both] | np.uint64(1 << 62)))
        inner = c[1 : len(three) + 1] > 0
        keys.append((own[: len(three)][inner], three[inner]))
        key = np.sort(np.concatenate([r << np.uint64(GRAM_BITS) | mix64(g) >> np.uint64(64 - GRAM_BITS) for r, g in keys]))
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        found.append((key[heads], np.diff(np.r_[heads, len(key)])))
    if len(found) == 1:
        return found[0]
    key, count = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[heads], np.add.reduceat(count, heads) if len(heads) else count


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """_gram_counts of texts that may be long: those go by pieces of about LONG characters, cut where no n-gram goes across."""
    if sum(map(len, texts)) <= 2 * LONG or len(texts) > 1:
        return _gram_counts(texts)
    key, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text, at = texts[0], 0
    while at < len(text):
        cut = CUT.search(text, at + LONG)
        to = cut.start() if cut else len(text)
        more, n = _gram_counts([text[at:to]])
        key, count, at = np.concatenate([key, more]), np.concatenate([count, n]), to
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        key, count = key[heads], np.add.reduceat(count, heads) if len(heads) else count
    return key, count


def _ranked(key: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and rank of each row's most frequent n-grams; ties by the n-gram's hash."""
    top = np.uint64((1 << COUNT_BITS) - 1)
    row, gram = key >> np.uint64(GRAM_BITS), key & np.uint64((1 << GRAM_BITS) - 1)
    if len(count) and count.max() > int(top):  # does not fit 64 bits
        order = np.lexsort((gram, -count.astype(np.int64), row))
        row, gram = row[order].astype(np.int64), gram[order]
    else:
        both = np.sort(row << np.uint64(GRAM_BITS + COUNT_BITS) | (top - count.astype(np.uint64)) << np.uint64(GRAM_BITS) | gram)
        row, gram = (both >> np.uint64(GRAM_BITS + COUNT_BITS)).astype(np.int64), both & np.uint64((1 << GRAM_BITS) - 1)
    heads = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    rank = np.arange(len(row)) - np.maximum.accumulate(np.where(heads, np.arange(len(row)), 0)) if len(row) else np.zeros(0, np.int64)
    few = rank < most
    return row[few], gram[few], rank[few]


class Profiles:
    """The languages' profiles as one table: known n-grams, and the rank of each in each language."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int) -> None:
        self.ranks = ranks
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.uint64))
        self.table = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for lang, gram, rank in rows:
            self.table[np.searchsorted(self.grams, np.uint64(gram)), self.langs.index(lang)] = rank

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        row, gram, rank = _ranked(*_counts(texts), self.ranks)
        many = np.bincount(row, minlength=len(texts))
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        gaps = np.empty((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            there = self.table[at, k]
            gaps[:, k] = np.bincount(row, np.where(there < 0, self.ranks, np.abs(there - rank)), len(texts))
        best = gaps.argmin(axis=1)
        score = 1 - gaps[np.arange(len(texts)), best] / np.maximum(1, many * self.ranks)
        return [self.langs[b] if m else UNKNOWN for b, m in zip(best.tolist(), many.tolist(), strict=True)], np.where(many > 0, np.clip(score, 0, 1), 0.0)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for part in chunked(batches, 1 << 21):
        for at in range(0, part.num_rows, 1 << ROW_BITS):
            yield part.slice(at, 1 << ROW_BITS)


def held_out() -> Column:
    """Documents that are never learned from: the CRC-32 of the id's digits leaves 2 modulo 4. A null id is none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, ranks: int = RANKS, train_docs: int = TRAIN_DOCS) -> Profiles:
    """Profiles from the labelled documents that aren't held out: about train_docs of each language, or all there are."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Profiles([], ranks)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, train_docs / n))])[F.col("lang")]
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs], np.uint64)
            key, n = _counts(part.column("text").to_pylist())
            key = of[(key >> np.uint64(GRAM_BITS)).astype(np.int64)] << np.uint64(GRAM_BITS) | key & np.uint64((1 << GRAM_BITS) - 1)
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            key, n = key[heads], np.add.reduceat(n, heads) if len(heads) else n
            lang = pa.array(names, pa.string()).take(pa.array((key >> np.uint64(GRAM_BITS)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([lang, pa.array((key & np.uint64((1 << GRAM_BITS) - 1)).astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    total = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).where(F.col("rank") < ranks)
    return Profiles([(r["lang"], r["gram"], r["rank"]) for r in best.collect()], ranks)


def predict(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs: doc_id (or keep's columns), lang_pred and score (0 to 1, the share of the largest distance not reached).

    Languages at equal distance: the first by name. N-grams are told apart by 33 bits of hash. A null text or one without a letter is und with score 0; so is every text if nothing could be learned. Only the text is
    looked at, a long one by pieces. Repeated rows stay; an empty table gives an empty result; columns outside keep are not carried.
    """
    keep = ["doc_id"] if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(*keep, docs["text"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            langs, score = sent.value.predict([t or "" for t in part.column("_text").to_pylist()])
            out = part.select(keep).append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(score, pa.float64()))
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.select(*keep).schema.add("lang_pred", "string").add("score", "double"))


def known_language(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs (with their columns) without those that have no language: null texts, texts without a letter or with a lower score."""
    found = predict(packed(docs), train(docs), keep=["_doc"])
    return unpacked(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)))


def identify(docs: DataFrame) -> DataFrame:
    """Trains on docs and predicts every one of them: doc_id, held_out, lang_pred, score."""
    rows = predict(docs.select("doc_id", "text"), train(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
