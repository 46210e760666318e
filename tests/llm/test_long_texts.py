"""Texts longer than what a task takes at once: they go in pieces, and nothing is lost where pieces meet."""

import bisect
import random

import pytest

from cellwise.llm import common, decontamination, substring_dedup, suffix_dedup

N = 1_900_000


@pytest.fixture(scope="module")
def long_text():
    """Some 17 MB of words that never repeat, and the (first, last) words of passages, many of them where pieces meet."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(N)]
    gaps = [rng.choice((" ", "\n", " \t ", "  ")) for _ in range(N)]
    assert sum(map(len, words)) + sum(map(len, gaps)) > substring_dedup.CHUNK > suffix_dedup.CHUNK
    starts, at = [], 0
    for w, g in zip(words, gaps, strict=True):
        starts.append(at)
        at += len(w) + len(g)
    text = "".join(w + g for w, g in zip(words, gaps, strict=True))
    near = [0, common.PIECE, common.PIECE + 49, common.PIECE + 9, N, *(bisect.bisect(starts, k * suffix_dedup.CHUNK) for k in (1, 2))]
    passages = [(max(0, a - rng.randrange(50, 80)), min(N, a + rng.randrange(60, 90))) for a in near]
    passages += [(a, a + rng.randrange(50, 300)) for a in (rng.randrange(N - 300) for _ in range(40))]
    return text, words, starts, passages


def covered(spans):
    return set().union(*(range(a, b) for a, b in spans))


def docs_of(spark, long_text):
    text, words, starts, passages = long_text
    rows = [(k, text[starts[a] : starts[b - 1] + len(words[b - 1])]) for k, (a, b) in enumerate(passages)]
    return spark.createDataFrame([*rows, (1000, text), (1001, "w5 w6")], "doc_id long, text string").repartition(3), rows


def test_words(spark, long_text):
    _, words, _, passages = long_text
    docs, _ = docs_of(spark, long_text)
    gone = covered(passages)
    row = substring_dedup.deduplicate(docs).where("doc_id = 1000").first()
    assert (row.n_words, row.n_removed) == (N, len(gone))
    assert row.kept_text == " ".join(w for k, w in enumerate(words) if k not in gone)


def test_bytes(spark, long_text):
    text, _, _, _ = long_text
    docs, rows = docs_of(spark, long_text)
    gone = covered((at, at + len(t)) for _, t in rows for at in [text.index(t)] if len(t) >= 50)
    row = suffix_dedup.deduplicate(docs).where("doc_id = 1000").first()
    assert (row.n_bytes, row.n_removed) == (len(text), len(gone))
    assert bytes(row.kept) == bytes(c for k, c in enumerate(text.encode()) if k not in gone)


def test_benchmark_items(spark, long_text):
    _, words, _, passages = long_text
    docs, rows = docs_of(spark, long_text)
    items = spark.createDataFrame([*rows, (5000, f"W{common.PIECE + 3}"), (5001, "w7 w9")], "item_id long, text string")
    row = decontamination.mark(docs, items).where("doc_id = 1000").first()
    hit = covered([*passages, (common.PIECE + 3, common.PIECE + 4)])
    assert (row.n_words, row.n_hit) == (N, len(hit))
    assert row["items"] == sorted([*(str(k) for k, _ in rows), "5000"])
    longest = covered([max(passages, key=lambda p: p[1] - p[0])])
    assert row.longest == len(longest)


def test_words_longer_than_a_piece():
    import numpy as np
    import pyarrow as pa

    big = "x" * (3 * common.PIECE + 5)
    one = "a " + big + " b " + big + "y c"
    hashes, rows = common.words(*common.buffers(pa.chunked_array([pa.array([one, "b", None, big])])), common.SPACE)
    assert rows.tolist() == [0, 5, 6, 6, 7]
    assert hashes[1] == hashes[6] != hashes[3] and hashes[2] == hashes[5]
    assert len(np.unique(hashes)) == 5
