import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise.llm import substring_dedup, suffix_dedup
from cellwise.llm.common import NO_ID, SPACE, buffers, rolling, words


def brute(rows, split, join, window):
    """Per row: id, units, removed units, removed runs, what is kept."""
    first = {}
    for i, text in rows:
        own = split(text)
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            first[key] = min(first.get(key, NO_ID), NO_ID if i is None else i)
    out = Counter()
    for i, text in rows:
        own = split(text)
        gone = [False] * len(own)
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < (NO_ID if i is None else i):
                gone[k : k + window] = [True] * window
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(own), sum(gone), runs, join(u for u, g in zip(own, gone, strict=True) if not g)] += 1
    return out


def test_words_against_brute_force(odd_docs, rows_of):
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text.encode()) for r in substring_dedup.deduplicate(odd_docs).collect())
    expected = Counter()
    for (i, n, gone, _, kept), times in brute(rows_of, lambda t: (t or "").encode().split(), b" ".join, 50).items():
        expected[i, n, gone, kept] += times
    assert found == expected
    assert any(gone for _, _, gone, _ in found)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_bytes_against_brute_force(odd_docs, rows_of, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.deduplicate(odd_docs).collect())
    assert found == brute(rows_of, lambda t: (t or "").encode(), bytes, 50)


def against_brute_force(spark, rows, parts=2):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text.encode()) for r in substring_dedup.deduplicate(df).collect())
    expected = Counter()
    for (i, n, gone, _, kept), times in brute(rows, lambda t: (t or "").encode().split(), b" ".join, 50).items():
        expected[i, n, gone, kept] += times
    assert found == expected
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.deduplicate(df).collect())
    assert found == brute(rows, lambda t: (t or "").encode(), bytes, 50)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_of_one_id_with_equal_short_hashes(spark, doc_id):
    """Texts without an id, or of one id, that Spark's 32-bit hash can't tell apart."""
    passage = " ".join(f"passage{i}" for i in range(60))
    n = spark.range(200_000)
    short = n.select(F.format_string("short %s", "id").alias("a")).withColumn("h", F.hash("a"))
    long_ = n.select(F.concat(F.format_string("long %s ", "id"), F.lit(passage)).alias("b")).withColumn("h", F.hash("b"))
    both = short.join(long_, "h").select("a", "b").first()
    against_brute_force(spark, [(1, passage), (doc_id, both.a), (doc_id, both.b), (doc_id, both.b)])


def thue_morse(n, letters="ab"):
    return "".join(letters[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_two_letters_in_thue_morse_order(spark, n):
    """Powers of a number modulo 2**64 have equal sums over such a word and its complement."""
    lead, tail = " ".join(f"a{k}" for k in range(30)), " ".join(f"z{k}" for k in range(30))
    rows = [(1, f"{lead} {thue_morse(n)} {tail}"), (2, f"{lead} {thue_morse(n, 'ba')} {tail}"), (3, f"{lead} {thue_morse(n)} {tail} end")]
    against_brute_force(spark, rows)


def test_whole_characters_are_those_with_all_bytes_gone(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("aéß日🙂 ") for _ in range(400))
    rows = [(0, base)] + [(k, "x" * (k % 3) + base[k * 7 : k * 7 + 90] + rng.choice("éè日本ab") + base[k : k + 40]) for k in range(1, 30)]
    bytewise = {r.doc_id: r for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, t in rows:
        own = t.encode()
        for k in range(len(own) - 49):
            first.setdefault(own[k : k + 50], i)
    for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), whole_characters=True).collect():
        text = dict(rows)[r.doc_id]
        own = text.encode()
        gone = [False] * len(own)
        for k in range(len(own) - 49):
            if first[own[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = [True] * 50
        kept, at = "", 0
        for c in text:
            n = len(c.encode())
            kept += "" if all(gone[at : at + n]) else c
            at += n
        assert bytes(r.kept).decode() == kept and bytewise[r.doc_id].n_removed == sum(gone)


def test_whole_characters(spark):
    rows = [(1, "é" * 40), (2, "xé" + "é" * 40), (3, "x" + "é" * 24 + "è")]
    out = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), whole_characters=True).collect()
    assert all(bytes(r.kept).decode() is not None for r in out)
    assert {r.doc_id: r.n_removed for r in out}[1] == 0


def test_empty_tables(no_docs):
    assert substring_dedup.deduplicate(no_docs).count() == 0
    assert suffix_dedup.deduplicate(no_docs).count() == 0


def test_rounds_of_the_sketch_change_nothing(odd_docs, monkeypatch):
    from cellwise.llm import windows

    once = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.deduplicate(odd_docs).collect())
    plan = windows.Plan.of
    monkeypatch.setattr(windows.Plan, "of", staticmethod(lambda tokens, window, gram: plan(tokens, window, gram, most_bits=16)))
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.deduplicate(odd_docs).collect()) == once


def test_radix_groups():
    data = np.frombuffer(b"abcdefghijXabcdefghijYabcdefghiZ", np.uint8)
    live, group = suffix_dedup.radix_groups(data, np.array([0, 11, 22]), np.zeros(3, np.int64), 10)
    assert sorted(live.tolist()) == [0, 1] and len(set(group.tolist())) == 1


def test_word_hashes_and_rolling():
    import pyarrow as pa

    data, offsets = buffers(pa.chunked_array([pa.array(["a b a", None, "", " b c\x0bb "])]))
    hashes, rows = words(data, offsets, SPACE)
    assert rows.tolist() == [0, 3, 3, 3, 5]
    assert hashes[0] == hashes[2] != hashes[1] and hashes[1] == hashes[4]
    x = np.arange(100, dtype=np.uint64) % 7
    for size in (1, 2, 3, 18, 50):
        own = rolling(x, size, 0xD1342543DE82EF95)
        assert len(own) == 101 - size
        assert all((own[i] == own[j]) == (x[i : i + size].tolist() == x[j : j + size].tolist()) for i in range(0, 40, 3) for j in range(0, 40, 7))
