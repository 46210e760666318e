import random

import corpus_pipeline
from cellwise.llm import near_copies

SCHEMA = "doc_id long, text string"


def shingles(text):
    own = (text or "").encode().lower().split()
    return {b" ".join(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def similar(own, other):
    return 5 * len(own & other) >= 4 * len(own | other)


def held_against(rows, kept):
    """Pairs of kept rows that are similar, which the signatures missed. Each row that went has an earlier, similar, kept one."""
    order = sorted(((2**63 - 1 if i is None else i, shingles(t)) for i, t in rows), key=lambda x: x[0])
    stay = [(i, own) for i, own in order if i in kept]
    for i, own in order:
        assert i in kept or any(j <= i and similar(own, other) for j, other in stay), i
    return sum(similar(own, other) for k, (_, own) in enumerate(stay) for _, other in stay[:k])


def near_group(n, seed=1, length=150, edits=4):
    """Copies of one text, each with a few words changed: chains, and pairs on both sides of 0.8."""
    rng = random.Random(seed)
    base = [f"word{rng.randrange(10**6)}" for _ in range(length)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(length)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


def ids(df):
    return sorted(2**63 - 1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())


def test_stage_finds_what_is_08_similar(spark, sf_dir):
    """Pairs with fingerprints over three bits apart, and a chain whose end is not similar to its beginning."""
    rows = near_group(60)
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    kept = ids(stage(spark, spark.createDataFrame(rows, SCHEMA), sf_dir))
    assert kept[0] == 0 and len(kept) < 30 and held_against(rows, kept) <= 2


def test_texts_with_one_repeated_line_stay(spark, sf_dir):
    """A line repeated in both makes the fingerprints equal, as repeats are counted there; the sets are not similar."""
    rows = [(k, "the same line of words again now " * 200 + " ".join(f"own{k}x{j}" for j in range(60))) for k in range(2)]
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    assert ids(stage(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)) == [0, 1]


def test_against_brute_force(odd_docs, rows_of, no_docs):
    kept = near_copies.without_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    unique = list(dict.fromkeys(rows_of))
    assert held_against(unique, ids(kept)) <= 1
    assert near_copies.without_near_copies(no_docs).count() == 0


def test_recall_by_similarity(spark):
    """Pairs of texts of 100 to 300 words with one to eight changed words: nearly all that are 0.8 similar are found."""
    rng = random.Random(5)
    rows, pairs = [], []
    for k in range(300):
        own = [f"p{k}w{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 300))]
        other = list(own)
        for _ in range(rng.randrange(1, 9)):
            other[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        pairs.append(similar(shingles(rows[-2][1]), shingles(rows[-1][1])))
    kept = set(ids(near_copies.without_near_copies(spark.createDataFrame(rows, SCHEMA).repartition(4))))
    assert all(2 * k in kept for k in range(300)) and all(2 * k + 1 in kept for k in range(300) if not pairs[k])
    assert sum(2 * k + 1 not in kept for k in range(300)) >= 0.95 * sum(pairs) > 100


def test_rounds_of_large_groups(spark):
    """Buckets larger than what is held, and more partners than a round gives."""
    rows = near_group(90, seed=2, edits=8) + [(1000 + i, t) for i, t in near_group(40, seed=3)]
    df = spark.createDataFrame(rows, SCHEMA)
    many = ids(near_copies.without_near_copies(df))
    few = ids(near_copies.without_near_copies(df, held=16, partners=1))
    assert held_against(rows, many) <= 4 >= held_against(rows, few) and few == many


def test_order_in_rows_is_that_of_lexsort():
    """Sixteen-bit rows go by radix, more rows by lexsort; both give the same values in the same places."""
    import numpy as np

    rng = np.random.default_rng(3)
    for rows in (1, 300, 70_000):
        value, row = rng.integers(0, 50, 100_000).astype(np.uint64) << np.uint64(59), rng.integers(0, rows, 100_000)
        row[-1] = rows - 1
        got, want = near_copies.sorted_in_rows(value, row), np.lexsort((value, row))
        assert (value[got] == value[want]).all() and (row[got] == row[want]).all() and len(set(got.tolist())) == len(got)
    assert len(near_copies.sorted_in_rows(np.zeros(0, np.uint64), np.zeros(0, np.int64))) == 0
