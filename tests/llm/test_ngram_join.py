import random
from collections import Counter

from cellwise.llm import ngram_join


def shingles(text, size=3):
    own = (text or "").encode().lower().split()
    return {b" ".join(own[k : k + size]) for k in range(max(1, len(own) - size + 1))} if own else set()


def brute(rows, size=3):
    """Counts of (id, size of the set, smallest id reached)."""
    sets = [shingles(text, size) for _, text in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                root[max(top(k), top(j))] = min(top(k), top(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return Counter((i, len(s), least.get(top(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(df, **how):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, **how).collect())


def test_odd_documents_against_brute_force(odd_docs, rows_of):
    assert found(odd_docs) == brute(rows_of)


def variants(seed=1):
    """Chains of versions, a large group around a text that is not in it, groups at the limit, and short texts."""
    dice = random.Random(seed)
    word = lambda n=400: f"w{dice.randrange(n)}"
    texts = []
    own = [word() for _ in range(120)]
    for _ in range(25):  # each version like the one before, not like the first
        own = list(own)
        own[dice.randrange(len(own))] = word(10**6)
        texts.append(" ".join(own))
    base = [word() for _ in range(90)]
    for k in range(60):
        own = list(base)
        for _ in range(1 + k % 3):
            own[dice.randrange(len(own))] = word(30)
        texts.append(" ".join(own))
    for n in (19, 38, 57):  # 19 shingles of which 18 are shared, and such
        base = [word(10**6) for _ in range(n + 2)]
        texts += [" ".join(base), " ".join(base[: -n // 19 or None]), " ".join([*base, "x"]), " ".join(base[: -(n // 19) - 1])]
    texts += ["a", "a", "A b", "a b", "b a", "a b c", "a b c d", "a b c d e f g h i j k l", "a b c d e f g h i j k"]
    dice.shuffle(texts)
    return list(enumerate(texts, 100))


def test_rounds_and_blocks_against_brute_force(spark):
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute(rows)
    assert len({c for _, _, c in expected}) < len(rows) - 40
    assert found(df) == expected
    assert found(df, block=7, partners=1) == expected


def test_without_hubs_all_links_come_from_the_rounds(spark, monkeypatch):
    none = lambda members, sets, over, under: members.select(members["key"].alias("a"), members["key"].alias("b")).where("a < b")
    monkeypatch.setattr(ngram_join, "_with_hubs", none)
    rows = variants(2)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), block=16, partners=1) == brute(rows)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "token_sketch", lambda docs, total, shingle, make=ngram_join.token_sketch: make(docs, total, shingle, most_bits=10))
    rows = variants(3)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_other_thresholds_and_empty_tables(spark, no_docs):
    rows = [(1, "a b c d e f"), (2, "a b c d e g"), (3, None), (4, ""), (None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(df, shingle=2, over=2, under=3).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (None, 1), (None, None)}
    assert found(no_docs) == Counter()
    assert found(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")) == Counter({(1, 0, 1): 1, (2, 0, 2): 1})


def test_a_long_text_and_its_copy(spark):
    long = " ".join(f"w{k % 7919}x{k % 31}" for k in range(600_000))
    rows = [(5, long), (3, long + " end"), (9, long[: len(long) // 2])]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in rows]
    assert got == {5: 3, 3: 3, 9: 3 if len(sets[0] & sets[2]) * 10 >= 9 * len(sets[0] | sets[2]) else 9}


def test_whole_sets_go_with_candidate_pairs_only(spark, monkeypatch):
    """Texts that share a phrase, and a sketch that calls all shared: every text has a shared token, few pairs are candidates."""
    dice = random.Random(5)
    rows = [(k, " ".join(["one two three four", *(f"w{dice.randrange(10**9)}" for _ in range(30))])) for k in range(80)]
    rows += [(k + 100, text + " end") for k, text in rows[:5]]
    seen = []

    def counted(pairs, sets, *limits, verified=ngram_join.verified):
        seen.append((pairs.select("a").union(pairs.select("b")).distinct().count(), sets.count()))
        return verified(pairs, sets, *limits)

    monkeypatch.setattr(ngram_join, "verified", counted)
    monkeypatch.setattr(ngram_join, "token_sketch", lambda docs, total, shingle, make=ngram_join.token_sketch: make(docs, total, shingle, most_bits=10))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert all(sets <= keys + 2 for keys, sets in seen) and sum(sets for _, sets in seen) < len(rows) // 2


def test_the_sketch_has_room_for_the_shingles_of_six_gigabytes(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ngram_join, "merged_sketch", lambda rows, make, plan, *_: plans.append(plan))
    for total in (10**6, 10**8, 15 * 10**8):
        ngram_join.token_sketch(spark.createDataFrame([("a b c",)], "text string"), total, 3)
    assert all(total <= 1.5 * 2**plan.bits for total, plan in zip((10**6, 10**8, 15 * 10**8), plans, strict=True))


def test_large_sets_that_share_tokens_are_told_apart_by_counts(spark, monkeypatch):
    """Bitmaps of large sets are full; with a full sketch, counts by cell must lose no pair and let few through."""
    dice = random.Random(6)
    common = [f"c{k}" for k in range(400)]
    texts = [" ".join([*common, *(f"w{dice.randrange(10**9)}" for _ in range(2600))]) for _ in range(12)]
    texts += [texts[0] + " end", " ".join(texts[1].split()[:2750])]
    monkeypatch.setattr(ngram_join, "token_sketch", lambda docs, total, shingle, make=ngram_join.token_sketch: make(docs, total, shingle, most_bits=10))
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
