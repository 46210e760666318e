import re

import numpy as np

from cellwise.llm import decontamination
from tests.llm.conftest import PASSAGE

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").encode().lower())


def brute(rows, items, window):
    wanted = {}
    for name, text in items:
        own = split(text)
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            wanted.setdefault(tuple(own[k : k + n]), set()).add("" if name is None else str(name))
    out = []
    for i, text in rows:
        own, names = split(text), set()
        hit = [0] * len(own)
        for n in {len(w) for w in wanted}:
            for k in range(len(own) - n + 1):
                if found := wanted.get(tuple(own[k : k + n])):
                    hit[k : k + n] = [1] * n
                    names |= found
        out.append((i is None, i or 0, len(own), sum(hit), sorted(names)))
    return sorted(out)


def test_against_brute_force(spark, sf_dir, odd_docs, rows_of, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    more = [(900, PASSAGE.upper()), (901, None), (902, ""), (903, "w5x5"), (904, "日本語" * 60 + "x"), (None, "a a a"), (900, PASSAGE)]
    bench = bench.unionByName(spark.createDataFrame(more, bench.schema))
    expected = brute(rows_of, [tuple(r) for r in bench.collect()], 10)
    for block in (decontamination.BLOCK, 2000):
        monkeypatch.setattr(decontamination, "BLOCK", block)
        found = decontamination.mark(odd_docs, bench).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, list(r.items)) for r in found) == expected
    assert {r.longest for r in found if r.doc_id == 905} == {60}
    kept = decontamination.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i for _, i, _, hits, _ in expected if not hits)


def test_empty(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.mark(no_docs, none).count() == 0
    assert decontamination.decontaminate(odd_docs, none).count() == odd_docs.count()


def test_suffix_array_order():
    rng = np.random.default_rng(2)
    codes, rows = rng.integers(0, 4, 300), np.array([0, 100, 100, 300])
    order = decontamination.suffix_array(codes, rows, 10)
    ends = np.repeat(rows[1:], np.diff(rows))
    assert sorted(order.tolist()) == np.flatnonzero(codes > 0).tolist()
    keys = [tuple(codes[p : min(p + 10, ends[p])].tolist()) for p in order]
    cut = [k[: k.index(0)] if 0 in k else k for k in keys]
    assert all(a[: min(len(a), len(b))] <= b[: min(len(a), len(b))] for a, b in zip(cut[:-1], cut[1:], strict=True))


def test_words_of_two_letters_in_thue_morse_order(spark):
    """Powers of a number modulo 2**64 have equal sums over such a word and its complement."""
    one, two = ("".join(x[k.bit_count() & 1] for k in range(2048)) for x in ("ab", "ba"))
    rows = [(i, f"a b c d {w} e f g h i j k") for i, w in ((1, one), (2, two))]
    found = decontamination.mark(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, f"d {one} e f g h i j k l m")], "item_id long, text string"))
    assert sorted((r.doc_id, r.n_hit) for r in found.collect()) == [(1, 0), (2, 0)]
    found = decontamination.mark(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, f"c d {one} e f g h i j k")], "item_id long, text string"))
    assert sorted((r.doc_id, r.n_hit) for r in found.collect()) == [(1, 10), (2, 0)]


def longest(own, items):
    """Words of the longest run of own that stands in an item of ten words or more, or a shorter item's whole length."""
    most = 0
    for item in map(split, items):
        if 0 < len(item) < 10:
            most = max(most, len(item) * any(own[k : k + len(item)] == item for k in range(len(own))))
            continue
        row = [0] * (len(item) + 1)
        for word in own:
            row = [0] + [row[k] + 1 if item[k] == word else 0 for k in range(len(item))]
            most = max(most, max(row)) if max(row) >= 10 else most
    return most


def test_longest_match_of_few_letters(spark):
    """Texts of two words, in which windows repeat inside items and texts, against a table of all pairs of places."""
    rng = np.random.default_rng(5)
    text = lambda n, p: " ".join(np.where(rng.random(n) < p, "a", "b"))
    items = [text(n, p) for n, p in ((40, 0.9), (200, 0.95), (33, 0.5), (9, 0.5), (3, 1.0), (120, 0.97))] + ["a " * 150, "", "c"]
    docs = [text(int(n), p) for n in rng.integers(1, 260, 40) for p in (0.5, 0.9, 0.97)] + ["a " * 400, items[1], items[5] + " c " + items[2]]
    found = decontamination.mark(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {r.doc_id: r.longest for r in found.collect()} == {k: longest(split(d), items) for k, d in enumerate(docs)}


def test_many_equal_items(spark, monkeypatch):
    """50,000 items of one word and as many of one passage, in texts that have them often; what is sent on is cut into small tables."""
    monkeypatch.setattr(decontamination, "SENT", 60_000)
    items = spark.range(100_000).selectExpr("id AS item_id", "CASE WHEN id < 50000 THEN 'Yes' ELSE 'one two three four five six seven eight nine ten eleven' END AS text")
    texts = [(1, "yes " * 100_000), (2, "no"), (3, "One two three four five six seven eight nine ten eleven. Yes"), (4, "yes")]
    found = decontamination.mark(spark.createDataFrame(texts, "doc_id long, text string"), items).selectExpr("doc_id", "n_hit", "longest", "size(items) AS n")
    assert sorted(map(tuple, found.collect())) == [(1, 100_000, 1, 50_000), (2, 0, 0, 0), (3, 12, 11, 100_000), (4, 1, 1, 50_000)]
