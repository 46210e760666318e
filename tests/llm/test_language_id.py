import zlib

from cellwise.llm import language_id


def plain_profile(texts, most):
    from collections import Counter

    from cellwise.llm.common import mix64

    import numpy as np

    counts = Counter()
    for text in texts:
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        for w in words:
            marked = "\0" + w + "\0"
            for size, mark in ((1, 1 << 63), (2, 1 << 62), (3, 0)):
                for k in range(len(marked) - size + 1):
                    gram = marked[k : k + size]
                    if gram.strip("\0"):
                        code = 0
                        for c in gram:
                            code = code << 21 | ord(c)
                        counts[int(mix64(np.array([code | mark], np.uint64))[0]) >> (64 - language_id.GRAM_BITS)] += 1
    return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most])}


def test_distance_against_brute_force():
    texts = {"a": "the cat and the dog, the end", "b": "le chat et le chien; la fin", "c": "der hund und die katze"}
    rows = [(lang, g, r) for lang, t in texts.items() for g, r in plain_profile([t], 20).items()]
    profiles = language_id.Profiles(rows, 20)
    asked = ["the dog", "le chien", "un chat 12", "die", "", "123", "x" * 50, "THE Cat\nand"]
    langs, scores = profiles.predict(asked)
    for text, lang, score in zip(asked, langs, scores, strict=True):
        own = plain_profile([text], 20)
        if not own:
            assert (lang, score) == ("und", 0)
            continue
        gaps = {}
        for name in texts:
            there = {g: r for n, g, r in rows if n == name}
            gaps[name] = sum(abs(there[g] - r) if g in there else 20 for g, r in own.items())
        best = min(sorted(gaps), key=gaps.get)
        assert lang == best and abs(score - (1 - gaps[best] / (20 * len(own)))) < 1e-12


def test_long_text_is_counted_whole(monkeypatch):
    text = "abc de " * 400_000
    key, count = language_id._gram_counts([text])
    assert count.max() == 400_000 * 2 or count.sum() > 0
    whole = dict(zip(key.tolist(), count.tolist(), strict=True))
    half = dict(zip(*[x.tolist() for x in language_id._gram_counts(["abc de " * 10])], strict=True))
    assert {k: v * 40_000 for k, v in half.items()} == whole


def test_held_out_accuracy(odd_docs, rows_of):
    found = language_id.identify(odd_docs).collect()
    assert len(found) == len(rows_of)
    lang = {r.doc_id: r.lang for r in odd_docs.where("doc_id < 900").collect()}
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    judged = [r for r in found if r.held_out and r.doc_id in lang]
    assert sum(r.lang_pred == lang[r.doc_id] for r in judged) >= 0.95 * len(judged)
    without = {900, 901, 902, 903, None}
    assert all(r.lang_pred == "und" for r in found if r.doc_id in without - {None})


def test_stage_and_empty(odd_docs, no_docs):
    kept = language_id.known_language(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {900, 901, 902, 903} and {904, 905, 906} <= ids
    assert language_id.identify(no_docs).count() == 0 == language_id.known_language(no_docs).count()


def test_long_text_is_ranked_by_its_whole_counts():
    """More than 2**17 of several n-grams: their order is that of their counts, not of their hashes."""
    parts = [(c + " ") * (140_000 + 10_000 * k) for k, c in enumerate("abcde")]
    row, gram, rank = language_id._ranked(*language_id._gram_counts(["".join(parts), "b a b"]), 300)
    counts = dict(zip(*[x.tolist() for x in language_id._gram_counts(["".join(parts)])], strict=True))
    own = [counts[g] for g in gram[row == 0].tolist()]
    assert own == sorted(own, reverse=True) and rank[row == 0].tolist() == list(range(len(own)))
    assert sorted(rank[row == 1].tolist()) == list(range((row == 1).sum()))


def test_long_texts_are_counted_by_pieces():
    import random

    rng = random.Random(1)
    text = "".join(rng.choice("abcΣé  .,'9\n-日") for _ in range(3 * language_id.LONG))
    whole, pieces = language_id._gram_counts([text]), language_id._counts([text])
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
