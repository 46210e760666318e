import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellwise.llm import collocations
from cellwise.llm.collocations import automaton, words_of


def brute(rows, least, first, longest=5):
    """Rows (lang, rank, phrase, a, l, r, n, score) of (text, lang)."""
    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode()):
            own = re.findall(rb"[^\x20\x09]+", piece.lower())
            n[lang] += len(own)
            for m in range(1, longest + 1):
                for k in range(len(own) - m + 1):
                    count[lang, tuple(own[k : k + m])] += 1
    wanted = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    out, longer = defaultdict(list), Counter()
    for (lang, q), x in wanted.items():
        for m in range(2, len(q)):
            for k in range(len(q) - m + 1):
                longer[lang, q[k : k + m]] = max(longer[lang, q[k : k + m]], x)
    for (lang, p), a in wanted.items():
        m = len(p)
        if longer[lang, p] >= a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, m))
        out[lang].append((-score, -a, b" ".join(p), left, right))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, all_ in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(all_)[:first], 1)}


def found(df, **how):
    rows = collocations.collocations(df, **how).collect()
    out = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("least", "first"), [(2, 2000), (4, 50), (100, 2000)])
def test_odd_documents_against_brute_force(odd_docs, least, first):
    rows = [(r.text, r.lang) for r in odd_docs.select("text", "lang").collect() if not (r.text or "").startswith("w0x0")]
    df = odd_docs.where("doc_id IS NULL OR doc_id <> 904")
    assert found(df, least=least, first=first) == brute(rows, least, first)


def test_small_shards_and_long_texts_give_the_same(spark, monkeypatch):
    dice = random.Random(4)
    text = lambda n: "".join(dice.choice(["a", "B", "cc", "d", "é"]) + dice.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(n))
    rows = [(text(40), dice.choice(["x", "y", None])) for _ in range(60)] + [(text(5000), "x")]
    df = spark.createDataFrame(rows, "text string, lang string")
    expected = brute(rows, 5, 300)
    assert found(df, least=5, first=300) == expected
    monkeypatch.setattr(collocations, "SHARD", 400)
    monkeypatch.setattr(collocations, "PIECE", 100)
    assert found(df, least=5, first=300) == expected


def test_empty_tables(spark, no_docs):
    assert not found(no_docs)
    assert not found(spark.createDataFrame([(None, "x"), ("", None), (" .. ", "x")], "text string, lang string"), least=1)


def test_states_share_end_positions_with_their_suffix_links():
    data = np.frombuffer(b"to be or not to be. not to be or to be", np.uint8)
    w = words_of(data, np.array([0, len(data)]), np.zeros(1, np.uint64))
    states = automaton(w, np.ones(len(w.key), bool), ~w.head, 5)
    phrases = [[w.text[w.starts[end - more] : w.ends[end]].tobytes() for end in s.end] for more, s in enumerate(states)]
    seen = {p: int(n) for own, s in zip(phrases, states, strict=True) for p, n in zip(own, s.count, strict=True)}
    assert seen[b"to be"] == seen[b"to"] == 4 and seen[b"not to be"] == 2 and seen[b"or to be"] == 1
    assert b"be not" not in seen
    for short, long, s in zip(phrases, phrases[1:], states[1:], strict=False):
        assert [short[k] for k in s.link] == [p.split(b" ", 1)[1] for p in long]
