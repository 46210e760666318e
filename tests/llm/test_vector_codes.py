import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from cellwise.llm import vector_codes
from cellwise.llm.vector_codes import Codebook, assign

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    """Plain Lloyd in Python's integers."""
    rows = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(map(len, (v for _, v, _ in rows))) // 4) * 4
    rows = [(i, [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (width - len(v)), label) for i, v, label in rows]
    size = width // 4
    parts = [[v[k * size : (k + 1) * size] for _, v, _ in rows] for k in range(4)]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[p[k] for k in order] for p in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for turn in range(rounds + 1):
        got = [[near(x, book) for x in p] for p, book in zip(parts, books, strict=True)]
        if turn == rounds:
            break
        for p, book, own in zip(parts, books, got, strict=True):
            of = defaultdict(list)
            for x, (_, k) in zip(p, own, strict=True):
                of[k].append(x)
            for k, xs in of.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    text = ",".join(str(x) for book in books for e in book for x in e)
    total = defaultdict(int)
    for k, (_, _, label) in enumerate(rows):
        total[label] += sum(own[k][0] for own in got)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((i, "".join(f"{own[k][1]:02x}" for own in got), sum(own[k][0] for own in got), total[label], digest) for k, (i, _, label) in enumerate(rows)), key=str)


def found(df, **how):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df, **how).collect()), key=str)


def test_small_table_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert found(df) == brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


@pytest.mark.parametrize("width", [8, 6])
def test_ties_nulls_and_repeated_rows_against_brute_force(spark, width):
    dice = random.Random(width)
    rows = [(i, [dice.choice([-0.5, 0.0, 0.001, 0.25, 3.0]) for _ in range(width)], dice.choice([1, 2, None])) for i in range(150)]
    rows += rows[:40] + [(None, rows[3][1], None), (7, rows[4][1], 1), (200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * width, 1), (203, [float("inf")] * width, 2), (204, [], 2), (-5, [1.0], 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("v", "code", "lower", "error", "_label", "_vector"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    assert found(df.repartition(3), entries=20) == brute(rows, entries=20)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in (3e4 * i, -3e5, 2.5 * i, 1e4 + i)], 0) for i in range(30)]
    assert found(spark.createDataFrame(rows, SCHEMA), entries=7) == brute(rows, entries=7)
    far = vector_codes.compress(spark.createDataFrame([(1, [3e38, 0.0, 0.0, 0.0], 0), (2, [-3e38, 0.0, 0.0, 0.0], 0)], SCHEMA), entries=1).collect()
    assert len(far) == 2 and all(r.code == "00000000" and r.error is None and r.label_error is None for r in far)


def test_empty_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None, 1)], SCHEMA)) == []
    assert [r[:4] for r in found(spark.createDataFrame([(1, [], 1)], SCHEMA))] == [(1, "00000000", 0, 0)]


def test_bounds_skip_groups_and_change_nothing():
    dice = np.random.default_rng(5)
    centres = dice.integers(-4000, 4000, (64, 4))
    x = centres[dice.integers(0, 64, 3000)] + dice.integers(-60, 60, (3000, 4))
    book = Codebook.start(x[:64].copy())
    code, lower = np.zeros(len(x), np.int64), np.full((len(x), len(book.moved)), -1.0)
    worked = []
    for _ in range(6):
        code, lower, least, done = assign(x, book, code, lower.astype(np.float32).astype(np.float64))
        d = ((x[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
        for g in range(len(book.moved)):
            other = np.where((book.of[None, :] == g) & (np.arange(64)[None, :] != code[:, None]), d, 2**60).min(axis=1)
            assert (lower[:, g] <= np.sqrt(other)).all()
        worked.append(done)
        book = book.updated(np.stack([x[code == k].sum(axis=0) // max(1, (code == k).sum()) if (code == k).any() else book.entries[k] for k in range(64)]))
    assert worked[0] == 65 * len(x) and worked[-1] < worked[0] // 3
