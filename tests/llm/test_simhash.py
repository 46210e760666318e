import numpy as np
import xxhash
from pyspark.sql import functions as F

from cellwise.llm import simhash


def plain_fingerprint(text):
    own = (text or "").encode().lower().split()
    shingles = [b" ".join(own[k : k + 3]) for k in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i is None, i or 0, f"{p:016x}", least.get(root(k))) for k, ((i, _), p) in enumerate(zip(rows, prints, strict=True)))


def test_against_brute_force(odd_docs, rows_of):
    found = simhash.near_duplicates(odd_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in found) == plain_components(rows_of)


def test_spark_has_the_same_hash(spark):
    assert spark.sql("SELECT xxhash64('one two three') AS h").first().h % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_connect_is_whole():
    rng = np.random.default_rng(5)
    for n, flips in ((50, 4), (400, 3), (700, 6)):
        seeds = rng.integers(0, 2**63, 3, dtype=np.uint64)
        values = seeds[rng.integers(0, 3, n)]
        for _ in range(flips):
            values = values ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
        values = np.unique(values)
        label = simhash.connect(values, 3)
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
        plain = np.arange(len(values))
        while True:
            low = np.where(near, plain[None, :], len(values)).min(axis=1)
            if (low == plain).all():
                break
            plain = low
        assert len(set(zip(label.tolist(), plain.tolist(), strict=True))) == len(set(plain.tolist())) == len(set(label.tolist()))


def test_signatures_meet(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for k in range(60):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, 3, replace=False):
            b ^= 1 << int(bit)
        pairs.append((k, a, b - 2**64 if b >= 2**63 else b))
    rows = spark.createDataFrame(pairs, "k int, a long, b long")
    both = rows.select(F.arrays_overlap(simhash.signatures(F.col("a")), simhash.signatures(F.col("b"))).alias("meet"))
    assert both.where("meet").count() == 60


def test_long_chain_of_components(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = simhash.components(edges).collect()
    assert {r.root for r in found} == {0} and len(found) == 300


def test_one_of_each(odd_docs, no_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    # Three texts of one id are near copies of an earlier one; of five texts without a word one stays.
    left = [r.doc_id for r in kept.where("doc_id >= 900 OR doc_id IS NULL").select("doc_id").collect()]
    assert left.count(905) == 1 and 906 not in left and sum(i in (900, 901, 902) for i in left) == 1
    assert simhash.one_of_each(no_docs).count() == 0 == simhash.near_duplicates(no_docs).count()
