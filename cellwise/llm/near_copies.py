"""SimHash near-duplicates at a Jaccard similarity: deletion-variant signatures of wide fingerprints, then exact verification.

The 64-bit fingerprints of simhash lie three bits apart at most only for near-identical texts. At a similarity of 0.8 a
seventh of all bits differ, and no number of segments then leaves one that must agree. So here a fingerprint has
SEGMENTS x WIDTH bits, majorities over the set of word shingles, and the majorities' sizes say which bits may differ: of each
segment only the WEAK bits with the smallest majorities are taken out in turn, and only the BEST most certain segments are
indexed. Pairs that share a signature are verified on the whole sets.

Of the documents in the order of their ids, one goes if it is similar to an earlier one that stays: every document that goes
has a similar one in the result. Large groups are settled in rounds, so that no group gives all its pairs. The settings find
nine in ten pairs of similarity 0.8 exactly, 99 % at 0.85 and practically all from 0.9 on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.llm.common import LOWER, SPACE, buffers, chunked, dropped, may_be_in, mix64, order_id, packed, rolling, saved, spread_ranges, unpacked, words

#: Jaccard similarity of 4 / 5 or more.
OVER, UNDER = 4, 5
BASE = 0x9E3779B97F4A7C15
SEGMENTS, WIDTH, WEAK, BEST = 64, 22, 4, 24
#: Bits of the first 64 in which members of a bucket may differ: at a similarity of 0.8 they do in 9.7 +- 2.9, unrelated ones in 32 +- 4.
CHECK = 20
#: 64-bit words of a fingerprint that candidate pairs are compared by, and bits in which they may differ: at 0.8 they do in 78 +- 8.
WORDS, NEAR = 8, 99
#: Partners that a document gets from a bucket in the first round, and members of a bucket held to compare others with.
PARTNERS, HELD = 1, 1024


def sorted_in_rows(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The places of the values, sorted in each row, rows ascending: lexsort's, but that equal values of a row may come in any order."""
    if not len(row) or row.max() >= 1 << 16:
        return np.lexsort((value, row))
    order = np.argsort(value)
    # Numbers of sixteen bits are sorted by radix.
    return order[np.argsort(row.astype(np.uint16)[order], kind="stable")]


def shingle_sets(column: pa.ChunkedArray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, sorted in each, the number of each text's, and a hash of each text's set.

    A text with fewer words has one shingle, of all its words; one without words has none.
    """
    data, offsets = buffers(column)
    word, rows = words(LOWER[data], offsets, SPACE)
    sizes = np.diff(rows)
    whole = np.flatnonzero(sizes >= shingle)
    starts = spread_ranges(rows[whole], sizes[whole] - shingle + 1)
    found, row = [rolling(word, shingle, BASE)[starts]], [np.repeat(whole, sizes[whole] - shingle + 1)]
    for n in range(1, shingle):
        short = np.flatnonzero(sizes == n)
        value = np.full(len(short), n, np.uint64)
        for k in range(n):
            value = mix64(value * np.uint64(BASE) + word[rows[short] + k])
        found.append(value)
        row.append(short)
    value, row = np.concatenate(found), np.concatenate(row)
    order = sorted_in_rows(value, row)
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    many = np.bincount(row, minlength=len(sizes))
    ends = np.r_[np.uint64(0), np.cumsum(mix64(value ^ np.uint64(BASE)), dtype=np.uint64)]
    at = np.r_[0, np.cumsum(many)]
    return value, many, mix64(ends[at[1:]] - ends[at[:-1]] + many.astype(np.uint64))


def majorities(value: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each set (many of value's shingles each, none empty) and bit: shingles that have it set, less those that don't.

    Eight bits of a hash are added at once, a byte each, over at most 255 shingles; then the parts are added.
    """
    pieces = -(-many // 255)
    owner = np.repeat(np.arange(len(many)), pieces)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(np.cumsum(many) - many, pieces) + 255 * inner
    heads = np.cumsum(pieces) - pieces
    hashes = SEGMENTS * WIDTH // 64
    ones = np.empty((len(many), hashes, 8, 8), np.int32)
    for h in range(hashes):
        hashed = mix64(value ^ np.uint64((h + 1) * BASE % 2**64))
        for r in range(8):
            lanes = np.add.reduceat((hashed >> np.uint64(r)) & np.uint64(0x0101010101010101), starts).view(np.uint8).reshape(-1, 8)
            ones[:, h, r] = np.add.reduceat(lanes.astype(np.int32), heads, axis=0)
    return 2 * ones.reshape(len(many), -1) - many[:, None].astype(np.int32)


def wide_fingerprints(value: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set its first WORDS * 64 bits, and its BEST segments: the segment's number, its WEAK bits' numbers and its bits, in one long."""
    excess = majorities(value, many)
    bits = excess > 0
    first = np.packbits(bits[:, : WORDS * 64], axis=1).view(np.uint64)
    size = (np.abs(excess) / np.sqrt(many)[:, None].astype(np.float32)).astype(np.float32).reshape(-1, SEGMENTS, WIDTH)
    weak = np.argpartition(size, WEAK - 1, axis=2)[:, :, :WEAK].astype(np.int64)
    # About the chance that a bit differs at a similarity of 0.8, from its majority's size; the weakest may be taken out.
    risk = 0.5 * np.exp(-0.717 * 1.94 * size - 0.416 * (1.94 * size) ** 2)
    risk = risk.sum(axis=2) - risk.max(axis=2)
    best = np.argpartition(risk, BEST - 1, axis=1)[:, :BEST]
    held = bits.reshape(-1, SEGMENTS, WIDTH) @ (1 << np.arange(WIDTH, dtype=np.int64))
    out = np.arange(SEGMENTS, dtype=np.int64) << (5 * WEAK + WIDTH)
    out = out + (weak << (WIDTH + 5 * np.arange(WEAK, dtype=np.int64))).sum(axis=2) + held
    return first, np.take_along_axis(out, best, axis=1)


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """_id, _row, key (a hash of the set of shingles), bits (binary) and segments of every document; without words no segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, 1 << 23):
            value, many, key = shingle_sets(part.column("text"), shingle)
            ends = np.r_[0, np.cumsum(many)]
            bits, segments = np.zeros((len(many), WORDS), np.uint64), np.zeros((len(many), BEST), np.int64)
            some = np.flatnonzero(many)
            for at in range(0, len(some), 512):
                own = some[at : at + 512]
                for few in np.split(own, np.flatnonzero(np.diff(ends[own + 1] // (1 << 18))) + 1):  # long texts by themselves
                    bits[few], segments[few] = wide_fingerprints(value[ends[few[0]] : ends[few[-1] + 1]], many[few])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(many > 0, BEST, 0))].astype(np.int32)), pa.array(segments[many > 0].reshape(-1)))
            whole = pa.array([x.tobytes() for x in bits], pa.binary())
            out = part.select(["_id", "_row"]).append_column("key", pa.array(key.view(np.int64))).append_column("bits", whole)
            yield from out.append_column("segments", lists).combine_chunks().to_batches()

    return docs.select("_id", "_row", "text").mapInArrow(run, "_id long, _row long, key long, bits binary, segments array<long>")


def _signatures(sets: DataFrame) -> DataFrame:
    """sig, key and print (the first 64 bits): each segment with one of its weak bits taken out, marked with which it is."""
    rows = sets.select("key", F.conv(F.hex(F.substring("bits", 1, 8)), 16, -10).cast("long").alias("print"), F.explode("segments").alias("s"))

    def variant(k: int) -> str:
        bit = f"CAST((s >> {WIDTH + 5 * k}) & 31 AS INT)"
        return f"(((s >> {5 * WEAK + WIDTH}) * 32 + {bit}) << {WIDTH}) | (s & {(1 << WIDTH) - 1} & ~(1L << {bit}))"

    return rows.select("key", "print", F.explode(F.array(*[F.expr(variant(k)) for k in range(WEAK)])).alias("sig")).select("sig", "key", "print")


def _by_bucket(batches: Iterator[pa.RecordBatch], most: int, held: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first one, cut where it changes; of a run of over most rows its first held come again before each part."""
    last: list[np.ndarray] = []
    for batch in batches:
        own = [_column(c) for c in batch.columns]
        now = [np.concatenate([x, y]) for x, y in zip(last, own, strict=True)] if last else own
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
        large = len(now[0]) - cut > most
        if cut or large:
            yield now if large else [x[:cut] for x in now]
        last = [x[cut : cut + held] if large else x[cut:] for x in now]
    if last and len(last[0]):
        yield last


def _column(array: pa.Array) -> np.ndarray:
    if not pa.types.is_binary(array.type):
        return array.to_numpy(zero_copy_only=False)
    return np.frombuffer(b"".join(array.to_pylist()), np.uint64).reshape(-1, WORDS)


def _buckets(sets: DataFrame, held: int) -> DataFrame:
    """sig and key of what shares a signature with another that lies near in 64 bits; of very large buckets all members."""
    rows = _signatures(sets).repartition("sig").sortWithinPartitions("sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, key, prints in _by_bucket(batches, held, held):
            prints = prints.view(np.uint64)
            keep = np.zeros(len(sig), bool)
            heads = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            sizes = np.diff(np.r_[heads, len(sig)])
            two = heads[sizes == 2]
            keep[two] = keep[two + 1] = np.bitwise_count(prints[two] ^ prints[two + 1]) <= CHECK
            for s, n in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = prints[s : s + n]
                keep[s : s + n] = n > held or (np.bitwise_count(own[:, None] ^ own[None, :]) <= CHECK).sum(axis=1) > 1
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(key[keep])], ["sig", "key"])

    return rows.mapInArrow(run, "sig long, key long").distinct()


def _pairs_of(key: np.ndarray, bits: np.ndarray, held: int, partners: int) -> np.ndarray:
    """Candidates in one bucket, members in the order of ids: rows a, b, late; a is earlier, late: b has pairs not given here.

    A member that others have such pairs with, and that has none itself, gives a row (b, b, 1).
    """
    n, m = len(key), min(len(key), held)
    apart = np.zeros((n, m), np.uint16)
    for k in range(bits.shape[1]):
        apart += np.bitwise_count(bits[:, None, k] ^ bits[None, :m, k])
    near = (apart <= NEAR) & (np.arange(n)[:, None] > np.arange(m))
    rank = np.cumsum(near, axis=1)
    b, a = np.nonzero(near & (rank <= partners))
    late_b, late_a = np.nonzero(near & (rank > partners))
    late = np.zeros(n, bool)
    late[np.r_[late_a, late_b, np.arange(m, n)]] = True
    alone = late.copy()
    alone[b] = False
    alone = np.flatnonzero(alone)
    return np.stack([np.r_[key[a], key[alone]], np.r_[key[b], key[alone]], np.r_[late[b], late[alone]]], axis=1)


def _candidates(buckets: DataFrame, sets: DataFrame, held: int, partners: int) -> DataFrame:
    """Pairs (a, b), a earlier, that share a signature and may be similar; late where b has not been compared with all earlier ones.

    A bucket's members come in the order of ids; beyond those held, they are compared with those only, and looked at again
    in the next round, so that the largest bucket takes no more memory than others, and a member gives a row or two.
    """
    rows = buckets.join(sets.select("key", "id", "bits"), "key").repartition("sig").sortWithinPartitions("sig", "id", "key").select("sig", "key", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, key, bits in _by_bucket(batches, 2 * held, held):
            heads = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            sizes = np.diff(np.r_[heads, len(sig)])
            two = heads[sizes == 2]
            near = two[np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1) <= NEAR]
            found = [np.stack([key[near], key[near + 1], np.zeros(len(near), np.int64)], axis=1)]
            for s, n in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                for at in range(0, max(1, n - held), held):  # in blocks: the first held, and as many others
                    own = np.r_[s : s + min(n, held), s + held + at : max(s + held + at, min(s + n, s + 2 * held + at))]
                    found.append(_pairs_of(key[own], bits[own], held, partners))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2].astype(np.int32))], ["a", "b", "late"])

    return rows.mapInArrow(run, "a long, b long, late int").groupBy("a", "b").agg(F.max("late").alias("late"))


def sets_of_keys(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """key and the set of the wanted keys (and of some more: which are wanted is sent as a bitmap of 16 MB at most)."""
    bits = min(27, max(15, (8 * wanted.count()).bit_length()))
    place = F.pmod("key", F.lit(1 << bits)) + 1
    parts = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.toLocalIterator():
        bitmap[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["map"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, 1 << 23):
            value, many, key = shingle_sets(part.column("text"), shingle)
            at = key & np.uint64(8 * len(sent.value) - 1)
            hit = (sent.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            once = np.zeros(len(key), bool)
            once[np.unique(key, return_index=True)[1]] = True
            hit &= once
            inner = value[np.repeat(hit, many)].view(np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many[hit])]), pa.array(inner)).cast(pa.list_(pa.int64()))
            yield from pa.table({"key": pa.array(key[hit].view(np.int64)), "values": lists}).to_batches(256)

    return docs.select("text").mapInArrow(run, "key long, values array<long>").groupBy("key").agg(F.any_value("values").alias("values"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("values").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("values").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                p, q = x[k].values.to_numpy(), y[k].values.to_numpy()
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep[k] = UNDER * same >= OVER * (len(p) + len(q) - same)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    sized = F.least(F.size("x"), F.size("y")) * UNDER >= F.greatest(F.size("x"), F.size("y")) * OVER
    return both.where(sized).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _going(docs: DataFrame, signed: DataFrame, shingle: int, held: int, partners: int) -> DataFrame | None:
    """The keys of the sets that are similar to an earlier one that stays."""
    one = saved(signed.groupBy("key").agg(F.min("_id").alias("id"), F.any_value("bits").alias("bits"), F.any_value("segments").alias("segments")), "near-one")
    buckets = saved(_buckets(one, held), "near-buckets")
    pairs = saved(_candidates(buckets, one, held, partners), "near-pairs")
    sets = saved(sets_of_keys(docs, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), shingle), "near-sets")
    gone: list[DataFrame] = []
    while True:
        # Rows (b, b) hold b back like an earlier similar one that is not settled.
        waiting = pairs.where("late = 1").select(F.col("b").alias("a"), "b").distinct()
        edges = saved(_similar(pairs.where("a <> b").select("a", "b"), sets).unionByName(waiting), "near-edges")
        dropped(pairs)
        while True:
            stay = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
            go = saved(edges.join(stay, "a").select(F.col("b").alias("key")).distinct(), "near-gone")
            if go.isEmpty():
                break
            gone.append(go)
            left = edges.join(go, edges["b"] == go["key"], "left_anti")
            edges, before = saved(left.join(go, left["a"] == go["key"], "left_anti"), "near-edges"), edges
            dropped(before)
        if edges.isEmpty():
            break
        active = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        partners *= 2
        pairs = saved(_candidates(buckets, one.join(active, "key", "left_semi"), held, partners), "near-pairs")
        dropped(edges)
    for table in (sets, buckets, one):
        dropped(table)
    out = None
    for go in gone:
        out = go if out is None else out.unionByName(go)
    return out


def without_near_copies(docs: DataFrame, shingle: int = 5, held: int = HELD, partners: int = PARTNERS) -> DataFrame:
    """docs without the rows that are similar to a kept one of a smaller doc_id (null ids last; of equal sets one row stays).

    Null texts and texts without words have equal, empty sets; of rows that are equal in every column one stays; an empty
    table gives an empty result; all columns are kept, whatever their names. A very long text takes some 40 times its bytes
    in a task.
    """
    rows = packed(docs).withColumns({"_id": order_id(), "_row": F.xxhash64("_doc")})
    signed = saved(_signed(rows, shingle), "near-signed")
    gone = _going(rows, signed, shingle, held, partners)
    prints = signed.select("_id", "_row", "key")
    left = prints.join(gone, "key", "left_anti") if gone is not None else prints
    first = saved(left.groupBy("key").agg(F.min(F.struct("_id", "_row")).alias("first")).select("first.*"), "near-first")
    # Only rows that go, or are repeated, are moved: a row is looked up in a bitmap of these before any join.
    times = prints.groupBy("_id", "_row").agg(F.count("*").alias("n"))
    other = saved(times.join(first, ["_id", "_row"], "left_anti").unionByName(times.where("n > 1")).select("_id", "_row"), "near-other")
    may = may_be_in(rows, other, ["_id", "_row"])
    once = Window.partitionBy("_id", "_row").orderBy(F.lit(0))
    kept = may.where("_may").drop("_may").join(first, ["_id", "_row"], "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return unpacked(may.where("NOT _may").drop("_may").unionByName(kept))
