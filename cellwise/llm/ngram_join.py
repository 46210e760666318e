"""Jaccard join of word n-gram sets by filters under several global token orders.

Of two similar sets, each has one of its first tokens in common with the other's first tokens, whatever global order the
tokens are sorted by, if enough first tokens are taken (the prefix). Here there are several orders: all put rare tokens
first, by classes of a count-min sketch of the corpus, and each breaks ties by a hash of its own. A pair is a candidate only
if its prefixes share a token under every order: the first order's tokens are joined on, the other orders' prefixes go
along as bitmaps, which can only let too much through. A token that the sketch says is in one text only is shared with
nothing: most texts have a prefix of such tokens, and end there.

Which texts are similar is not needed pair by pair, but as components. Each text is compared with hubs of its tokens first;
after that, of the texts of one token only those in different components are compared, the smaller components with blocks
of the larger, so that neither a task nor the result holds all pairs of a group. What may be similar by the bitmaps is
verified on the whole sets, and what was left for later comes in further rounds, until nothing is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import chunked, dropped, extended, mix64, saved, spread_ranges
from cellwise.llm.near_copies import shingle_sets
from cellwise.llm.windows import Plan, Sketch, merged_sketch
from cellwise.operators.lineage import connected_components

#: Similarity: 100 * intersection >= 90 * union, in lowest terms.
OVER, UNDER = 9, 10
ORDERS = 3
#: 64-bit words of a bitmap; a set has one of all its tokens (parities) and one of its prefix under each order but the first.
WIDTH = 8
WORDS = WIDTH * ORDERS
#: Members of a token's texts that are held to compare others with.
BLOCK = 1024
#: Larger sets than this have bitmaps that are too full to tell them apart, so that counts by cell of the bitmap are compared before whole sets are.
COUNTED = 512
#: Candidates that a text gives for each other component in the first round, and how this grows.
PARTNERS, GROWTH = 2, 8
#: Steps of the sketch's counts that make a class, as multiples of its mean count.
CLASSES = (1, 16, 256)
SALT = 0x9E3779B97F4A7C15
PART = 1 << 23


def prefix_size(n: np.ndarray, over: int, under: int) -> np.ndarray:
    """Tokens of a set of n of which a similar set has one at least: n - ceil(n * over / under) + 1."""
    return n - -(-n * over // under) + 1


def _signed(docs: DataFrame, keep: list[str], shingle: int) -> DataFrame:
    """keep's columns, key (a hash of the set of shingles) and n (its size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, PART):
            _, many, key = shingle_sets(part.column("text"), shingle)
            out = part.drop_columns(["text"]).append_column("key", pa.array(key.view(np.int64))).append_column("n", pa.array(many.astype(np.int64)))
            yield from out.combine_chunks().to_batches()

    rows = docs.select(*keep, "text")
    return rows.mapInArrow(run, extended(rows.drop("text"), "key bigint, n bigint"))


def token_sketch(docs: DataFrame, total: int, shingle: int, most_bits: int = 30) -> Sketch:
    """Which shingles may be in two texts, and the class of their number. Two cells a shingle, 2**most_bits at most a row.

    Beyond that size more shingles count as shared, and prefixes are shuffled that lead to nothing: a tenth of the shingles at most.
    """
    bits = min(most_bits, max(16, math.ceil(math.log2(2 * max(1, total)))))
    step = max(16, 64 * -(-total >> bits))
    return merged_sketch(docs.select("text"), lambda part: shingle_sets(part.column("text"), shingle)[0], Plan(shingle, shingle, bits, 1), lambda b: chunked(b, PART), tuple(step * c for c in CLASSES))


def bitmap(owner: np.ndarray, token: np.ndarray, n: int, odd: bool) -> np.ndarray:
    """WIDTH words for each of n sets: the bits of its tokens' hashes that are hit, or (odd) hit an odd number of times."""
    place = (mix64(token ^ np.uint64(SALT)) % np.uint64(64 * WIDTH)).astype(np.int64)
    cell, times = np.unique(owner * 64 * WIDTH + place, return_counts=True)
    if odd:
        cell = cell[times % 2 == 1]
    flat = np.zeros(n * 64 * WIDTH, np.uint8)
    flat[cell] = 1
    return np.packbits(flat.reshape(n, 64 * WIDTH), axis=1, bitorder="little").view(np.uint64)


def cell_counts(token: np.ndarray) -> np.ndarray:
    """How many tokens of a set have each bit of a bitmap, 255 at most. Two sets differ in as many tokens as these in all, at least."""
    place = (mix64(token ^ np.uint64(SALT)) % np.uint64(64 * WIDTH)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=64 * WIDTH), 255).astype(np.uint8)


def prefixes(value: np.ndarray, many: np.ndarray, sketch: Sketch, over: int, under: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sets whose prefixes hold shared tokens: which they are, the place in these and the token of each shared one in the
    first order's prefix, and the bitmaps (sets x WORDS).

    Tokens of one text only come first in every order: where they fill the prefix, nothing has to be sorted.
    """
    shared, level = sketch.repeated(value)
    ends = np.r_[0, np.cumsum(shared)]
    at = np.r_[0, np.cumsum(many)]
    common = ends[at[1:]] - ends[at[:-1]]
    room = prefix_size(many, over, under) - (many - common)  # left for shared tokens
    sets = np.flatnonzero((room > 0) & (common > 0))
    n = len(sets)
    whole = spread_ranges(at[sets], many[sets])
    maps = [bitmap(np.repeat(np.arange(n), many[sets]), value[whole], n, odd=True)]
    whole = whole[shared[whole]]
    token, kind, owner = value[whole], level[whole].astype(np.uint64), np.repeat(np.arange(n), common[sets])
    place = np.arange(len(owner)) - np.repeat(np.cumsum(common[sets]) - common[sets], common[sets])
    found = None
    for order in range(ORDERS):
        rank = kind << np.uint64(61) | mix64(token ^ np.uint64((order + 1) * SALT % 2**64)) >> np.uint64(3)
        first = np.lexsort((rank, owner))[place < np.repeat(room[sets], common[sets])]
        if order == 0:
            found = owner[first], token[first]
        else:
            maps.append(bitmap(owner[first], token[first], n, odd=False))
    return sets, *found, np.concatenate(maps, axis=1)


def _at(docs: DataFrame) -> Column:
    """What a text is found again by."""
    return F.xxhash64(docs["text"])


def whole_sets(docs: DataFrame, pairs: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """key, values (the whole set) and, of sets over COUNTED, counts by cell of each key in pairs (and of a few more).

    Which texts are looked into is sent as a bitmap of 16 MB at most; the others are read, but not cut into shingles.
    """
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = saved(sets.select("key", "at").join(keys, "key").select("at"), "join-wanted")
    bits = min(27, max(15, (8 * wanted.count()).bit_length()))
    place = F.pmod("at", F.lit(1 << bits)) + 1
    parts = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.toLocalIterator():
        bitmap[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["map"], np.uint8)
    dropped(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy().view(np.uint64) & np.uint64(8 * len(sent.value) - 1)
            yield batch.filter(pa.array((sent.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(hit(batches), PART):
            value, many, key = shingle_sets(part.column("text"), shingle)
            once = np.zeros(len(key), bool)
            once[np.unique(key, return_index=True)[1]] = True
            inner = value[np.repeat(once, many)].view(np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many[once])]), pa.array(inner)).cast(pa.list_(pa.int64()))
            counts = [cell_counts(own).tobytes() if len(own) > COUNTED else None for own, yes in zip(np.split(value, np.cumsum(many)[:-1]), once, strict=True) if yes]
            yield from pa.table({"key": pa.array(key[once].view(np.int64)), "values": lists, "counts": pa.array(counts, pa.binary())}).to_batches(256)

    found = docs.select("text", _at(docs).alias("at")).mapInArrow(run, "key long, values array<long>, counts binary")
    return found.groupBy("key").agg(F.any_value("values").alias("values"), F.any_value("counts").alias("counts"))


def _prefixed(docs: DataFrame, sketch: Sketch, shingle: int, over: int, under: int) -> DataFrame:
    """key, at (a hash of one of its texts), n, tokens (of the first order's prefix) and bitmaps w0 ... of each distinct set that may be similar to another."""
    names = [f"w{k}" for k in range(WORDS)]
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, PART):
            value, many, key = shingle_sets(part.column("text"), shingle)
            once = np.zeros(len(many), bool)
            once[np.unique(key, return_index=True)[1]] = True
            value, many, key = value[np.repeat(once, many)], many[once], key[once]
            which, owner, token, maps = prefixes(value, many, sent.value, over, under)
            sizes = np.bincount(owner, minlength=len(which))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(token.view(np.int64)))
            words = maps.view(np.int64)
            at = part.column("at").combine_chunks().filter(pa.array(once)).take(pa.array(which))
            out = pa.table([pa.array(key[which].view(np.int64)), at, pa.array(many[which].astype(np.int64)), lists, *(pa.array(words[:, k]) for k in range(WORDS))], ["key", "at", "n", "tokens", *names])
            yield from out.to_batches(4096)

    found = docs.select("text", _at(docs).alias("at")).mapInArrow(run, ", ".join(["key bigint, at bigint, n bigint, tokens array<bigint>", *(f"{x} bigint" for x in names)]))
    return found.dropDuplicates(["key"])


def _may_be_similar(a: str, b: str, over: int, under: int) -> tuple[Column, Column]:
    """Whether two sets (columns under a and b) may be similar, and the number of bits in which their parities differ."""
    col = lambda side, k: F.col(f"{side}.w{k}")
    apart = sum((F.bit_count(col(a, k).bitwiseXOR(col(b, k))) for k in range(1, WIDTH)), F.bit_count(col(a, 0).bitwiseXOR(col(b, 0))))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    may = (F.least(n, m) * under >= F.greatest(n, m) * over) & ((n + m) * (under - over) >= apart * (under + over))
    for order in range(1, ORDERS):
        shared = [col(a, order * WIDTH + k).bitwiseAND(col(b, order * WIDTH + k)) for k in range(WIDTH)]
        may &= sum((F.bit_count(x) for x in shared[1:]), F.bit_count(shared[0])) > 0
    return may, apart


def _with_hubs(members: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """Pairs (a, b): each set with the nearest of its tokens' hubs that it may be similar to. A token's hubs are its least and its greatest key."""
    hubs = members.groupBy("token").agg(F.array(F.min("key"), F.max("key")).alias("hubs"))
    pairs = members.join(hubs, "token").select(F.col("key").alias("a"), F.explode("hubs").alias("b")).where("a <> b").distinct()
    may, apart = _may_be_similar("x", "y", over, under)
    both = pairs.join(sets.alias("x"), F.col("a") == F.col("x.key")).join(sets.alias("y"), F.col("b") == F.col("y.key")).where(may)
    return both.groupBy("a").agg(F.min(F.struct(apart.alias("apart"), "b")).alias("near")).select(F.least("a", "near.b").alias("a"), F.greatest("a", "near.b").alias("b")).distinct()


def _labelled(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members with the component of each key, and the components (node, root)."""
    found = saved(connected_components(links), "join-components")
    return members.join(found, members["key"] == found["node"], "left").select("token", "key", F.coalesce("root", "key").alias("part")), found


def _dealt(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """The texts of tokens with several components, dealt to blocks: all as residents of one, those outside the largest component as visitors of all."""
    parts = members.groupBy("token", "part").agg(F.count("*").alias("size"))
    tokens = parts.groupBy("token").agg(F.sum("size").alias("all"), F.count("*").alias("parts"), F.max(F.struct("size", "part")).alias("largest"))
    open_ = tokens.where("parts > 1").select("token", F.ceil(F.col("all") / block).cast("int").alias("blocks"), F.col("largest.part").alias("main"))
    rows = members.join(open_, "token").select("token", "key", "part", (F.col("part") != F.col("main")).alias("minor"), "blocks")
    home = F.pmod(F.xxhash64("key", "token"), F.col("blocks")).cast("int")
    residents = rows.select("token", home.alias("block"), F.lit(0).alias("visits"), "key", "part", "minor")
    visitors = rows.where("minor").select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("visits"), "key", "part", "minor")
    return residents.unionByName(visitors).join(sets.drop("tokens", "at"), "key")


def near_in_block(own: dict[str, np.ndarray], other: dict[str, np.ndarray], partners: int, over: int, under: int) -> np.ndarray:
    """Rows a, b, more: visitors (own) with residents (other) of other components that they may be similar to.

    Of each component a visitor gets the nearest few; more: there are others. Between minor ones only the later key visits.
    """
    n, m = own["n"][:, None], other["n"][None, :]
    may = own["part"][:, None] != other["part"][None, :]
    may &= ~other["minor"][None, :] | (other["key"][None, :] < own["key"][:, None])
    may &= np.minimum(n, m) * under >= np.maximum(n, m) * over
    a, b = np.nonzero(may)
    for order in range(1, ORDERS):
        at = slice(order * WIDTH, (order + 1) * WIDTH)
        yes = (own["w"][a, at] & other["w"][b, at]).any(axis=1)
        a, b = a[yes], b[yes]
    apart = np.bitwise_count(own["w"][a, :WIDTH] ^ other["w"][b, :WIDTH]).sum(axis=1, dtype=np.int64)
    yes = (own["n"][a] + other["n"][b]) * (under - over) >= apart * (under + over)
    a, b, apart = a[yes], b[yes], apart[yes]
    by = np.lexsort((other["key"][b], apart, other["part"][b], a))
    a, b = a[by], b[by]
    if not len(a):
        return np.zeros((0, 3), np.int64)
    heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (other["part"][b[1:]] != other["part"][b[:-1]])])
    sizes = np.diff(np.r_[heads, len(a)])
    rank = np.arange(len(a)) - np.repeat(heads, sizes)
    more = np.repeat(sizes > partners, sizes)
    x, y = own["key"][a], other["key"][b]
    return np.stack([np.minimum(x, y), np.maximum(x, y), more], axis=1)[rank < partners].astype(np.int64)


def _candidates(dealt: DataFrame, partners: int, over: int, under: int) -> DataFrame:
    """a, b and more (1: the text has further candidates) from all blocks. Residents are held, visitors stream past them."""
    names = [f"w{k}" for k in range(WORDS)]
    rows = dealt.repartition("token", "block").sortWithinPartitions("token", "block", "visits").select("token", "block", "visits", "key", "part", "minor", "n", *names)

    def columns(batch: pa.RecordBatch, a: int, b: int) -> dict[str, np.ndarray]:
        get = lambda k: batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False)
        return {"key": get("key"), "part": get("part"), "minor": get("minor"), "n": get("n"), "w": np.stack([get(k).view(np.uint64) for k in names], axis=1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            place = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("token", "block", "visits")], axis=1)
            cuts = [*np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)]).tolist(), len(place)]
            found = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(place[a, :2].tolist())
                if here != now:
                    now, held = here, []
                if not place[a, 2]:
                    held.append(columns(batch, a, b))
                    continue
                if len(held) > 1:
                    held = [{k: np.concatenate([h[k] for h in held]) for k in held[0]}]
                for at in range(a, b, 512):
                    found.append(near_in_block(columns(batch, at, min(at + 512, b)), held[0], partners, over, under))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(3)], ["a", "b", "more"])

    return rows.mapInArrow(run, "a bigint, b bigint, more bigint").groupBy("a", "b").agg(F.max("more").alias("more"))


def verified(pairs: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. Of two large sets, the counts by cell go along first: the whole sets only with pairs that these leave."""
    x, y = sets.select(F.col("key").alias("a"), F.col("values").alias("x")), sets.select(F.col("key").alias("b"), F.col("values").alias("y"))
    p, q = (sets.select(F.col("key").alias(k), F.col("counts").alias(c), F.size("values").alias(n)) for k, c, n in (("a", "p", "n"), ("b", "q", "m")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            both = (batch.column("p").is_valid().to_numpy(zero_copy_only=False) & batch.column("q").is_valid().to_numpy(zero_copy_only=False)).nonzero()[0]
            for k in both.tolist():
                u, v = (np.frombuffer(batch.column(c)[k].as_py(), np.uint8).astype(np.int64) for c in ("p", "q"))
                keep[k] = (batch.column("n")[k].as_py() + batch.column("m")[k].as_py()) * (under - over) >= int(np.abs(u - v).sum()) * (under + over)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (p, q) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = p.values.to_numpy(), q.values.to_numpy()
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep[k] = under * same >= over * (len(p) + len(q) - same)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = pairs.select("a", "b").join(p, "a").join(q, "b").select("a", "b", "p", "q", "n", "m").mapInArrow(near, "a bigint, b bigint")
    return left.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def components(docs: DataFrame, total: int, shingle: int, over: int = OVER, under: int = UNDER, block: int = BLOCK, partners: int = PARTNERS) -> DataFrame | None:
    """node and root of all keys that are linked with another and are not their component's root; None where nothing may be linked."""
    sketch = token_sketch(docs, total, shingle)
    sets = saved(_prefixed(docs, sketch, shingle, over, under), "join-prefixes")
    spread = sets.select("key", F.explode("tokens").alias("token"))
    shared = spread.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    members = saved(spread.join(shared, "token").select("token", "key"), "join-members")
    if members.isEmpty():
        return None
    tried = saved(_with_hubs(members, sets, over, under), "join-tried")
    values = saved(whole_sets(docs, tried, sets, shingle), "join-sets")
    links = saved(verified(tried, values, over, under), "join-links")
    dropped(values)
    while True:
        labelled, found = _labelled(members, links)
        pairs = saved(_candidates(_dealt(labelled, sets, block), partners, over, under), "join-pairs")
        new = saved(pairs.join(tried, ["a", "b"], "left_anti"), "join-new")
        more = not pairs.where("more = 1").isEmpty()
        if new.isEmpty() and not more:
            break
        values = saved(whole_sets(docs, new, sets, shingle), "join-sets")
        good = verified(new, values, over, under)
        links, tried, before = saved(links.unionByName(good), "join-links"), saved(tried.unionByName(new.select("a", "b")), "join-tried"), (links, tried, pairs, new, values)
        for t in before:
            dropped(t)
        if not more:
            dropped(found)
            found = saved(connected_components(links), "join-components")
            break
        dropped(found)
        partners *= GROWTH
    for t in (sets, members, links, tried):
        dropped(t)
    return found


def jaccard_components(docs: DataFrame, keep: list[str] | None = None, shingle: int = 3, over: int = OVER, under: int = UNDER, block: int = BLOCK, partners: int = PARTNERS) -> DataFrame:
    """Every row of docs: doc_id and keep's columns, n_shingles and component_id.

    Two texts are linked if their sets of shingles have a Jaccard similarity of over / under or more; component_id is the
    smallest doc_id reached. Null, empty and blank texts have empty sets, which are linked with nothing, not even with each
    other; equal texts and repeated rows are linked; null doc_ids count for nothing (a component of nulls only has a null
    id); an empty table gives an empty result; other columns are not carried. A text is taken whole: a very long one
    takes some 60 times its bytes in a task.
    """
    keep = list(dict.fromkeys(["doc_id", *(keep or [])]))
    rows = docs.select(*keep, docs["text"].alias("text"))
    signed = saved(_signed(rows, keep, shingle), "join-signed")
    total = signed.agg(F.sum("n")).first()[0] or 0
    found = components(rows, total, shingle, over, under, block, partners)
    least = signed.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    root = F.col("key")
    if found is not None:
        least = least.join(found, least["key"] == found["node"], "left")
        root = F.coalesce("root", "key")
    least = least.select("key", "least", root.alias("root"))
    smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = least.join(smallest, "root").select(F.col("key").alias("_key"), "component_id")
    out = signed.join(whole, (signed["key"] == whole["_key"]) & (signed["n"] > 0), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(*keep, F.col("n").alias("n_shingles"), own.alias("component_id"))
