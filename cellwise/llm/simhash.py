"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments: of two fingerprints with at most three differing bits, one segment
differs by one bit at most. Each segment is indexed once per bit with that bit taken out, so such a pair shares a
signature; equal signatures are joined and the pairs verified. Only distinct fingerprints are indexed, and a bucket
of equal signatures gives links that connect what it holds, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import buffers, chunked, saved
from cellwise.llm.near_copies import without_near_copies

BITS, SEGMENT = 64, 32
#: Spark's xxhash64 has the same seed.
SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):  # a long text in parts
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3) -> DataFrame:
    """keep's columns and fp (long, the bits as signed) of every row; null text has no words."""
    rows = docs.select(*keep, docs["text"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, 1 << 23):
            data, offsets = buffers(part.column("_text"))
            data, ends = data.tobytes(), offsets.tolist()
            fps = np.array([fingerprint(data[a:b], shingle) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.uint64)
            yield from part.select(keep).append_column("fp", pa.array(fps.view(np.int64))).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.select(*keep).schema.add("fp", "long"))


def signatures(fp: Column) -> Column:
    """The deletion variants: for each segment and bit, the segment without the bit, marked with which it is."""
    out = []
    for segment in range(BITS // SEGMENT):
        part = F.shiftrightunsigned(fp, segment * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1))
        for bit in range(SEGMENT):
            cleared = part.bitwiseAND(F.lit(((1 << SEGMENT) - 1) ^ (1 << bit)))
            out.append(cleared + F.lit((segment * SEGMENT + bit) << SEGMENT))
    return F.array(*out)


def _roots(link: np.ndarray) -> np.ndarray:
    while True:
        up = link[link]
        if (up == link).all():
            return link
        link = up


def connect(values: np.ndarray, distance: int) -> np.ndarray:
    """Index, for each of the distinct values, of one that stands for all it reaches inside values.

    A pivot takes everything within the distance at once; what is left gets further pivots. Two pivots' parts are
    compared only if they lie near enough to touch and are not joined yet, in blocks, until a touch is found.
    """
    n = len(values)
    if n <= 64:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
        label = np.arange(n)
        while True:
            low = np.where(near, label[None, :], n).min(axis=1)
            if (low == label).all():
                return label
            label = low
    free = np.arange(n)
    parts, pivots = [], []
    while len(free):
        near = np.bitwise_count(values[free] ^ values[free[0]]) <= distance
        parts.append(free[near])
        pivots.append(free[0])
        free = free[~near]
    top = values[np.array(pivots)]
    link = np.arange(len(parts))
    for a in range(1, len(parts)):
        gaps = np.bitwise_count(top[:a] ^ top[a])
        for b in np.argsort(gaps, kind="stable").tolist():
            if gaps[b] > 3 * distance:
                break
            ra, rb = a, b
            while link[ra] != ra:
                ra = link[ra]
            while link[rb] != rb:
                rb = link[rb]
            if ra != rb and _touch(values[parts[a]], values[parts[b]], distance):
                link[max(ra, rb)] = min(ra, rb)
    link = _roots(link)
    out = np.empty(n, np.int64)
    for k, part in enumerate(parts):
        out[part] = pivots[link[k]]
    return out


def _touch(a: np.ndarray, b: np.ndarray, distance: int) -> bool:
    step = max(1, (1 << 18) // max(1, len(b)))
    return any((np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= distance).any() for i in range(0, len(a), step))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of fingerprints that join what lies within distance, from distinct fps: fewer pairs than fingerprints in a bucket."""
    # Each row becomes 64: dealt to a fixed number of tasks, lest the small input be coalesced into a few. By a hash of
    # fp, as a repartition by fp itself is left out as redundant where fps comes from an aggregate over fp.
    dealt = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    spread = dealt.select("fp", F.explode(signatures(F.col("fp"))).alias("sig"))
    buckets = spread.groupBy("sig").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.asarray(column.value_lengths())
            starts = np.cumsum(sizes) - sizes
            found = []
            two = starts[sizes == 2]
            a, b = values[two], values[two + 1]
            near = np.bitwise_count(a ^ b) <= distance
            found.append((a[near], b[near]))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = values[s : s + n]
                to = connect(own, distance)
                other = to != np.arange(n)
                found.append((own[other], own[to[other]]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return buckets.mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root, the smallest node it reaches, for each node of the edges (a, b).

    Alternating large-star and small-star rounds (Kiveris et al., 2014); each round is written to the shared folder.
    """

    def star(e: DataFrame, both: bool) -> DataFrame:
        """large (both): every node's larger neighbours move to its smallest; small: its smaller ones."""
        sides = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if both:
            least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            moved = sides.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            moved = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
        return moved.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = saved(edges.where("a <> b"), name)
    before = state(now)
    while before[0]:
        now = saved(star(star(now, True), False), name)
        after = state(now)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.groupBy("node").agg(F.min("root").alias("root"))


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, shingle: int = 3, distance: int = 3) -> DataFrame:
    """Every row of docs: keep's columns, doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id among the documents reached over links. Null doc_ids count for nothing there (a
    component of nulls only has a null id); null, empty and blank texts have fingerprint zero and are linked like others;
    repeated rows stay and share their id; an empty table gives an empty result; other columns are not carried.
    """
    keep = list(dict.fromkeys(["doc_id", *(keep or [])]))
    prints = saved(fingerprints(docs, keep, shingle), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(least.select("fp"), distance))
    # Roots are nodes without a row of their own.
    rooted = least.join(found, least["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # An aggregate and a join, which AQE can split, rather than a window that holds a large component in one task.
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = rooted.join(smallest, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(whole, "fp").select(*keep, text, "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs with one row of each group of near copies: of a Jaccard similarity of 0.8 or more, verified (see near_copies)."""
    return without_near_copies(docs, shingle)
