"""Helpers shared by the operators: intermediate tables, Arrow text buffers, vectorised hashing."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.operators.lineage import dropped, fresh_path, saved, shared_dir

__all__ = ["dropped", "fresh_path", "saved", "shared_dir"]

#: Null ids sort after every other id.
NO_ID = 2**63 - 1


def may_be_in(rows: DataFrame, found: DataFrame, on: list[str], most_bits: int = 27) -> DataFrame:
    """rows with _may: false where found has certainly no row of the same keys.

    Read from a bitmap of hashed keys, eight bits a row of found and 2**most_bits bits (16 MB) at most, which is broadcast.
    """
    bits = min(most_bits, max(15, (8 * found.count()).bit_length()))
    place = F.pmod(F.xxhash64(*on), F.lit(1 << bits)) + 1
    maps = found.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_map"))
    marked = rows.withColumn("_p", F.bitmap_bit_position(place)).withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(_map, CAST(_p DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    may = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("_p") % 8)) % 2 == 1, F.lit(False))
    return marked.withColumn("_may", may).drop("_p", "_bucket", "_map")


def joined_by_key(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """rows left-joined with found (on and spans), where most rows have no match: only rows that may have one are shuffled."""
    marked = may_be_in(rows, found, on)
    kind = found.schema["spans"].dataType
    return marked.where("_may").join(found, on, "left").drop("_may").unionByName(marked.where("NOT _may").withColumn("spans", F.lit(None).cast(kind)).drop("_may"))


def packed(docs: DataFrame) -> DataFrame:
    """docs as _doc (a struct of all its columns), doc_id and text: what a column is called can't clash with a name used here."""
    return docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")


def unpacked(rows: DataFrame, *more: str) -> DataFrame:
    """The columns inside _doc again, and more; a column of the same name gives way to one of more."""
    own = [f.name for f in rows.schema["_doc"].dataType.fields]
    return rows.select(*[F.col(f"_doc.`{c}`").alias(c) for c in own if c not in more], *more)


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """df's schema with further columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_id(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def text_key(col: str = "text") -> Column:
    """64 bits that, with the doc_id, tell rows apart whose doc_id is null or repeated; texts with both equal are one text."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the strings of each row, and a few for the rest of it."""
    out = np.full(batch.num_rows, 16, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            out += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return out


def chunked(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Batches joined, or cut between rows, to tables of at most most_bytes of strings; a longer row is a table of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.r_[0, np.cumsum(_row_bytes(batch))]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + most_bytes - size, side="right")) - 1
            if to <= at and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            to = max(to, at + 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to] - ends[at])
            at = to
    if held:
        yield pa.Table.from_batches(held)


def buffers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one array of bytes and the offsets of its rows; null is empty."""
    kind = pa.large_binary()
    array = pa.concat_arrays([pc.fill_null(c.cast(kind), b"") for c in column.chunks]) if column.num_chunks else pa.array([], kind)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(array) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def ints(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False) if column.num_chunks else np.zeros(0, np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit changes about half the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Places of a byte whose random bits are looked up; further ones are worked out.
PLACES = 128


@functools.cache
def _place_table(seed: int) -> np.ndarray:
    return _mixed(np.arange(PLACES << 8, dtype=np.uint64), seed)


def _mixed(at: np.ndarray, seed: int) -> np.ndarray:
    return mix64((at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed))


def placed(data: np.ndarray, place: np.ndarray, *seeds: int) -> list[np.ndarray]:
    """For each seed 64 random bits for each byte at its place; their sum is a hash of the bytes. (Powers of a base would give
    texts of two letters in the Thue-Morse order, of 1,024 bytes and more, the same sum.)
    """
    at = place << 8
    at |= data
    late = np.flatnonzero(place >= PLACES)
    if not len(late):
        return [_place_table(seed)[at] for seed in seeds]
    further = at[late].astype(np.uint64)
    at[late] = 0
    out = [_place_table(seed)[at] for seed in seeds]
    for values, seed in zip(out, seeds, strict=True):
        values[late] = _mixed(further, seed)
    return out


#: Bytes that split words at ASCII white space, and at ASCII characters that are no letter or digit.
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the offsets of the rows in words; about a megabyte of text at a time.

    Two different words have equal hashes with a chance of 2**-64: in 10**10 different words about three such pairs.
    """
    hashes, rows, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for a, b in row_groups(offsets):
        own = data[offsets[a] : offsets[b]]
        if b > a + 1:
            found, ends = _words(own, offsets[a : b + 1] - offsets[a], is_word)
            ends = ends[1:]
        else:
            found = np.concatenate([np.zeros(0, np.uint64), *(_words(piece, np.array([0, len(piece)]), is_word)[0] for piece in word_pieces(own, is_word))])
            ends = np.array([len(found)])
        hashes.append(found)
        rows.append(ends + n)
        n += len(found)
    return np.concatenate(hashes), np.concatenate(rows)


#: Bytes of text whose words are worked out at once.
PIECE = 1 << 20


def row_groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PIECE bytes."""
    cuts = np.unique(np.searchsorted(offsets, np.arange(0, offsets[-1] + 1, PIECE)))
    cuts = np.unique(np.r_[0, cuts[cuts < len(offsets) - 1], len(offsets) - 1]).tolist()
    return zip(cuts[:-1], cuts[1:], strict=True)


def word_pieces(data: np.ndarray, is_word: np.ndarray) -> Iterator[np.ndarray]:
    """One text in pieces of about PIECE bytes, cut between words."""
    at = 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data):
            gap = np.flatnonzero(~is_word[data[to : to + 4096]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + 4096, len(data))
        yield data[at:to]
        at = to


def token_blocks(batches: Iterator[pa.RecordBatch], most_bytes: int, is_word: np.ndarray, overlap: int, fold: np.ndarray | None = None) -> Iterator[tuple[pa.Table, Iterator]]:
    """Parts of rows with a _text, each with its blocks: hashes of words, the rows' offsets in them, words of the row before the block.

    A part is one block, but for a single text of over most_bytes: that has blocks of about PIECE words, of which each
    begins with the last overlap words of the one before. fold maps bytes first.
    """
    for part in chunked(batches, most_bytes):
        yield part, _token_blocks(part, most_bytes, is_word, overlap, fold)


def _token_blocks(part: pa.Table, most_bytes: int, is_word: np.ndarray, overlap: int, fold: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    data, offsets = buffers(part.column("_text"))
    if len(data) <= most_bytes:
        yield *words(data if fold is None else fold[data], offsets, is_word), 0
        return
    held, have, base = [], 0, 0
    for piece in word_pieces(data, is_word):
        held.append(_words(piece if fold is None else fold[piece], np.array([0, len(piece)]), is_word)[0])
        have += len(held[-1])
        if have >= PIECE + overlap:
            tokens = np.concatenate(held)
            yield tokens, np.array([0, have]), base
            base += have - overlap
            held, have = [tokens[have - overlap :]], overlap
    yield np.concatenate(held), np.array([0, have]), base


def _words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    kept = data[inside]
    heads = np.cumsum(inside, dtype=np.int64)[starts] - 1
    sizes = np.diff(np.append(heads, len(kept)))
    total = np.zeros(len(starts), np.uint64)
    for at in range(0, len(kept), 2 * PIECE):  # more than once for a word of that length only
        own = kept[at : at + 2 * PIECE]
        here = slice(int(np.searchsorted(heads, at, side="right")) - 1, int(np.searchsorted(heads, at + len(own))))
        cut = np.maximum(heads[here] - at, 0)
        place = np.arange(at, at + len(own)) - np.repeat(heads[here], np.diff(np.append(cut, len(own))))
        total[here] += np.add.reduceat(placed(own, place, 0x2545F4914F6CDD1D)[0], cut)
    return mix64(total + sizes.astype(np.uint64)), rows


def rolling(x: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of x[i : i + size] for each i, by doubling; x is uint64."""
    if len(x) < size:
        return np.zeros(0, np.uint64)
    out, have, at = None, 0, x
    width = 1
    while width <= size:
        if size & width:  # at[i] covers width items from i
            if out is None:
                out, have = at, width
            else:
                n = len(x) - have - width + 1
                out, have = at[:n] * np.uint64(pow(base, have, 2**64)) + out[width : width + n], have + width
        if width * 2 <= size:
            n = len(at) - width
            at = at[:n] * np.uint64(pow(base, width, 2**64)) + at[width:]
        width *= 2
    return mix64(out)


def lowest(key: np.ndarray, span: int) -> np.ndarray:
    """Minimum of key[i : i + span] for each i."""
    n = len(key) - span + 1
    if n <= 0:
        return key[:0]
    width = 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    return np.minimum(key[:n], key[span - width : span - width + n])


def spread_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of all ranges starts[i] .. starts[i] + sizes[i] - 1, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)
