"""Media columns: baseline JPEG.

write_media stores bytes losslessly in the quantised coefficients of a grey baseline JPEG: each byte is the eight extra
bits of a coefficient of size category 8, blocks are restart intervals. read_media reads any baseline (SOF0) JPEG: it
parses the markers, Huffman-decodes the scans of many images at once (each restart interval is a lane; all lanes take one
symbol a step), and makes the DC-only luminance thumbnail with its hash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import buffers, chunked, extended, spread_ranges

UNIT, BLOCK = 576, 64
#: Blocks in the longest side that a baseline JPEG can have.
MOST_BLOCKS = 65528 // 8
CHUNK = 1 << 19


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: One Huffman code, the bit 0, for size category 8 (and no zero run).
TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + b"".join(_segment(0xC4, bytes([kind, 1, *[0] * 15, 8])) for kind in (0x00, 0x10))


def _header(n_bytes: int, payload: int, wide: int, high: int) -> bytes:
    """Everything up to the scan; the comment holds the lengths of the bytes and of the padded payload."""
    return (
        b"\xff\xd8"
        + _segment(0xFE, b"payload " + struct.pack(">QQ", n_bytes, payload))
        + TABLES
        + _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\1\x11\0")
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def encode(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A JPEG of each range of data, padded with 255 to a positive multiple of UNIT."""
    sizes = np.diff(offsets)
    units = np.maximum(1, -(-sizes // UNIT))
    wide = 3 * -(-units // (MOST_BLOCKS // 3))
    high = -(-units * 9 // wide)
    blocks = wide * high
    padded = np.full(int(blocks.sum()) * BLOCK, 255, np.uint8)
    heads = np.cumsum(blocks) - blocks
    padded[spread_ranges(heads * BLOCK, sizes)] = data
    bits = np.zeros((len(padded), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(padded).reshape(-1, 8)
    scan = np.packbits(bits.reshape(-1))  # 64 coefficients of 9 bits are 72 whole bytes
    stuffed = np.cumsum(scan == 255) - (scan == 255)
    block = np.arange(len(scan)) // 72
    out = np.zeros(len(scan) + int((scan == 255).sum()) + 2 * (len(scan) // 72), np.uint8)
    out[np.arange(len(scan)) + stuffed + 2 * block] = scan
    ends = np.r_[(np.arange(72, len(scan), 72) + stuffed[72::72]), [len(scan) + int((scan == 255).sum())]] + 2 * np.arange(len(scan) // 72)
    own = np.arange(len(ends)) - np.repeat(heads, blocks)
    out[ends] = 255
    out[ends + 1] = 0xD0 + own % 8
    last = heads + blocks - 1
    out[ends[last] + 1] = 0xD9
    scans, stops = out.tobytes(), (ends[last] + 2).tolist()
    rows = zip(sizes.tolist(), (units * UNIT).tolist(), wide.tolist(), high.tolist(), [0, *stops[:-1]], stops, strict=True)
    return [_header(n, p, w, h) + scans[a:b] for n, p, w, h, a, b in rows]


@dataclass
class Image:
    """What the markers say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantisation table
    quant: dict[int, bytes] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)  # class << 4 | id: code lengths' counts and symbols
    restart: int = 0
    comment: bytes = b""
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's index, DC table, AC table
    start: int = 0


def parse(data: bytes) -> Image:
    """The segments up to the first scan. ValueError if this is no baseline JPEG."""
    image, at = Image(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 255:
            raise ValueError("no marker")
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                width = 64 << (body[0] >> 4)
                image.quant[body[0] & 15], body = body[1 : 1 + width], body[1 + width :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                image.tables[body[0]], body = body[1:n], body[n:]
        elif kind == 0xC0:
            depth, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if depth != 8 or not image.width or not image.height or any(not h or not v for _, h, v, _ in image.components):
                raise ValueError("samples are not of eight bits, or there are none")
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif kind == 0xDD:
            image.restart = int.from_bytes(body, "big")
        elif kind == 0xFE:
            image.comment = image.comment or body
        elif kind == 0xDA:
            index = {c[0]: k for k, c in enumerate(image.components)}
            image.scan = [(index[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            image.start = at
            return image


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0 where no code begins so."""
    out, code, symbols = np.zeros(1 << 16, np.uint32), 0, iter(table[16:])
    for length, n in enumerate(table[:16], 1):
        for _ in range(n):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | next(symbols)
            code += 1
        code <<= 1
    return out


def _layout(image: Image) -> tuple[list[int], int]:
    """The scan component of each block of an MCU, and the number of MCUs."""
    if len(image.scan) == 1:
        _, h, v, _ = image.components[image.scan[0][0]]
        most_h, most_v = max(c[1] for c in image.components), max(c[2] for c in image.components)
        wide, high = -(-image.width * h // most_h), -(-image.height * v // most_v)
        return [0], -(-wide // 8) * -(-high // 8)
    pattern = [k for k, (c, _, _) in enumerate(image.scan) for _ in range(image.components[c][1] * image.components[c][2])]
    most_h, most_v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    return pattern, -(-image.width // (8 * most_h)) * -(-image.height // (8 * most_v))


def huffman_decode(data: np.ndarray, lane_start: np.ndarray, lane_stop: np.ndarray, lane_blocks: np.ndarray, pattern: list[int], dc: list[np.ndarray], ac: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (blocks of all lanes, in zigzag order) and whether each lane was sound.

    data: scans without stuffing and markers; a lane begins at a byte, has so many blocks and predicts its DC values on its own.
    """
    padded = np.r_[data, np.full(8, 255, np.uint8)].astype(np.uint32)
    ahead = padded[:-3] << np.uint32(24) | padded[1:-2] << np.uint32(16) | padded[2:-1] << np.uint32(8) | padded[3:]
    luts = np.concatenate([*dc, *ac])
    pattern_ = np.array(pattern)
    total = int(lane_blocks.sum())
    coef = np.zeros((BLOCK, total), np.int32)  # a step writes one line of it, mostly
    sound = np.ones(len(lane_start), bool)
    first = np.cumsum(lane_blocks) - lane_blocks
    lane = np.flatnonzero(lane_blocks > 0)
    pos, k, block = lane_start[lane] * 8, np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    predicted = np.zeros((len(lane_start), len(dc)), np.int64)
    while len(lane):
        part = pattern_[block % len(pattern)]
        is_dc = k == 0
        base = (part + np.where(is_dc, 0, len(dc))) << 16
        shift = (pos & 7).astype(np.uint32)
        peek = ahead[np.minimum(pos >> 3, len(ahead) - 1)] << shift >> np.uint32(16)
        entry = luts[base + peek]
        symbol = (entry & 255).astype(np.int64)
        pos = pos + (entry >> 8)
        run, size = np.where(is_dc, 0, symbol >> 4), np.where(is_dc, symbol, symbol & 15)
        shift = (pos & 7).astype(np.uint32)
        window = ahead[np.minimum(pos >> 3, len(ahead) - 1)] << shift
        extra = (window.astype(np.uint64) >> (32 - size).astype(np.uint64)).astype(np.int64)
        pos = pos + size
        value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
        bad = (entry == 0) | (size > 15) | (pos > lane_stop[lane] * 8)
        stop = ~is_dc & (size == 0) & (run < 15)
        at = k + run
        bad |= ~stop & (at >= BLOCK)
        if is_dc.any():
            who = lane[is_dc], part[is_dc]
            predicted[who] += value[is_dc]
            value[is_dc] = predicted[who]
        put = (is_dc | (size > 0)) & ~bad
        if put.all():
            coef[at, first[lane] + block] = value
        else:
            coef[at[put], (first[lane] + block)[put]] = value[put]
        k = np.where(stop, BLOCK, at + 1)
        ended = k >= BLOCK
        if ended.any() or bad.any():
            block = block + ended
            k[ended] = 0
            sound[lane[bad]] = False
            go = (block < lane_blocks[lane]) & ~bad
            lane, pos, k, block = lane[go], pos[go], k[go], block[go]
    return np.ascontiguousarray(coef.T), sound


def decode_many(media: list[bytes | None]) -> list[tuple[Image, np.ndarray] | None]:
    """Markers and coefficients (blocks in scan order, zigzag order inside) of each image; None if it can't be read."""
    images: list[Image | None] = []
    for data in media:
        try:
            images.append(parse(data or b""))
        except (ValueError, IndexError, KeyError, struct.error):
            images.append(None)
    out: list[tuple[Image, np.ndarray] | None] = [None] * len(media)
    groups: dict[tuple, list[int]] = {}
    for n, image in enumerate(images):
        if image and all(d in image.tables and 16 + a in image.tables for _, d, a in image.scan) and len(image.scan) == len({c for c, _, _ in image.scan}) > 0:
            key = tuple(_layout(image)[0]), tuple(image.tables[d] for _, d, _ in image.scan), tuple(image.tables[16 + a] for _, _, a in image.scan)
            groups.setdefault(key, []).append(n)
    for (pattern, dc, ac), members in groups.items():
        scans = [np.frombuffer(media[n], np.uint8)[images[n].start :] for n in members]
        sizes = np.array([len(s) for s in scans])
        raw = np.r_[np.concatenate(scans), np.uint8(0)]
        heads = np.cumsum(sizes) - sizes
        marks = np.flatnonzero(raw[:-1] == 255)
        after = raw[marks + 1]
        drop = np.zeros(len(raw), bool)
        drop[marks[after == 0] + 1] = True
        restarts = marks[(after >= 0xD0) & (after <= 0xD7)]
        drop[restarts] = drop[restarts + 1] = True
        drop[-1] = True
        stops = marks[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7))]
        at = np.searchsorted(stops, heads)
        ends = np.minimum(np.append(stops, len(raw) - 1)[np.minimum(at, len(stops))], heads + sizes)
        left = np.r_[0, np.cumsum(~drop)]
        starts, lasts, blocks, of = [], [], [], []
        for i, n in enumerate(members):
            mcus = _layout(images[n])[1]
            cut = restarts[np.searchsorted(restarts, heads[i]) : np.searchsorted(restarts, ends[i])] + 2
            step = images[n].restart or mcus
            lanes = -(-mcus // step)
            if lanes - 1 > len(cut):
                images[n] = None
                continue
            own = np.r_[heads[i], cut[: lanes - 1]]
            starts.append(left[own])
            lasts.append(left[np.r_[cut[: lanes - 1], ends[i]]])
            blocks.append(np.minimum(step, mcus - step * np.arange(lanes)) * len(pattern))
            of.append(np.full(lanes, i))
        if not starts:
            continue
        start, last, count, of = map(np.concatenate, (starts, lasts, blocks, of))
        coef, sound = huffman_decode(raw[~drop], start, last, count, list(pattern), [lookup(t) for t in dc], [lookup(t) for t in ac])
        of_block = np.searchsorted(of, np.arange(len(members) + 1))
        block = np.r_[0, np.cumsum(count)][of_block]
        good = np.bincount(of, ~sound, len(members)) == 0
        for i, n in enumerate(members):
            if images[n] and good[i]:
                out[n] = images[n], coef[block[i] : block[i + 1]]
    return out


def thumbnail(image: Image, coef: np.ndarray) -> np.ndarray:
    """Luminance of each 8x8 block from its DC coefficient alone: one sample a block, 0 to 255."""
    index, _, _ = image.scan[0]
    _, h, v, table = image.components[index]
    pattern, _ = _layout(image)
    own = coef.reshape(-1, len(pattern), BLOCK)[:, np.array(pattern) == 0, 0]
    if len(pattern) == 1:
        wide = -(-(-(-image.width * h // max(c[1] for c in image.components))) // 8)
        grid = own.reshape(-1, wide)
    else:
        wide = -(-image.width // (8 * max(c[1] for c in image.components)))
        grid = own.reshape(-1, wide, v, h).transpose(0, 2, 1, 3).reshape(-1, wide * h)
    quant = image.quant.get(table, b"\1")
    step = int.from_bytes(quant[:2], "big") if len(quant) == 128 else quant[0]
    return np.clip(np.rint(grid * step / 8 + 128), 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 8x8 areas of the thumbnail are brighter than their mean."""
    table = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    table[1:, 1:] = thumb.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    a = [np.minimum(np.arange(8) * n // 8, n - 1) for n in thumb.shape]
    b = [np.maximum(np.arange(1, 9) * n // 8, lo + 1) for n, lo in zip(thumb.shape, a, strict=True)]
    area = table[b[0]][:, b[1]] - table[a[0]][:, b[1]] - table[b[0]][:, a[1]] + table[a[0]][:, a[1]]
    area = area / np.outer(b[0] - a[0], b[1] - a[1])
    return np.packbits(area > area.mean()).tobytes().hex()


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary) of every row: the text's UTF-8 in a JPEG; null is empty. Other columns are not carried."""
    rows = docs.select("doc_id", docs["text"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, CHUNK):
            media = encode(*buffers(part.column("_text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array(media, pa.binary())], ["doc_id", "media"])

    return rows.mapInArrow(run, extended(docs.select("doc_id"), "media binary"))


FIELDS = (
    ("n_bytes", pa.int64()),
    ("payload_bytes", pa.int64()),
    ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()),
    ("width", pa.int32()),
    ("height", pa.int32()),
    ("thumb_hash", pa.string()),
)


def _read(data: bytes | None, found: tuple[Image, np.ndarray] | None) -> tuple:
    stored = (len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
    if found is None:
        return None, None, None, None, *stored, None, None, None
    image, coef = found
    payload = (None,) * 4
    if image.comment[:8] == b"payload " and len(image.comment) == 24:
        n, size = struct.unpack(">QQ", image.comment[8:])
        flat = coef.reshape(-1)[:size]
        own = np.where(flat < 0, flat + 255, flat).astype(np.uint8).tobytes()
        payload = n, len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:])
    return *payload, *stored, image.width, image.height, average_hash(thumbnail(image, coef))


def read_media(rows: DataFrame, column: str = "media") -> DataFrame:
    """doc_id and what is read from each row's JPEG: sizes, hashes, dimensions, thumbnail hash.

    Payload columns are null for images not made by write_media; all but the stored form's are null for what is no sound
    baseline JPEG; everything is null for null. Repeated rows stay; an empty table gives an empty result.
    """
    own = rows.select("doc_id", rows[column].alias("_media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, CHUNK):
            media = part.column("_media").to_pylist()
            found = [_read(data, image) for data, image in zip(media, decode_many(media), strict=True)]
            columns = [pa.array(list(c), kind) for c, (_, kind) in zip(zip(*found, strict=True), FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), *columns], ["doc_id", *(n for n, _ in FIELDS)])

    ddl = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumb_hash string"
    return own.mapInArrow(run, extended(rows.select("doc_id"), ddl))


def store_and_read(docs: DataFrame) -> DataFrame:
    """write_media, then read_media, with the feature: dimensions and thumbnail hash."""
    feature = F.format_string("%dx%d:%s", "width", "height", "thumb_hash")
    return read_media(write_media(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
