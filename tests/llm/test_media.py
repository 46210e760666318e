import hashlib
import struct
import zlib

import numpy as np

from cellwise.llm import media


def pad(text):
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % 576 if data else 576)


def test_round_trip(odd_docs, rows_of, no_docs):
    expected = sorted((i is None, i or 0, len((t or "").encode()), len(pad(t)), hashlib.sha256(pad(t)).hexdigest(), zlib.crc32(pad(t)[-32:])) for i, t in rows_of)
    found = media.store_and_read(odd_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == expected
    assert media.store_and_read(no_docs).count() == 0
    by_payload = {}
    for r in found:
        assert by_payload.setdefault((r.n_bytes, r.payload_sha256), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_broken_media(spark, rows_of):
    good = bytes(media.encode(np.frombuffer(b"x" * 900, np.uint8), np.array([0, 900]))[0])
    rows = [(1, None), (2, b""), (3, b"\xff\xd8"), (4, good[:-300]), (5, good[:60]), (6, good), (7, b"GIF89a")]
    found = {r.doc_id: r for r in media.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert found[1].media_bytes is None and found[2].media_bytes == 0
    assert all(found[k].width is None and found[k].payload_sha256 is None for k in (1, 2, 3, 4, 5, 7))
    assert (found[6].n_bytes, found[6].width, found[6].height) == (900, 24, 48)


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, size):
        self.text += format(value, f"0{size}b") if size else ""

    def number(self, value, size):
        self.put(value if value > 0 else value + (1 << size) - 1, size)

    def data(self):
        text = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def test_a_plain_jpeg_with_runs_and_no_restarts():
    """Codes of several lengths, DC prediction, zero runs and ends of blocks; three components with subsampling."""
    lengths = [0, 1, 2, 2] + [0] * 12  # codes 00, 010, 011, 1000, 1001
    codes = {0: (0, 2), 1: (2, 3), 2: (3, 3), 3: (8, 4), 4: (9, 4)}
    dc = bytes(lengths) + bytes([0, 3, 5, 6, 8])
    ac = bytes(lengths) + bytes([0x00, 0x02, 0xF0, 0x13, 0x05])
    dc_code, ac_code = ({s: codes[k] for k, s in enumerate(t[16:])} for t in (dc, ac))
    rng = np.random.default_rng(4)
    order = [0, 0, 0, 0, 1, 2]  # 2x2 luminance blocks, one of each chrominance
    mcus, blocks, bits, last = 4, [], Bits(), [0, 0, 0]
    for _ in range(mcus):
        for c in order:
            block = [0] * 64
            size = int(rng.choice([0, 3, 5]))
            gap = 0 if not size else int(rng.choice([-1, 1])) * ((1 << size) - 1 - int(rng.integers(0, 2)))
            last[c] += gap
            block[0] = last[c]
            bits.put(*dc_code[size])
            bits.number(gap, size)
            at = 1
            while at < 64:
                kind = int(rng.choice([0x00, 0x02, 0xF0, 0x13, 0x05]))
                if kind == 0 or at + (16 if kind == 0xF0 else (kind >> 4)) >= 64:
                    bits.put(*ac_code[0x00])
                    break
                bits.put(*ac_code[kind])
                if kind == 0xF0:
                    at += 16
                    continue
                at += kind >> 4
                value = int(rng.choice([-1, 1])) * (1 << ((kind & 15) - 1))
                bits.number(value, kind & 15)
                block[at] = value
                at += 1
            blocks.append(block)
    seg = media._segment
    frame = struct.pack(">BHHB", 8, 20, 30, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    scan = bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    image = b"\xff\xd8" + seg(0xDB, b"\0" + b"\2" * 64) + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xC0, frame) + seg(0xDA, scan) + bits.data() + b"\xff\xd9"
    parsed, coef = media.decode_many([image])[0]
    assert coef.tolist() == blocks
    thumb = media.thumbnail(parsed, coef)
    assert thumb.shape == (4, 4)
    luma = [b[0] for b, c in zip(blocks, order * mcus, strict=True) if c == 0]
    assert thumb[0, :2].tolist() == [int(np.clip(np.rint(v * 2 / 8 + 128), 0, 255)) for v in luma[:2]]
    assert thumb[1, :2].tolist() == [int(np.clip(np.rint(v * 2 / 8 + 128), 0, 255)) for v in luma[2:4]]
