"""WARC archives with a two-level capture index.

An archive is a table of gzip members, one per record, with their offsets: its records' bytes in order are the .warc.gz
file. Spark writes and reads it, so no task needs a path that only the driver can open. The index sorts captures by
reversed-host URL key into compressed blocks; a sparse directory holds each block's first key. A look-up
binary-searches the directory, then the one block; the ranges found there are read by a join with the records' table, on archive, offset
and length.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm.common import fresh_path, order_id

#: Bytes of an archive, after which the next begins; captures of an index block.
ARCHIVE_BYTES, BLOCK_LINES = 64 << 20, 512
#: Payloads of fewer bytes are always written out.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 8


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: com,example,www)/path?query. The scheme, port, user and fragment go."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1)), ":[0-9]*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to: of equal payloads of LEAST_REVISIT bytes or more the smallest page_id is the response.

    refers_to is that page_id for the others. Counts are aggregated before any join, and the join is salted: a payload
    that a third of the pages share is dealt to SALTS tasks.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), order_id("page_id").alias("_id"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "url"), F.lit(SALTS)).cast("int"))
    large = rows.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    salted = large.select("digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = rows.join(salted, ["digest", "_salt"], "left")
    refers = F.when(F.col("_first") < F.col("_id"), F.col("_first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed. The HTTP head keeps the payload's length also where the payload is left out."""
    body = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, payload digest, record type, refers_to of a record; the payload of a response is hashed anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")))
    told = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    own = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    if fields["WARC-Type"] == "revisit":
        return int(own) if own else None, size, told, "revisit", int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
    if len(body) != size or (digest := hashlib.sha256(body).hexdigest()) != told:
        raise ValueError("the payload is not what its headers say")
    return int(own) if own else None, size, digest, "response", None


@dataclass(frozen=True)
class Archive:
    """Where the archives, the index's blocks and its directory are."""

    path: str

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("offset long, length long, key string, record binary, archive string").parquet(f"{self.path}/records")

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("part int, block int, first_key string, n int, data binary").parquet(f"{self.path}/blocks")


def write_archives(pages: DataFrame, path: str) -> Archive:
    """Writes a record per row of pages (null html: empty; null url: an empty key) and the index of all captures."""
    marked = mark_revisits(pages).withColumn("key", url_key(F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, offset = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            names, offsets, sizes, datas = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))
            for row in zip(*columns, strict=True):
                gz = zlib.compressobj(6, wbits=31)
                data = gz.compress(record(*row)) + gz.flush()
                if offset and offset + len(data) > ARCHIVE_BYTES:
                    n, offset = n + 1, 0
                names.append(f"{part:06d}-{n:05d}.warc.gz")
                offsets.append(offset)
                sizes.append(len(data))
                datas.append(data)
                offset += len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), batch.column("key"), pa.array(datas, pa.binary())],
                ["archive", "offset", "length", "key", "record"],
            )

    made = marked.mapInArrow(run, "archive string, offset long, length long, key string, record binary")
    made.sortWithinPartitions("archive", "offset").write.partitionBy("archive").parquet(f"{path}/records")
    archive = Archive(path)
    write_index(archive.records(pages.sparkSession).select("key", "archive", "offset", "length"), path)
    return archive


def write_index(captures: DataFrame, path: str) -> None:
    """Captures in key order, cut into compressed blocks: part, block, first_key, n, data.

    Ties of a key go by archive and offset, so one host's or one URL's captures can fill many partitions and blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held = TaskContext.get().partitionId(), 0, []

        def made(lines: list) -> pa.RecordBatch:
            data = zlib.compress("\n".join(map(json.dumps, lines)).encode(), 6)
            columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([lines[0][0]]), pa.array([len(lines)], pa.int32()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "first_key", "n", "data"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "archive", "offset", "length")), strict=True)
            while len(held) >= BLOCK_LINES:
                yield made(held[:BLOCK_LINES])
                held, block = held[BLOCK_LINES:], block + 1
        if held:
            yield made(held)

    order = ["key", "archive", "offset"]
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(run, "part int, block int, first_key string, n int, data binary").write.parquet(f"{path}/blocks")


def look_up(archive: Archive, keys: DataFrame) -> DataFrame:
    """The captures (key, archive, offset, length) of the distinct keys.

    The index's partitions, one entry each, are searched first (as many as Spark wrote, not as many as captures);
    then the directory of the one partition, then the block. A key that goes on in later blocks is looked up in each.
    """
    spark = keys.sparkSession
    blocks = archive.blocks(spark)
    directory = blocks.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("block", "first_key"))).alias("entries"))
    tops = sorted((r["first_key"], r["part"]) for r in blocks.where("block = 0").select("first_key", "part").collect())
    sent = spark.sparkContext.broadcast(tops)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, numbers = [t[0] for t in sent.value], [t[1] for t in sent.value]
        for batch in batches:
            own, where = [], []
            for key in batch.column(0).to_pylist():
                a, b = max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)
                own += [key] * (b - a)
                where += numbers[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(where, pa.int32())], ["key", "part"])

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, where, numbers = [], [], []
            for part, entries, key in zip(*(batch.column(c).to_pylist() for c in ("part", "entries", "wanted")), strict=True):
                firsts = [e["first_key"] for e in entries]
                for k in key:
                    a, b = max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k)
                    own += [k] * (b - a)
                    where += [part] * (b - a)
                    numbers += range(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(where, pa.int32()), pa.array(numbers, pa.int32())], ["key", "part", "block"])

    def in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, wanted in zip(batch.column("data").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                lines = [json.loads(line) for line in zlib.decompress(data).split(b"\n")]
                firsts = [line[0] for line in lines]
                for key in wanted:
                    out += lines[bisect.bisect_left(firsts, key) : bisect.bisect_right(firsts, key)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["key", "archive", "offset", "length"])

    dealt = keys.select(F.coalesce("key", F.lit("")).alias("key")).distinct().mapInArrow(parts, "key string, part int")
    # Keys of a partition go in bundles, so that one directory is read for many of them.
    bundles = dealt.groupBy("part", F.pmod(F.xxhash64("key"), F.lit(64)).alias("bundle")).agg(F.collect_list("key").alias("wanted"))
    chosen = bundles.join(directory, "part").select("part", "entries", "wanted").mapInArrow(to_blocks, "key string, part int, block int")
    asked = chosen.groupBy("part", "block").agg(F.collect_list("key").alias("wanted"))
    return blocks.join(asked, ["part", "block"]).select("data", "wanted").mapInArrow(in_block, "key string, archive string, offset long, length long")


def read_ranges(archive: Archive, captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, key of the captures' records, from their ranges."""
    rows = archive.records(captures.sparkSession).drop("key").join(captures, ["archive", "offset", "length"]).select("key", "length", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for size, data in zip(batch.column("length").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if size != len(data):
                    raise ValueError("the range is not one record")
                found.append(parse(zlib.decompress(data, wbits=31)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = list(zip(*found, strict=True)) or [[]] * 5
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)), batch.column("key")], [*names, "key"])

    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, key string")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages as WARC archives with an index, then reads every page back by its URL's key: a row per page.

    Repeated rows have a record each (of the smallest page_id all are responses); null page_ids come after all others
    and refer to them; an empty table gives an empty result; other columns are not carried.
    """
    archive = write_archives(pages, path or fresh_path(pages.sparkSession, "warc"))
    return read_ranges(archive, look_up(archive, pages.select(url_key(F.col("url")).alias("key"))))
