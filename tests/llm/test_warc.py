import hashlib
import zlib

from pyspark.sql import functions as F

from cellwise.llm import warc
from cellwise.llm.common import NO_ID, fresh_path


def odd_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    more = [
        (9001, None, None),
        (9002, "http://x", ""),
        (None, "http://a.b:80/c?d#e", "z" * 200),
        (9004, "http://u@A.b/c", "z" * 200),
        (9004, "http://u@A.b/c", "z" * 200),
        (9005, "https://a.b/c?d", "y" * 99),
        (9006, "https://a.b/c?d\r\nX: 1", "y" * 99),
        (9007, "http://a.b/long", "\r\n\r\n" + "ü" * 300_000),
        (None, "http://q", "only null " * 20),
    ]
    copies = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 5000)
    return pages.unionByName(copies).unionByName(spark.createDataFrame(more, pages.schema)).withColumn("digest", F.lit("clash")).withColumn("key", F.lit("clash"))


def test_read_back(spark, sf_dir):
    pages = odd_pages(spark, sf_dir)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, html in rows:
        if len(html) >= 100:
            first[html] = min(first.get(html, NO_ID), NO_ID if i is None else i)
    expected = []
    for i, html in rows:
        to = first.get(html, NO_ID)
        copy = to < (NO_ID if i is None else i)
        expected.append((i is None, i or 0, len(html), hashlib.sha256(html).hexdigest(), "revisit" if copy else "response", to if copy else None))
    found = warc.archive_pages(pages).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == sorted(expected, key=repr) or sorted(
        map(repr, ((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found))
    ) == sorted(map(repr, expected))


def test_archives_are_whole_files_and_the_index_finds(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    pages = odd_pages(spark, sf_dir)
    archive = warc.write_archives(pages, fresh_path(spark, "warc"))
    records = archive.records(spark).toPandas()
    for _, own in records.sort_values("offset").groupby("archive"):
        whole = b"".join(own.record)
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        inflated, rest = b"", whole
        while rest:
            one = zlib.decompressobj(wbits=31)
            inflated += one.decompress(rest)
            rest = one.unused_data
        assert inflated.count(b"WARC/1.1\r\n") == len(own)
    blocks = archive.blocks(spark).orderBy("part", "block").collect()
    assert all(b.n <= 4 for b in blocks) and len(blocks) > 5
    firsts = [b.first_key for b in blocks]
    assert firsts == sorted(firsts)
    keys = spark.createDataFrame([("b,a)/c",), ("b,a)/c?d",), ("no,such)/",), ("",), (None,)], "key string")
    found = sorted(r.key for r in warc.look_up(archive, keys).collect())
    every = sorted(records.key)
    assert found == [k for k in every if k in ("b,a)/c", "b,a)/c?d", "")]


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(none).count() == 0
