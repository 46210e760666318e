import hashlib
import zlib

from pyspark.sql import functions as F

from cellwise.llm import chat_format, sharding
from cellwise.llm.common import fresh_path

TURNS = [
    (1, 0, "system", "be <kind> # \\h"),
    (1, 1, "user", None),
    (1, 2, "assistant", "### x: y </turn>\n"),
    (1, 3, "user", "\\b\\l"),
    (1, 4, "assistant", ""),
    (2, 0, "user", "only a user"),
    (3, None, "ro:le", "b"),
    (3, 0, None, "a"),
    (3, 1, "assistant", "x"),
    (3, 1, "assistant", "x"),
    (None, 0, "assistant", "null id"),
]


def test_prefix_examples(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("input", F.lit("clash"))
    rows = rows.select("conv_id", "turn", "role", "text").unionByName(chat_format.awkward_conversation(rows))
    examples = chat_format.prefix_examples(rows)
    found = {r.conv_id: r for r in chat_format.summarise(examples).collect()}
    talks = {}
    for c, t, role, text in [*TURNS, *((-7, k, r, "\\### Assistant: </turn> ok") for k, r in enumerate(("user", "assistant")))]:
        talks.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, talk in talks.items():
        talk.sort()
        script = "".join(f"{r}\n{t}\n" for _, r, t in talk)
        loss = "".join(t for _, r, t in talk if r == "assistant")
        assert found[c].n_turns == len(talk)
        assert found[c].turns_sha256 == hashlib.sha256(script.encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found.keys() == talks.keys()
    for e in examples.where("conv_id = 1").collect():
        assert e.input.count(chat_format.TURN_END) == e.example_no + 1  # the markers of the template alone
    assert chat_format.summarise(chat_format.prefix_examples(rows.limit(0))).count() == 0


def test_shards(spark, odd_docs, rows_of, no_docs):
    rows = sharding.shard_documents(odd_docs, 7).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows_of)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    assert set(by_shard) <= set(range(7))
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by_shard.values())
    assert sharding.shard_documents(no_docs, 7).count() == 0


def test_balance_growth_and_versions(spark, sf_dir):
    rows = sharding.sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sizes, _ = sharding.slot_totals(rows)
    first = sharding.SlotMap.balanced(sizes, 8)
    load = [sum(n for s, n in sizes.items() if first.shard_of[s] == k) for k in range(8)]
    assert max(load) - min(load) <= max(sizes.values())
    second = first.grown(sizes)
    moved = [s for s in range(sharding.SLOTS) if first.shard_of[s] != second.shard_of[s]]
    assert moved and {second.shard_of[s] for s in moved} == {8}
    folder = fresh_path(spark, "slots")
    first.save(spark, folder)
    second.save(spark, folder)
    assert sharding.SlotMap.load(spark, folder, 1) == first and sharding.SlotMap.load(spark, folder, 2) == second


def test_query_stores_both_versions_of_its_map(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "slots")
    rows = sharding.shard_documents(docs, 8, folder).collect()
    first, second = (sharding.SlotMap.load(spark, folder, v) for v in (1, 2))
    assert all(r.shard == first.shard_of[r.vslot] and r.rebalanced_shard == second.shard_of[r.vslot] for r in rows)
    assert {r.rebalanced_shard for r in rows if r.rebalanced_shard != r.shard} == {8}
