import random
from collections import Counter

import corpus_pipeline
from cellwise.llm import language_id
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_near_copies import held_against
from tests.llm.test_substring_dedup import brute as brute_spans


def test_stages_against_brute_force(spark, sf_dir, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash", "suffix_dedup", "decontamination", "sentencepiece"]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    known = stages["language_id"](spark, docs, sf_dir).persist()
    scored = language_id.predict(docs, language_id.train(docs), keep=["doc_id", "text"]).collect()
    assert Counter(rows(known)) == Counter((r.doc_id, r.text) for r in scored if r.lang_pred != "und" and r.score >= 0.25)
    assert not any(i in (900, 901, 902, 903, 909) for i, _ in rows(known)) and any(i == 904 for i, _ in rows(known))
    single = stages["simhash"](spark, known, sf_dir).persist()
    assert single.columns == docs.columns
    assert held_against(list(dict.fromkeys(rows(known))), [2**63 - 1 if i is None else i for i, _ in rows(single)]) <= 1
    cut = stages["suffix_dedup"](spark, single, sf_dir).persist()
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    left = {i: n - gone for (i, n, gone, _, _) in brute_spans(rows(single), lambda t: (t or "").encode(), bytes, 50)}
    for r in cut.collect():
        assert left[r.doc_id] <= len(r.text.encode()) <= left[r.doc_id] + 6 * 50
    assert {i for i, _ in rows(cut)} == {i for i, n in left.items() if n}
    clean = stages["decontamination"](spark, cut, sf_dir).persist()
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(i or 0 for i, _ in rows(clean)) == sorted(i for _, i, _, hits, _ in brute_hits(rows(cut), bench, 10) if not hits)
    last = stages["sentencepiece"](spark, clean, sf_dir)
    assert last.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows(last) == rows(clean)


def test_letters_at_random_go_and_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(2, 10)))
    junk = spark.createDataFrame([(10**6 + k, " ".join(word() for _ in range(100))) for k in range(20)], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    kept = {r.doc_id for r in stage(spark, docs.unionByName(junk, allowMissingColumns=True), sf_dir).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.where("rlike(text, '[A-Za-z]')").select("doc_id").collect()}


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert language_id.UNKNOWN == "und"


def test_empty(spark, sf_dir, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
