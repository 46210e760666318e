import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ODD = [
    (900, None, "en", None, None),
    (901, "", None, "s", 0),
    (902, " \n\t ", "en", "s", 4),
    (903, "... 123 --- !!!", "fr", "s", 15),
    (904, LONG, "en", "s", len(LONG)),
    (905, "short " + PASSAGE + " tail one", "en", "s", 1),
    (906, "other " + PASSAGE + " tail two", "en", "s", 1),
    (906, "other " + PASSAGE + " tail two", "en", "s", 1),
    (906, "a third text of one id " + PASSAGE, "en", "s", 1),
    (None, "no id " + PASSAGE, "en", "s", 1),
    (None, None, None, None, None),
    (907, "a " * 500, "en", "s", 1),
    (908, "é" * 300 + PASSAGE, "fr", "s", 1),
    (909, "日本語" * 60 + "x", None, "s", 1),
    (910, "日本語" * 60 + "y", None, "s", 1),
]


@pytest.fixture(scope="session")
def odd_docs(spark, sf_dir):
    """The small documents, and rows with nulls, empty and long texts, repeated ids; further columns with clashing names."""
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*NAMES)
    rows = own.unionByName(spark.createDataFrame(ODD, SCHEMA)).repartition(5)
    for name in ("_text", "_id", "_key", "fp", "n_words", "n_bytes", "kept", "spans", "_doc", "_row", "lang_pred", "key", "items"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows.persist()


@pytest.fixture(scope="session")
def rows_of(odd_docs):
    return [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
