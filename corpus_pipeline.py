"""The corpus pipeline: stages over the documents table, each written as Parquet and read again as the next one's input.

All but the last stage return the columns of documents. A table without rows passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm import decontamination, language_id, sentencepiece_bpe, simhash, suffix_dedup
from cellwise.llm.common import packed, saved, table, unpacked


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go."""
    return language_id.known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose five-word shingles have a Jaccard similarity of 0.8 or more with those of a kept one of a smaller doc_id."""
    return simhash.one_of_each(docs, shingle=5)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out of text; what is left empty goes. n_chars follows."""
    found = suffix_dedup.deduplicate(packed(docs), window=50, keep=["_doc"], whole_characters=True)
    left = found.where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    cut = left.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("_doc.text")))
    if "n_chars" not in docs.columns:
        return unpacked(cut, "text").select(*docs.columns)
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("_doc.n_chars"))
    return unpacked(cut.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType)), "text", "n_chars").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten consecutive words of a benchmark item stand go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, and n_tokens, ids_sha256 and decoded_sha256 of their texts."""
    import public_tokenizers

    rows = sentencepiece_bpe.encode_decode(packed(docs), public_tokenizers.path("piece_bpe_32k.model"), keep=["_doc"])
    return unpacked(rows, "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("simhash", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: Rank-order profiles, greedy choices and tokenizing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
