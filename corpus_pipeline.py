"""A corpus pipeline over ``documents``: rules, near-duplicates, benchmark passages, personal data, tokens.

Every stage works on all rows that the one before it kept; each result is written as Parquet to the shared folder and read again. All
stages but the last return the columns of ``documents``. Empty tables pass through; null and empty texts go in the first stage, which
asks for ten words; repeated rows leave one; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswire.llm import bpe, decontam, minhash, pii, quality_rules
from presswire.llm.queries import tokenizer_model
from presswire.llm.scratch import bounded_batches, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    bounded_batches(spark)
    return minhash.without_near_duplicates(docs, size=5, percent=80, rows=6)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontam.without_contamination(docs, bounded_batches(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.without_pii(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with their columns but the text, which the ids decode to."""
    bounded_batches(spark)
    found = bpe.encoded(docs, tokenizer_model(), keep=[c for c in docs.columns if c != "text"])
    return found.select("row.*", "n_tokens", "ids")


STAGES = [
    ("quality_rules", quality),
    ("minhash_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", masked),
    ("sentencepiece", tokens),
]
#: The last stage can't be stated in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
