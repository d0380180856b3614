"""A training-data pipeline in five stages, each on all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of documents; the last returns the pieces of packed sequences. Rows may lack an
id or repeat one: what stays is decided by row, see each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, langid, packing, pii, simhash, suffixes

#: No SQL can express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns of documents with another text and its length."""
    out = docs.withColumn("text", text)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out).select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined and whose cross-entropy is in its calibrated range; the others go."""
    model = langid.learn(docs.select("text", "lang", langid.fold().alias("fold")))
    return langid.predict(docs, model, priced=True).where("not rejected").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, rows without an id last; of equal ids that of the least text hash."""
    return simhash.one_of_each(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the byte strings that a document of a smaller id has; a character that loses some of its bytes goes, and a null text becomes empty."""
    made = suffixes.without_repeats(docs, rows=True, characters=True).select("row.*", F.col("kept").cast("string").alias("_kept"))
    return _with_text(made, docs.columns, F.col("_kept"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data and the words that reveal it replaced."""
    return _with_text(pii.sanitise(docs), docs.columns, F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.scratch(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
