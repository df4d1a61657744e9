"""A corpus pipeline of the training-data operators: filter, deduplicate, clean, pack.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents that the
stage before it kept, and returns documents with the same columns; the last
returns packed pieces. Stages keep clean documents: the first drops what its
quality rules reject, the second all but one document of each group of near
copies; the third and fourth only change texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import line_quality, packing, parity_join, pii, repeats
from textloom.llm.common import table, written

#: Words from which a passage that occurs elsewhere is cut.
PASSAGE_WORDS = 51


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Documents whose text has changed: their length follows it."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rules reject; drop boilerplate lines from the others."""
    judged = line_quality.judge(docs).where("kept")
    return _with_text(judged.drop("text").withColumnRenamed("clean_text", "text"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies (five-word shingles, similarity 0.8)."""
    return parity_join.without_copies(docs, percent=80, size=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of over 50 words that occur elsewhere."""
    return _with_text(repeats.without_repeats(docs, PASSAGE_WORDS, words=True), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates."""
    return _with_text(pii.replace_personal_data(docs, pii.session_key(spark)), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", packing_stage),
]
#: Tokens of the packing stage are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one's result is a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
