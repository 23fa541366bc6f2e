"""A training-data pipeline: quality, near-duplicates, benchmark leaks, mixture, token files.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, of which the next one gets
the rows as written. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import decontam, mixing, neardup, quality, tokens
from edgeloom.llm.common import documents, stored
from edgeloom.llm.queries import default_tokenizer


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.learn(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group with Jaccard similarity 0.8 on five-word shingles."""
    return neardup.deduplicated(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 of its five-word shingles."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: languages get tokens by their size to the power 0.7, and the total is as
    large as it must be for every document to stay."""
    return mixing.mixture(docs, "lang", keep_all=True)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the token files."""
    return tokens.read(spark, tokens.write(docs, default_tokenizer()))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", write_tokens),
]

#: No SQL: the classifier is learnt, and token ids come from a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
