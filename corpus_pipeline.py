"""The training-data pipeline over ``documents``: quality, near duplicates, decontamination, mix, token files.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as
Parquet and read again as the next one's ``docs``.  Near duplicates are sets of five-word shingles that share 80 %.

Nulls and odd rows: each stage's module says what it does with null, empty and very long texts, ties and repeated
rows.  An empty table gives an empty result.  Extra columns are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listmill.llm.decontam import clean_documents
from listmill.llm.mixing import mixed_documents
from listmill.llm.near_dup import first_documents
from listmill.llm.quality import kept_documents
from listmill.llm.queries import WEIGHTS, tokenizer_file
from listmill.llm.token_files import encode_documents
from listmill.session import work_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the word rules nor their language's perplexity band rejects."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return first_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight; a document that is taken twice is there twice."""
    return mixed_documents(docs, WEIGHTS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; returns their index."""
    return encode_documents(docs, tokenizer_file())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("source_mix", source_mix), ("token_files", token_files)]

#: The models, hashes and tokenizer of the stages aren't in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
