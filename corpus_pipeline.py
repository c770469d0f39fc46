"""The training corpus, built in stages from the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespark.llm.common import table, written
from triplespark.llm.decontaminate import decontaminate
from triplespark.llm.jaccard_join import jaccard_join
from triplespark.llm.language_id import UNKNOWN, language_id, train_language_id
from triplespark.llm.quality_rules import quality_rules
from triplespark.llm.queries import public_model
from triplespark.llm.sentencepiece import encode

#: Least probability of the predicted language.
LEAST_LANGUAGE = 0.4


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality_rules(docs).where("kept").select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a letter and those of no clear language."""
    network = train_language_id(docs, F.col("doc_id"))
    named = language_id(docs, network)
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest id."""
    groups = jaccard_join(docs)
    others = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    held = decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces."""
    return encode(docs.select("doc_id", "text"), public_model(), keep_text=False).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality_rules", keep_quality),
    ("language_id", keep_language),
    ("jaccard_join", keep_distinct),
    ("decontaminate", keep_uncontaminated),
    ("sentencepiece", encoded),
]

#: Robust estimates and learned models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each to what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
