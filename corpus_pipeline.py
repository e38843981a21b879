"""A corpus pipeline of five of the training-data operators, on the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of documents. No stage loses a row but by its own decision: rows with a null doc_id or one that
repeats with another text are judged by their own text; a null text counts as empty; rows that repeat both are one
document after the second stage; null source and lang are values of their own; an empty table stays empty; further
columns go along, whatever their names (but those beginning with an underscore that the operators add).
ORACLE_SQL is None: the classifier, SimHash and tokenization have no
SQL form; tests/llm holds each stage against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import prepare, stage
from tallyloom.llm.exact_dedup import kept_rows
from tallyloom.llm.mixing import mix
from tallyloom.llm.near_text import drop_near_duplicates
from tallyloom.llm.packing import pack
from tallyloom.llm.quality import classify

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier with its site priors rejects go."""
    prepare(spark)
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("_keep").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    prepare(spark)
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities."""
    return mix(docs).where("_drawn").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing_weights", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
