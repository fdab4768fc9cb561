"""Corpus pipeline: quality rules, exact de-duplication, near de-duplication, source mixing,
SentencePiece encoding. Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.

Defined results follow the operators': NULL texts fail the rules and go; rows that repeat stay
once; an empty table passes through; columns of any name are carried to the mix. The last stage
returns doc_id, source, n_tokens, ids, round_trip and place: a text's place in the mix, from 0, which
the mix hands on as the order of the files it is written to.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cairn.llm import parity, pfair, pieces, recipes, rules  # noqa: E402
from cairn.session import checkpoint_dir, ship_package  # noqa: E402

# SQL has no tokenizer; the tests hold the stages against brute force
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return rules.filter_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return recipes.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on five-word shingles the first stays."""
    ship_package(spark)
    return parity.filter_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix at the target weights (rows ** 0.7)."""
    return pfair.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with its place in the mix."""
    ship_package(spark)
    docs = pfair.placed_documents(docs, "doc_id", "text", "source")
    return pieces.encode(docs, keep=("source", "place")).select("doc_id", "source", "n_tokens", "ids", "round_trip", "place")


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("source_mix", source_mix), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
