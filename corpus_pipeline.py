"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir). `run` writes what a stage returns as Parquet in the shared folder
that the session names and hands the reread rows to the next one. All stages but the last return the
columns of `documents`.

An empty table passes through as an empty table; null texts are rejected by the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediamatch.llm import decontamination, language, packing, secrets, simhash
from mediamatch.llm.frames import read
from mediamatch.session import checkpoint_dir, checkpointed, ship_package

#: A document is rejected if it has no letters or no language reaches this share of it.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with one prevailing language."""
    ship_package(spark)
    model = language.fit(docs.where(~language.held_out("doc_id", language.FOLDS)))
    return language.keep(docs, model, LEAST_SHARE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each component of near copies."""
    ship_package(spark)
    return simhash.representatives(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that leak no benchmark item."""
    ship_package(spark)
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets, but for widely copied examples, in the texts."""
    ship_package(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into training sequences."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot tokenize or take fingerprints; tests compare `run` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
