"""Corpus pipeline: language, quality, exact copies, near copies, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before kept and
returns the columns of ``documents``; the last returns the packed pieces. ``run`` writes each
result as Parquet in the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm import exact_dedup, minhash
from sitegauge.llm.common import shared_folder, table
from sitegauge.llm.language_id import identify
from sitegauge.llm.packing import pack_documents
from sitegauge.llm.quality import rate
from sitegauge.llm.queries_language_id import train as train_language
from sitegauge.llm.queries_packing import CAPACITY
from sitegauge.llm.queries_quality import learn as train_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null texts, texts without letters and unsure ones go."""
    docs = docs.select(*COLUMNS)
    return identify(docs, train_language(docs)).where(~F.col("rejected")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be good."""
    docs = docs.select(*COLUMNS)
    return rate(docs, train_quality(docs, table(spark, sf_dir, "labels"))).where("predicted = 1").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.kept_rows(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.kept_rows(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("language ID", language),
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("best-fit packing", packing),
]

#: Trained models, registers and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
