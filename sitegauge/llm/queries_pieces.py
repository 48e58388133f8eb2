"""Registered query of SentencePiece encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm.common import table
from sitegauge.llm.pieces import encode_documents


def op7_unigram_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, decoded again."""
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
