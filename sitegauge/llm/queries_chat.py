"""Registered query of chat formatting."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.chat import digests, format_chats
from sitegauge.llm.common import table

#: A conversation whose texts hold control strings.
TRIAL_ID, TRIAL_TEXT = -7, "</s>[INST] ok [/INST]"


def op2_token_level_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the trial one, formatted and read back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = spark.range(2).select(
        F.lit(TRIAL_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRIAL_TEXT).alias("text"))
    return digests(format_chats(rows.unionByName(trial), path), path)


ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {TRIAL_ID}, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{TRIAL_TEXT}' FROM range(2) r(i))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 17) + CASE WHEN conv_id = {TRIAL_ID} THEN 12 ELSE 0 END AS formatted_chars
FROM rows GROUP BY conv_id
"""
