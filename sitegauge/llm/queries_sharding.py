"""Registered query of the sharding operator and its comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import table
from sitegauge.llm.sharding import DRAW_PRIME, ROUND_FACTORS, ROW_BYTES, SHARD_STEP, SLOT_BUCKETS, shard_documents, topology

SHARDS = 40


def op1_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal weight, and where each goes when a shard is added."""
    placed = shard_documents(table(spark, sf_dir, "documents"), topology(SHARDS), topology(SHARDS + 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot",
        F.col("grown_shard").cast("int"), "region", "rack",
    )


def _mixed() -> str:
    value = f"((s.shard + 1) * {SHARD_STEP})"
    for i, factor in enumerate(ROUND_FACTORS):
        value = f"((xor({value}, d{i}) * {factor}) % {DRAW_PRIME})"
    return value


#: CRC-32 byte by byte, with its table of 256 values from the bit rule. All weights are 1, so the
#: least of the draws -ln(u) is the greatest of the mixed numbers.
ORACLE = f"""
WITH bits AS (
  SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS b)),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits),
keyed AS (
  SELECT doc_id, coalesce(strlen(text), 0) + {ROW_BYTES} AS size, hex(coalesce(text, '')) AS h,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS m
  FROM documents),
digits AS (
  SELECT doc_id, size, {", ".join(f"('0x' || substr(m, {1 + 7 * i}, 7))::BIGINT AS d{i}" for i in range(len(ROUND_FACTORS)))},
    xor(list_reduce([4294967295] || list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM keyed, crc),
rows AS (SELECT row_number() OVER () AS r, * FROM digits),
draws AS (SELECT r, s.shard, {_mixed()} AS mixed FROM rows, (SELECT unnest(range({SHARDS + 1})) AS shard) s),
placed AS (
  SELECT r, arg_max(shard, mixed) FILTER (shard < {SHARDS}) AS shard, arg_max(shard, mixed) AS grown_shard FROM draws GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard, shard // 16 AS region, shard // 4 AS rack,
  row_number() OVER (PARTITION BY shard ORDER BY d0 % {SLOT_BUCKETS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM rows JOIN placed USING (r)
"""
