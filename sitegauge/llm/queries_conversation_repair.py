"""Registered query of conversation repair and its comparison SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import table
from sitegauge.llm.conversation_repair import digests, repair

#: Of so many equal shares of all rows, one each is dropped, emptied, robbed of its ends, repeated and given to the user.
SHARES = 20
DROP, EMPTY, UNEND, REPEAT, TO_USER = range(5)


def share() -> Column:
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    return F.crc32(name) % SHARES


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by their conversation and turn; nulls are one space, but a null turn stays null."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return (
        rows.withColumn("share", share()).where(F.col("share") != DROP)
        .select(
            "conv_id", "turn", F.when(F.col("share") == TO_USER, "user").otherwise(role).alias("role"),
            F.when(F.col("share") == EMPTY, "").when(F.col("share") == UNEND, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("share") == REPEAT, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def op13_grammar_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the damaged table: its faults, its cheapest repair and a digest of that."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, turns = repair(damage(rows))
    done = found.withColumnRenamed("conv_id", "found_id").join(
        digests(turns).withColumnRenamed("conv_id", "digest_id"), F.col("found_id").eqNullSafe(F.col("digest_id")))
    every = rows.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: The edits of one row at a time: closure is up to two inserts before it, op its own edit.
ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS b)),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS h FROM conversations),
shares AS (
  SELECT *, xor(list_reduce([4294967295] || list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {SHARES} AS share
  FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE share WHEN {TO_USER} THEN 'user' ELSE role END AS role,
    CASE share WHEN {EMPTY} THEN '' WHEN {UNEND} THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE share WHEN {REPEAT} THEN 2 ELSE 1 END)) AS copy
  FROM shares WHERE share <> {DROP}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
ordered AS (
  SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM numbered),
rows AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM ordered),
closure(p, m, ins, said) AS (VALUES ('^', '^', '', ''), ('^', 'u', 'I', chr(10) || 'user:'), ('^', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', 's', '', ''), ('s', 'u', 'I', chr(10) || 'user:'), ('s', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', 'u', '', ''), ('u', 'a', 'I', chr(10) || 'assistant:'), ('a', 'a', '', ''), ('a', 'u', 'I', chr(10) || 'user:')),
op(m, needs, q, edit, price) AS (VALUES
  ('^', NULL, '^', 'D', 4), ('s', NULL, 's', 'D', 4), ('u', NULL, 'u', 'D', 4), ('a', NULL, 'a', 'D', 4),
  ('^', 's', 's', 'K', 0), ('^', 'u', 'u', 'K', 0), ('s', 'u', 'u', 'K', 0), ('a', 'u', 'u', 'K', 0), ('u', 'a', 'a', 'K', 0),
  ('^', NULL, 'u', 'R', 3), ('s', NULL, 'u', 'R', 3), ('a', NULL, 'u', 'R', 3), ('u', NULL, 'a', 'R', 3)),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, '^' AS st, {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT s.conv_id, r.i, o.q, min({{
    'cost': (best.cost + 3 * length(ins) + price + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END)::BIGINT,
    'audit': best.audit || ins || edit,
    'said': best.said || c.said || CASE edit WHEN 'K' THEN chr(10) || role || ':' || text
      WHEN 'R' THEN chr(10) || CASE q WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text ELSE '' END}})
  FROM steps s JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1
  JOIN closure c ON c.p = s.st JOIN op o ON o.m = c.m
  WHERE (needs IS NULL OR needs = role[1]) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY s.conv_id, r.i, o.q),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id),
ended AS (
  SELECT s.conv_id, min({{'cost': best.cost + 3 * length(ins), 'audit': best.audit || ins, 'said': best.said || c.said}}) AS best
  FROM steps s LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM s.conv_id JOIN closure c ON c.p = s.st
  WHERE s.i = coalesce(f.n, 0) AND (c.m = 'a' OR c.m = '^') GROUP BY s.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit,
  sha256(substr(best.said, 2)) AS repaired_sha256
FROM ended e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""
