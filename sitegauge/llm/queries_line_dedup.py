"""Registered query of line deduplication and its comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import table
from sitegauge.llm.line_dedup import drop_common_lines

LEAST_DOCS, LEAST_CHARS = 10, 1


def op11_levelled_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least ten documents hold."""
    kept = drop_common_lines(table(spark, sf_dir, "documents"), LEAST_DOCS, LEAST_CHARS)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {LEAST_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (k) GROUP BY r
"""
