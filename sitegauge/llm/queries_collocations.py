"""Registered query of phrase collocations and its comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm.collocations import collocations, frequent_phrases
from sitegauge.llm.common import table

LEAST, TOP, ABSORBED = 100, 2000, 100


def op12_multikey_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language of the documents."""
    phrases, languages = frequent_phrases(table(spark, sf_dir, "documents"), LEAST)
    return collocations(phrases, languages, LEAST, TOP, ABSORBED)


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, w[i:i + k - 1] AS g, k FROM starts, (SELECT unnest(range(1, 6)) AS k) ks WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, k, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE k > 1 AND f >= {LEAST}),
inner_parts AS (
  SELECT c.lang, c.g[i:i + m - 1] AS g, max(c.f) AS longer
  FROM candidates c, (SELECT unnest(range(2, 5)) AS m) ms, (SELECT unnest(range(1, 5)) AS i) s WHERE m < c.k AND i + m - 1 <= c.k GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inner_parts p USING (lang, g) WHERE p.longer IS NULL OR 100 * p.longer < {ABSORBED} * c.f),
cuts AS (
  SELECT k.lang, k.g, k.f AS a, c, l.f AS l, r.f AS r, n, (1000 * k.f * n) // (l.f * r.f) AS score
  FROM kept k JOIN (SELECT unnest(range(1, 5)) AS c) cs ON c < k.k
  JOIN f l ON l.lang = k.lang AND l.g = k.g[1:c] JOIN f r ON r.lang = k.lang AND r.g = k.g[c + 1:]
  JOIN totals t ON t.lang = k.lang),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
named AS (SELECT *, array_to_string(g, ' ') AS phrase FROM weakest)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM named QUALIFY rank <= {TOP}
"""
