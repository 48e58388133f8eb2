"""Keywords, n-grams, text statistics, readability and keyword difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.constants import COMMERCIAL_MODIFIERS, QUESTION_WORDS, STOP_WORDS, TOP_WORDS
from sitegauge.functions import text as T
from sitegauge.functions.cache import column_cache
from sitegauge.functions.html import collapse, runs, strip
from sitegauge.functions.numbers import rounded
from sitegauge.operators.elements import explode_rows, parse_pages, with_text


def keyword_words(text: Column, max_chars: int | None = None) -> Column:
    """Lower-cased keyword candidates of a text in order, stop words included."""
    source = text if max_chars is None else F.substring(text, 1, max_chars)
    return F.regexp_extract_all(F.lower(F.coalesce(source, F.lit(""))), F.lit(T.KEYWORD), F.lit(0))


def content_words(text: Column, max_chars: int | None = None) -> Column:
    return F.filter(keyword_words(text, max_chars), lambda w: ~w.isin(*STOP_WORDS))


def _page_text(pages: DataFrame) -> DataFrame:
    return with_text(parse_pages(pages)).select("page_id", "text")


def keyword_tokens(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Keyword candidates as rows ``(page_id, pos, word, is_stop)``."""
    words = F.transform(
        keyword_words(F.col("text"), max_chars),
        lambda w, i: F.struct(i.cast("int").alias("pos"), w.alias("word"), w.isin(*STOP_WORDS).alias("is_stop")),
    )
    return explode_rows(_page_text(pages), words, "page_id")


def top_phrases(pages: DataFrame, n: int, top: int = TOP_WORDS, max_chars: int | None = None) -> DataFrame:
    """Most frequent ``n``-word phrases per page after stop-word removal, ties by first occurrence.

    A page's phrases are counted inside its row, so nothing is shuffled.
    """
    words = _page_text(pages).select("page_id", content_words(F.col("text"), max_chars).alias("words"))
    phrases = F.transform(
        F.slice(F.col("words"), F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(0))),
        lambda w, i: F.struct(F.concat_ws(" ", *[F.get(F.col("words"), i + k) for k in range(n)]).alias("phrase")),
    )
    counted = F.transform(runs(phrases, "phrase"), lambda r: F.struct((-r["n"]).alias("neg"), r["at"].alias("at"), r["key"].alias("phrase")))
    ranked = F.transform(
        F.slice(F.array_sort(counted), 1, top),
        lambda c, i: F.struct(c["phrase"].alias("phrase"), (-c["neg"]).cast("long").alias("n"), (i + 1).cast("int").alias("rank")),
    )
    return explode_rows(words, ranked, "page_id")


def content_stats(pages: DataFrame) -> DataFrame:
    return _page_text(pages).select("page_id", T.content_stats(F.col("text")).alias("s")).select("page_id", "s.*")


def readability(pages: DataFrame) -> DataFrame:
    return _page_text(pages).select("page_id", T.readability(F.col("text")).alias("r")).select("page_id", "r.*")


def syllables(words: DataFrame) -> DataFrame:
    """``(word, n)`` for a frame of words; every distinct word is counted once."""
    return words.select("word").distinct().select("word", T.syllables(F.col("word")).alias("n"))


@column_cache
def quick_text_column() -> Column:
    """Body text with script text, as the in-page check counts it."""
    body = F.get(F.filter(F.col("els"), lambda e: e["tag"] == "body"), F.lit(0))
    inner = F.slice(F.col("tokens"), body["pos"] + 2, F.greatest(body["close_pos"] - body["pos"] - 1, F.lit(0)))
    whole = r"(?is)^<(?:script|style)\b[^>]*+>(.*)</(?:script|style)\s*>$"
    texts = F.transform(
        inner,
        lambda t: F.when(t["kind"] == "text", t["raw"])
        .when(t["tag"].isin("script", "style"), F.regexp_extract(t["raw"], whole, 1))
        .otherwise(""),
    )
    return collapse(F.coalesce(F.array_join(texts, ""), F.lit("")))


def quick_text_stats(pages: DataFrame) -> DataFrame:
    """Words, sentences and average of the whole body text."""
    texts = parse_pages(pages).select("page_id", quick_text_column().alias("text"))
    words = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))
    found = F.size(F.filter(F.split("text", "[.!?]+"), lambda s: strip(s) != ""))
    counted = texts.select("page_id", words.alias("words"), found.alias("sentences"))
    avg = F.when(F.col("sentences") > 0, F.col("words") / F.col("sentences")).otherwise(0.0)
    return counted.select("page_id", "words", "sentences", rounded(avg, 4).alias("avg_sentence_length"))


def keyword_difficulty(keywords: DataFrame) -> DataFrame:
    """Difficulty of a ``keyword`` from its own words; no search results are queried."""
    text = strip(F.coalesce(F.col("keyword"), F.lit("")))
    modifier = rf"(?U)\b(?:{'|'.join(COMMERCIAL_MODIFIERS)})\b"
    question = rf"(?U)^(?:{'|'.join(QUESTION_WORDS)})\b"
    base = keywords.withColumn("kw", text).withColumn("lowered", F.lower("kw"))
    base = (
        base.withColumn("parts", F.filter(F.split("kw", r"(?U)\s+"), lambda w: w != ""))
        .withColumn("characters", F.length("kw"))
        .withColumn("modifiers", F.array_sort(F.array_distinct(F.regexp_extract_all("lowered", F.lit(modifier), F.lit(0)))))
        .withColumn("words", F.size("parts"))
        .withColumn("stop_words", F.filter("parts", lambda w: F.lower(w).isin(*STOP_WORDS)))
    )
    density = F.least(
        F.lit(40),
        F.least(F.lit(15), F.floor(F.col("characters") / 3).cast("int"))
        + F.when(F.col("lowered").rlike(question), 10).otherwise(0),
    )
    competition = F.least(
        F.lit(60),
        F.when(F.size("modifiers") > 0, 30).otherwise(15) + F.greatest(F.lit(0), 45 - (F.col("words") - 1) * 12),
    )
    scored = base.withColumn("density_score", density).withColumn("competition_score", competition)
    scored = scored.withColumn("score", F.least(F.lit(100), F.col("density_score") + F.col("competition_score")))
    band = (
        F.when(F.col("score") <= 25, "easy").when(F.col("score") <= 50, "moderate")
        .when(F.col("score") <= 75, "hard").otherwise("very hard")
    )
    return scored.withColumn("band", band).withColumn("confidence", F.lit("low")).drop("kw", "lowered", "parts")
