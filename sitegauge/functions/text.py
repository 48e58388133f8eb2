"""Text expressions: words, sentences, syllables, readability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.html import collapse, let
from sitegauge.functions.numbers import rounded

# A word of letters: word characters without decimal digits and underscore.
LETTER_WORD = r"[\p{L}\p{Nl}\p{No}]+"
KEYWORD = r"(?U)\b[a-zA-Z][a-zA-Z'-]{2,}\b"

# --- fixed values: syllable patterns ---
SILENT_ENDING = r"(?:[^laeiouy]es|ed|[^laeiouy]e)$"
VOWEL_GROUP = r"[aeiouy]{1,2}"

# --- fixed values: reading levels, lower bound of the reading ease ---
READING_LEVELS = (
    (90, "very easy"), (80, "easy"), (70, "fairly easy"), (60, "standard"),
    (50, "fairly difficult"), (30, "difficult"),
)


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LETTER_WORD), F.lit(0))


def sentences(clean: Column) -> Column:
    """Non-blank sentences of collapsed text: a full stop, ! or ? followed by a space ends one."""
    return F.filter(F.split(clean, r"(?<=[.!?])\s+"), lambda s: s != "")


def syllables(word: Column) -> Column:
    lowered = F.lower(word)
    stem = F.regexp_replace(F.regexp_replace(lowered, SILENT_ENDING, ""), "^y", "")
    return F.when(F.length(lowered) <= 3, 1).otherwise(
        F.greatest(F.regexp_count(stem, F.lit(VOWEL_GROUP)), F.lit(1))
    )


def total_syllables(words: Column) -> Column:
    """Sum of :func:`syllables` over a word array, by a few passes over the joined long words."""
    vowelless = r"(?<![^ ])[^aeiouy ]*+(?![^ ])"

    def count(joined: Column) -> Column:
        stems = F.regexp_replace(
            F.regexp_replace(F.lower(joined), r"(?:[^laeiouy ]es|ed|[^laeiouy ]e)(?= |$)", ""), r"(?<![^ ])y", ""
        )
        counted = let(stems, lambda s: F.regexp_count(s, F.lit(VOWEL_GROUP)) + F.regexp_count(s, F.lit(vowelless)))
        return F.when(joined == "", 0).otherwise(counted)

    long_words = F.filter(words, lambda w: F.length(w) > 3)
    return let(long_words, lambda found: F.size(words) - F.size(found) + let(F.array_join(found, " "), count))


def measures(text: Column, with_syllables: bool = True) -> Column:
    """Counts that statistics and readability share, from one pass over the collapsed text."""

    def from_words(clean: Column, words: Column, found: Column) -> Column:
        return F.struct(
            F.length(clean).alias("chars"),
            F.size(words).alias("words"),
            F.size(found).alias("sentences"),
            F.size(F.filter(found, lambda s: F.size(F.split(s, " ")) > 25)).alias("long_sentences"),
            (total_syllables(words) if with_syllables else F.lit(0)).alias("syllables"),
        )

    return let(
        collapse(F.coalesce(text, F.lit(""))),
        lambda clean: let(
            letter_words(clean), lambda words: let(sentences(clean), lambda found: from_words(clean, words, found))
        ),
    )


def stats_of(m: Column) -> Column:
    """Struct of word, character and sentence counts; ``m`` comes from :func:`measures`."""
    blank = m["chars"] == 0
    n = F.greatest(m["sentences"], F.lit(1))
    return F.struct(
        m["words"].alias("word_count"),
        m["chars"].alias("text_chars"),
        F.when(blank, 0).otherwise(n).alias("sentence_count"),
        F.when(blank, 0.0).otherwise(rounded(m["words"] / n, 1)).alias("avg_sentence_length"),
        m["long_sentences"].alias("long_sentences"),
        # Line breaks are collapsed before counting, so a text is one paragraph.
        F.when(blank, 0).otherwise(1).alias("paragraph_count"),
    )


def readability_of(m: Column) -> Column:
    """Struct with Flesch reading ease, Flesch-Kincaid grade, level and their inputs."""
    empty = (m["words"] == 0) | (m["sentences"] == 0)
    asl = m["words"] / F.nullif(m["sentences"], F.lit(0))
    asw = m["syllables"] / F.nullif(m["words"], F.lit(0))
    grade = F.lit(0.39) * asl + F.lit(11.8) * asw - F.lit(15.59)
    ease = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(206.835) - F.lit(1.015) * asl - F.lit(84.6) * asw))
    level = F.when(empty, "unknown")
    for bound, name in READING_LEVELS:
        level = level.when(ease >= bound, name)
    zero = F.lit(0.0)
    return F.struct(
        F.when(empty, zero).otherwise(rounded(ease, 1)).alias("reading_ease"),
        F.when(empty, zero).otherwise(rounded(grade, 1)).alias("grade"),
        m["words"].alias("word_count"),
        F.when(empty, 0).otherwise(m["sentences"]).alias("sentence_count"),
        m["syllables"].alias("syllable_count"),
        F.when(empty, zero).otherwise(rounded(asl, 1)).alias("avg_sentence_length"),
        level.otherwise("very difficult").alias("level"),
    )


def content_stats(text: Column) -> Column:
    return let(measures(text, with_syllables=False), stats_of)


def readability(text: Column) -> Column:
    return let(measures(text), readability_of)
