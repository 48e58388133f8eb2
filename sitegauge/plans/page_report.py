"""Page audit plan: pages -> facts -> findings -> scores, one map-only stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.constants import STOP_WORDS
from sitegauge.functions import text as T
from sitegauge.functions.cache import column_cache
from sitegauge.functions.html import let
from sitegauge.operators import page_facts as P
from sitegauge.operators.elements import parse_pages, with_text
from sitegauge.operators.structured import with_structured
from sitegauge.operators.text_analytics import keyword_words


@column_cache
def measures_column() -> Column:
    return T.measures(F.col("text"))


@column_cache
def stats_column() -> Column:
    return T.stats_of(F.col("measures"))


@column_cache
def readability_column() -> Column:
    return T.readability_of(F.col("measures"))


@column_cache
def keyword_counts_column() -> Column:
    def counts(words: Column) -> Column:
        return F.struct(
            F.size(F.filter(words, lambda w: ~w.isin(*STOP_WORDS))).alias("keywords"), F.size(words).alias("words")
        )

    return let(keyword_words(F.col("text")), counts)


def page_facts(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One row per page with the fact structs; other input columns are kept.

    Every stage refers to the columns of the one before, so tokens, elements and text are
    computed once. Nothing here shuffles.
    """
    parsed = with_structured(with_text(parse_pages(pages), max_chars))
    facts = parsed.withColumns({
        "meta": P.meta_facts_column(),
        "title_facts": P.title_column(),
        "document": P.document_column(),
        "canonical_facts": P.canonical_column(),
        "has_favicon": P.has_favicon_column(),
        "hreflang": P.hreflang_column(),
        "headings": P.heading_facts_column(),
        "measures": measures_column(),
        "links": P.link_facts_column(),
        "images": P.image_facts_column(),
        "viewport": P.viewport_column(),
        "signals": P.render_signals_column(),
        "third_party": P.third_party_column(),
        "keyword_counts": keyword_counts_column(),
    })
    derived = facts.withColumns({
        "stats": stats_column(), "readability": readability_column(), "vitals": P.vitals_column()
    })
    return derived.drop("tokens", "els", "text", "measures")


def page_report(pages: DataFrame) -> DataFrame:
    """The scalar facts of every page, one flat wide row."""
    return flatten_facts(page_facts(pages))


def flatten_facts(facts: DataFrame) -> DataFrame:
    return facts.select(*fact_columns())


def fact_columns() -> list[Column]:
    """The scalar facts as top-level columns of a frame with the fact structs."""
    def fields(struct: str, names: str, prefix: str = ""):
        return [F.col(f"{struct}.{n}").alias(prefix + n) for n in names.split()]

    return [
        F.col("page_id"), F.col("url"),
        *fields("title_facts", "title title_length title_words"),
        F.col("meta.description"),
        F.length(F.coalesce(F.col("meta.description"), F.lit(""))).alias("description_length"),
        *fields("meta", "og_title og_description og_image og_image_alt og_type og_url og_site_name "
                        "twitter_card twitter_title twitter_description twitter_image twitter_site robots keywords_meta"),
        *fields("canonical_facts", "canonical canonical_absolute canonical_self canonical_host"),
        *fields("document", "lang charset meta_refresh"),
        F.col("has_favicon"),
        F.size("hreflang").alias("hreflang_count"),
        *fields("headings", "total empty h1_count h2_count h3_count h4_count h5_count h6_count", "headings_"),
        *fields("stats", "word_count text_chars sentence_count avg_sentence_length long_sentences paragraph_count"),
        *fields("readability", "reading_ease grade syllable_count level"),
        *fields("links", "internal external total nofollow empty_anchor hash_only javascript mailto unique_internal", "links_"),
        *fields("images", "total without_alt empty_alt missing_alt without_dimensions with_dimensions lazy "
                          "with_srcset data_uri legacy_format", "images_"),
        *fields("schema", "has_structured_data blocks invalid_blocks uses_schema_org", "schema_"),
        F.size("schema.types").alias("schema_types"),
        F.size("schema.missing_properties").alias("schema_missing"),
        *fields("viewport", "has_viewport width_device user_scalable_disabled has_initial_scale"),
        *fields("signals", "dom_size_bytes dom_nodes scripts_count stylesheets_count render_blocking_scripts "
                           "defer_scripts async_scripts inline_script_bytes inline_style_bytes preconnect preload "
                           "iframes embeds text_length_chars"),
        F.size("third_party").alias("third_party_count"),
        F.col("keyword_counts.keywords").alias("keyword_count"), F.col("keyword_counts.words").alias("keyword_word_count"),
        *fields("vitals", "lcp fcp cls"),
    ]
