"""Pages to elements: the base of every page operator.

``parse_pages`` adds the token array and the element array to each page row and keeps the page
where it is, so it needs no shuffle and works on batch and streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.constants import BOILERPLATE_TAGS
from sitegauge.functions import html as H
from sitegauge.functions.cache import column_cache
from sitegauge.functions.urls import is_absolute

# Tags the page audit reads; the others are tokens only.
AUDIT_TAGS = tuple(
    dict.fromkeys(
        ("html", "head", "body", "title", "meta", "link", "a", "img", "embed",
         "h1", "h2", "h3", "h4", "h5", "h6") + BOILERPLATE_TAGS
    )
)


@column_cache
def base_column() -> Column:
    return F.when(is_absolute(F.col("url")), F.col("url"))


@column_cache
def tokens_column() -> Column:
    return H.tokens(F.col("html"))


@column_cache
def ends_column() -> Column:
    return H.nested_ends(F.col("tokens"))


@column_cache
def elements_column(tags: tuple[str, ...] | None, nested: bool) -> Column:
    return H.elements(F.col("tokens"), F.col("ends") if nested else None, tags)


@column_cache
def text_column() -> Column:
    return F.array_join(F.reverse(H.visible_chunks(F.col("tokens"), F.col("els"))), " ")


def parse_pages(pages: DataFrame, tags: tuple[str, ...] | None = AUDIT_TAGS, nested: bool = True) -> DataFrame:
    """Add ``base`` (the page URL if absolute), ``tokens`` and ``els`` to ``(page_id, url, html)``.

    Facts that read only tags and attributes go without the ends of elements (``nested=False``).
    """
    parsed = pages.withColumns({"base": base_column(), "tokens": tokens_column()})
    if nested:
        parsed = parsed.withColumn("ends", ends_column())
    return parsed.withColumn("els", elements_column(tags, nested)).drop("ends")


def with_text(parsed: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Add the visible ``text``: text nodes outside boilerplate, joined by a space.

    The nodes come in reverse document order, which later ties by first occurrence rely on.
    ``max_chars`` reproduces the bound of a request service; by default texts are whole.
    """
    text = text_column()
    return parsed.withColumn("text", text if max_chars is None else F.substring(text, 1, max_chars))


def explode_rows(df: DataFrame, items: Column, *keep: str) -> DataFrame:
    """One row per item of an array of structs, fields as columns.

    The outer form keeps Catalyst from inferring ``size(items) > 0`` and evaluating the array
    expression a second time in that filter; empty arrays are dropped afterwards.
    """
    rows = df.select(*keep, F.explode_outer(items).alias("item"))
    return rows.where(F.col("item").isNotNull()).select(*keep, "item.*")


def elements(pages: DataFrame) -> DataFrame:
    """Opening tags of every page: position, tag, attributes, end, nesting in boilerplate and head."""
    parsed = parse_pages(pages, tags=None)
    heads = F.filter(F.col("els"), lambda e: e["tag"] == "head")
    spanned = parsed.withColumn("head", F.get(heads, F.lit(0)))

    def row(e: Column) -> Column:
        head = F.col("head")
        return F.struct(
            e["pos"].alias("pos"), e["tag"].alias("tag"), e["attrs"].alias("attrs"),
            e["close_pos"].alias("close_pos"), e["depth"].alias("depth_boiler"),
            F.coalesce((head["pos"] < e["pos"]) & (e["pos"] < head["close_pos"]), F.lit(False)).alias("in_head"),
        )

    return explode_rows(spanned, F.transform(F.col("els"), row), "page_id", "url")


def token_counts(pages: DataFrame) -> DataFrame:
    """Tokens by page, kind and tag."""
    rows = explode_rows(
        pages.withColumn("tokens", tokens_column()),
        F.transform(F.col("tokens"), lambda t: F.struct(t["kind"].alias("kind"), F.coalesce(t["tag"], F.lit("")).alias("tag"))),
        "page_id",
    )
    return rows.groupBy("page_id", "kind", "tag").agg(F.count("*").alias("n"))


def visible_text(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    return with_text(parse_pages(pages), max_chars).select("page_id", "text")
