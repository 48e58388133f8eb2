"""Product fields from product pages, by selector tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import selectors as S
from sitegauge.functions.cache import column_cache
from sitegauge.functions.html import element_text, elements, is_text, let, nested, strip
from sitegauge.functions.urls import authority_of, resolve_url
from sitegauge.operators.elements import explode_rows, tokens_column

# --- fixed values: selectors per platform and field; a comma group takes document order,
# --- a tuple is tried in order
SELECTORS = {
    "shopify": {
        "title": "h1.product-title, h1.product-single__title, h1[data-product-title]",
        "price": "[data-product-price], .product__price, .price__current, .price-item--regular, span.money",
        "description": ".product__description, .product-single__description, [data-product-description]",
        "images": "img.product-featured-img, .product-single__photo img, [data-product-featured-image]",
        "variants": "select[data-option] option, .variant-option",
    },
    "woocommerce": {
        "title": "h1.product_title, h1.entry-title",
        "price": ".price .amount, .woocommerce-Price-amount, .summary .price",
        "description": ".woocommerce-product-details__short-description, .woocommerce-Tabs-panel--description",
        "images": ".woocommerce-product-gallery__image img, .wp-post-image",
        "variants": ".variations select option, .variations_form select option",
    },
    "amazon": {
        "title": "#productTitle",
        "whole": ".a-price-whole",
        "fraction": ".a-price-fraction",
        "symbol": ".a-price-symbol",
        "price": "#priceblock_ourprice, .a-price .a-offscreen",
        "description": "#productDescription, #feature-bullets",
        "images": "#landingImage, #imgTagWrapperId img",
        "variants": "#variation_size_name .a-size-base, .swatchSelect",
    },
    "generic": {
        "price": (
            ".price", ".product-price", "[data-price]", ".current-price", ".sales-price", ".offer-price",
            "[itemprop='price']", "meta[property='product:price:amount']", ".price--main",
        ),
        "description": (".product-description", "[itemprop='description']", ".description", "#description", ".product-details"),
    },
}
LINK_SELECTORS = (
    "a[href*='/products/']", "a[href*='/product/']", "a.product-link", "a.product__link", ".product-card a",
    "a.woocommerce-LoopProduct-link", "h2.product-title a", ".product-item__title a", "a.product-item-link",
    ".s-result-item a.a-link-normal[href*='/dp/']",
)
CUSTOM_SELECTORS = {
    "title": "h1",
    "price": "[data-price], .price, .product-price, span.price",
    "description": "[data-description], .description, .product-description",
    "images": ".product-image img, .gallery img, img[src*='product']",
    "variants": "[data-variant], .variant, select option",
}
IMAGE_KEYWORDS = ("product", "main", "large", "zoom")

#: Selectors by which the fields of a platform are read.
PROGRAMS = {
    name: tuple(dict.fromkeys([*(s for rule in rules.values() for s in ((rule,) if isinstance(rule, str) else rule)), *extra]))
    for (name, rules), extra in zip(SELECTORS.items(), (("h1",), (), (), ("h1", "img")), strict=True)
}


@column_cache
def _opened() -> Column:
    return elements(F.col("tokens"), None)


@column_cache
def _found(programs: tuple[tuple[str, ...], ...], which: str | None) -> Column:
    return S.matches(F.col("tokens"), F.col("opened"), programs, F.lit(0) if which is None else F.col(which))


def with_matches(pages: DataFrame, programs: tuple[tuple[str, ...], ...], which: str | None = None) -> DataFrame:
    """Pages with tokens, all elements and ``found``: the matches of the selectors of the row's program.

    ``which`` names the column with the number of the program.
    """
    read = pages.withColumn("tokens", tokens_column()).withColumn("opened", _opened())
    return read.withColumn("found", _found(programs, which)).withColumn("els", nested(F.col("opened"), F.get("found", F.lit(0)))).drop("opened")


def select_all(program: tuple[str, ...], selector: str) -> Column:
    """Elements of the page that a selector of its program matches, in document order."""
    return F.transform(F.get(F.col("found"), F.lit(program.index(selector) + 1)), lambda i: F.get(F.col("els"), i))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _text(e: Column) -> Column:
    return element_text(F.col("tokens"), e, "")


def _first_text(program: tuple[str, ...], selector: str, default: str | None = "") -> Column:
    """Text of the first match, the default without match."""
    texts = F.transform(F.slice(select_all(program, selector), 1, 1), _text)
    found = _first(texts)
    return found if default is None else F.coalesce(found, F.lit(default))


def _image_urls(program: tuple[str, ...], selector: str, fallback: str = "data-src", limit: int | None = None) -> Column:
    matched = select_all(program, selector) if limit is None else F.slice(select_all(program, selector), 1, limit)
    sources = F.transform(matched, lambda e: F.coalesce(F.nullif(e["attrs"]["src"], F.lit("")), e["attrs"][fallback], F.lit("")))
    kept = F.filter(sources, lambda s: (s != "") & ~s.startswith("data:"))
    return F.transform(kept, lambda s: resolve_url(F.col("url"), s))


def _option_values(program: tuple[str, ...], selector: str) -> Column:
    values = F.transform(select_all(program, selector), lambda e: F.coalesce(F.nullif(e["attrs"]["value"], F.lit("")), _text(e)))
    return F.filter(values, lambda v: v != "")


def platform_column() -> Column:
    page = F.lower(F.col("html"))
    return (
        F.when(page.contains("shopify") | F.coalesce(F.col("url").contains("myshopify"), F.lit(False)), "shopify")
        .when(page.contains("woocommerce") | page.contains("wp-content"), "woocommerce")
        .when(authority_of(F.coalesce(F.col("url"), F.lit(""))).contains("amazon"), "amazon")
        .otherwise("generic")
    )


def platform_detect(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", platform_column().alias("platform"))


def _store_product(platform: str) -> Column:
    rules, program = SELECTORS[platform], PROGRAMS[platform]
    title = _first_text(program, rules["title"], None)
    if platform == "shopify":
        title = F.coalesce(title, _first_text(program, "h1", None))
    return F.struct(
        F.coalesce(title, F.lit("")).alias("title"), _first_text(program, rules["price"]).alias("price"),
        _first_text(program, rules["description"]).alias("description"), _image_urls(program, rules["images"]).alias("images"),
        _option_values(program, rules["variants"]).alias("variants"), F.lit("USD").alias("currency"),
    )


def _amazon_product() -> Column:
    rules, program = SELECTORS["amazon"], PROGRAMS["amazon"]
    fraction = _first_text(program, rules["fraction"], None)
    whole = _first_text(program, rules["whole"], None)
    split_price = F.concat(whole, F.coalesce(F.concat(F.lit("."), fraction), F.lit("")))
    texts = F.transform(select_all(program, rules["variants"]), _text)
    return F.struct(
        _first_text(program, rules["title"]).alias("title"),
        F.coalesce(split_price, _first_text(program, rules["price"])).alias("price"),
        _first_text(program, rules["description"]).alias("description"),
        _image_urls(program, rules["images"], "data-old-hires", 1).alias("images"),
        F.filter(texts, lambda v: v != "").alias("variants"),
        F.when(whole.isNotNull(), _first_text(program, rules["symbol"], "USD")).otherwise("USD").alias("currency"),
    )


def _generic_product() -> Column:
    rules, program = SELECTORS["generic"], PROGRAMS["generic"]

    def price(selector: str) -> Column:
        values = F.transform(
            F.slice(select_all(program, selector), 1, 1), lambda e: F.coalesce(F.nullif(e["attrs"]["content"], F.lit("")), _text(e))
        )
        return F.nullif(_first(values), F.lit(""))

    sources = F.transform(select_all(program, "img"), lambda e: F.coalesce(F.nullif(e["attrs"]["src"], F.lit("")), e["attrs"]["data-src"], F.lit("")))
    kept = F.array_distinct(F.filter(sources, lambda s: (s != "") & ~s.startswith("data:")))
    full = F.transform(kept, lambda s: resolve_url(F.col("url"), s))

    def preferred(u: Column) -> Column:
        return F.lower(u).rlike("|".join(IMAGE_KEYWORDS))

    # Preferred images are put in front one by one, hence reversed.
    images = let(full, lambda urls: F.concat(F.reverse(F.filter(urls, preferred)), F.filter(urls, lambda u: ~preferred(u))))
    return F.struct(
        _first_text(program, "h1").alias("title"),
        F.coalesce(*[price(s) for s in rules["price"]], F.lit("")).alias("price"),
        F.coalesce(*[_first_text(program, s, None) for s in rules["description"]], F.lit("")).alias("description"),
        images.alias("images"), F.array().cast("array<string>").alias("variants"), F.lit("USD").alias("currency"),
    )


@column_cache
def product_column(fields: tuple[str, ...] | None = None) -> Column:
    """Product struct by platform; ``fields`` leaves out what a caller does not read."""
    def some(product: Column) -> Column:
        return product if fields is None else F.struct(*[product[f].alias(f) for f in fields])

    platform = F.col("platform")
    return (
        F.when(platform == "shopify", some(_store_product("shopify")))
        .when(platform == "woocommerce", some(_store_product("woocommerce")))
        .when(platform == "amazon", some(_amazon_product()))
        .otherwise(some(_generic_product()))
    )


def product_extract(pages: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Product fields of every page by the rules of its platform, all or the named ones."""
    number = F.lit(0)
    for i, name in enumerate(PROGRAMS):
        number = F.when(F.col("platform") == name, i).otherwise(number)
    known = pages.withColumn("platform", platform_column()).withColumn("program", number)
    found = with_matches(known, tuple(PROGRAMS.values()), "program")
    return found.withColumn("product", product_column(fields)).select("page_id", "url", "platform", "product.*")


def _content(e: Column) -> Column:
    """All text of an element, stripped as a whole."""
    inner = F.slice(F.col("tokens"), e["pos"] + 2, F.greatest(e["close_pos"] - e["pos"] - 1, F.lit(0)))
    raw = F.transform(F.filter(inner, lambda t: t["kind"] == "text"), lambda t: t["raw"])
    return strip(F.array_join(raw, ""))


def product_custom(pages: DataFrame, selectors: Mapping[str, str] | None = None) -> DataFrame:
    """Product fields by the caller's selectors, defaults for the others; null when absent.

    Selectors may use all forms of :mod:`sitegauge.functions.selectors`; what is no selector raises
    ``ValueError`` before a job starts.
    """
    rules = {**CUSTOM_SELECTORS, **(selectors or {})}
    program = tuple(dict.fromkeys(rules.values()))

    def first(field: str) -> Column:
        return _first(F.transform(F.slice(select_all(program, rules[field]), 1, 1), _content)).alias(field)

    sources = F.filter(F.transform(select_all(program, rules["images"]), lambda e: e["attrs"]["src"]), is_text)
    return with_matches(pages, (program,)).select(
        "page_id", "url", first("title"), first("price"), first("description"),
        F.array_distinct(sources).alias("images"),
        F.transform(select_all(program, rules["variants"]), _content).alias("variants"),
    )


def select_elements(pages: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """Matches of any selectors: page_id, url, selector, n, texts (of all matches in document order)."""
    program = tuple(dict.fromkeys(selectors))
    items = F.array(*[
        F.struct(F.lit(s).alias("selector"), F.transform(select_all(program, s), _content).alias("texts")) for s in program
    ])
    rows = explode_rows(with_matches(pages, (program,)), items, "page_id", "url")
    return rows.select("page_id", "url", "selector", F.size("texts").alias("n"), "texts")


def product_links(pages: DataFrame, max_items: int | None = None) -> DataFrame:
    """Product links of collection pages, by selector priority, distinct by href; all or the first ``max_items``."""
    hrefs = F.concat(*[F.transform(select_all(LINK_SELECTORS, s), lambda e: e["attrs"]["href"]) for s in LINK_SELECTORS])
    kept = F.array_distinct(F.filter(hrefs, lambda h: F.coalesce(h.contains("/product"), F.lit(False))))
    ranked = F.transform(
        kept if max_items is None else F.slice(kept, 1, max_items),
        lambda h, i: F.struct((i + 1).cast("int").alias("rank"), resolve_url(F.col("url"), h).alias("link")),
    )
    return explode_rows(with_matches(pages, (LINK_SELECTORS,)), ranked, "page_id", "url")


def competitor_batch(pages: DataFrame) -> DataFrame:
    """Totals of a batch of product pages; a page without title and price counts as failed."""
    products = product_extract(pages, ("title", "price"))
    success = (F.col("title") != "") | (F.col("price") != "")
    return products.groupBy("platform").agg(F.count("*").alias("total"), F.count_if(success).alias("successful"))


def price_compare(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Products of the listed URLs in list order: ``urls`` has ``(ordinal, url)``."""
    listed = pages.join(urls.select("url").distinct(), "url", "left_semi")  # only these are parsed
    products = product_extract(listed, ("title", "price", "currency")).select("url", "platform", "title", "price", "currency")
    return urls.join(products, "url", "left").select("ordinal", "url", "platform", "title", "price", "currency")
