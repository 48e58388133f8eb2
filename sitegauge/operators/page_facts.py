"""On-page facts as struct columns over ``parse_pages`` output, and their long forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.cache import column_cache
from sitegauge.functions.html import element_text, is_text, last_values, leaf_text, let, runs, strip
from sitegauge.functions.urls import host_of, hostname, is_absolute, resolve_url
from sitegauge.operators.elements import explode_rows, parse_pages

# --- fixed values: report key -> meta names ---
META_KEYS = {
    "description": ("description",),
    "og_title": ("og:title",),
    "og_description": ("og:description",),
    "og_image": ("og:image",),
    "og_image_alt": ("og:image:alt", "twitter:image:alt"),
    "og_type": ("og:type",),
    "og_url": ("og:url",),
    "og_site_name": ("og:site_name",),
    "twitter_card": ("twitter:card",),
    "twitter_title": ("twitter:title",),
    "twitter_description": ("twitter:description",),
    "twitter_image": ("twitter:image",),
    "twitter_site": ("twitter:site", "twitter:creator"),
    "robots": ("robots",),
    "keywords_meta": ("keywords",),
}


def _attr(e: Column, name: str) -> Column:
    return e["attrs"][name]


def _els(*tags: str) -> Column:
    return F.filter(F.col("els"), lambda e: e["tag"].isin(*tags))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _rel(e: Column, part: str) -> Column:
    return F.coalesce(_attr(e, "rel").contains(part), F.lit(False))


def _top(hosts: Column) -> Column:
    """Values of an array by frequency as ``(rank, host, n)``, ties by first occurrence."""
    found = runs(F.transform(hosts, lambda h: F.struct(h.alias("host"))), "host")
    counted = F.array_sort(F.transform(found, lambda r: F.struct((-r["n"]).alias("neg"), r["at"].alias("at"), r["key"].alias("host"))))
    return F.transform(
        counted,
        lambda c, i: F.struct((i + 1).cast("int").alias("rank"), c["host"].alias("host"), (-c["neg"]).alias("n")),
    )


# --- head ----------------------------------------------------------------------------------


@column_cache
def metas_column() -> Column:
    """Named metas in document order: ``(key, content)``."""
    return F.transform(
        _els("meta"),
        lambda e: F.struct(
            F.lower(strip(F.coalesce(F.nullif(_attr(e, "name"), F.lit("")), _attr(e, "property"), F.lit("")))).alias("key"),
            strip(F.coalesce(_attr(e, "content"), F.lit(""))).alias("content"),
        ),
    )


@column_cache
def meta_facts_column() -> Column:
    """Last content per known key, null if the page lacks the key."""

    def pick(metas: Column) -> Column:
        return F.struct(*[
            F.try_element_at(F.filter(metas, lambda m: m["key"].isin(*names)), F.lit(-1))["content"].alias(key)
            for key, names in META_KEYS.items()
        ])

    return let(metas_column(), pick)


@column_cache
def title_column() -> Column:
    def fields(title: Column) -> Column:
        return F.struct(
            F.when(is_text(title), title).alias("title"),
            F.length(F.coalesce(title, F.lit(""))).alias("title_length"),
            F.when(is_text(title), F.size(F.split(title, r"(?U)\s+"))).otherwise(0).alias("title_words"),
        )

    first = F.transform(F.slice(_els("title"), 1, 1), lambda e: element_text(F.col("tokens"), e, ""))
    return let(_first(first), fields)


@column_cache
def document_column() -> Column:
    metas = _els("meta")
    refresh = _first(F.filter(metas, lambda e: F.lower(_attr(e, "http-equiv")) == "refresh"))
    named = F.filter(
        metas,
        lambda e: (F.lower(strip(F.coalesce(F.nullif(_attr(e, "name"), F.lit("")), _attr(e, "property"), F.lit("")))) == "http-equiv")
        & F.lower(strip(_attr(e, "content"))).startswith("refresh"),
    )
    return F.struct(
        _attr(_first(_els("html")), "lang").alias("lang"),
        _attr(_first(F.filter(metas, lambda e: _attr(e, "charset").isNotNull())), "charset").alias("charset"),
        F.when(refresh.isNotNull(), F.coalesce(_attr(refresh, "content"), F.lit("")))
        .otherwise(strip(_attr(F.try_element_at(named, F.lit(-1)), "content"))).alias("meta_refresh"),
    )


@column_cache
def canonical_column() -> Column:
    base = F.col("base")

    def fields(href: Column) -> Column:
        def bare(u: Column) -> Column:
            return F.regexp_replace(u, "/+$", "")

        known = is_text(href)
        return F.struct(
            F.when(known, strip(href)).alias("canonical"),
            (known & is_absolute(strip(href))).alias("canonical_absolute"),
            F.coalesce(known & (bare(resolve_url(base, strip(href))) == bare(base)), F.lit(False)).alias("canonical_self"),
            F.when(known, host_of(strip(href), base)).otherwise("").alias("canonical_host"),
        )

    return let(_attr(_first(F.filter(_els("link"), lambda e: _rel(e, "canonical"))), "href"), fields)


@column_cache
def has_favicon_column() -> Column:
    return F.exists(_els("link"), lambda e: _rel(e, "icon"))


@column_cache
def hreflang_column() -> Column:
    alternates = F.filter(_els("link"), lambda e: _rel(e, "alternate") & is_text(_attr(e, "hreflang")))
    return F.transform(
        alternates,
        lambda e: F.struct(
            _attr(e, "hreflang").alias("lang"),
            F.coalesce(_attr(e, "href"), F.lit("")).alias("href"),
            host_of(F.coalesce(_attr(e, "href"), F.lit("")), F.col("base")).alias("host"),
        ),
    )


def robots_directives(content: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(content, F.lit("")), ","), lambda p: F.lower(strip(p)))
    return F.filter(parts, lambda p: p != "")


@column_cache
def viewport_column() -> Column:
    def fields(metas: Column) -> Column:
        content = F.coalesce(_attr(_first(metas), "content"), F.lit(""))
        lowered = F.replace(F.lower(content), F.lit(" "))
        return F.struct(
            (F.size(metas) > 0).alias("has_viewport"),
            content.alias("content"),
            lowered.contains("width=device-width").alias("width_device"),
            # "maximum-scale=1" also reads 10 and 1.5 as a zoom block.
            (lowered.contains("user-scalable=no") | lowered.contains("maximum-scale=1")).alias("user_scalable_disabled"),
            lowered.contains("initial-scale").alias("has_initial_scale"),
        )

    return let(F.filter(_els("meta"), lambda e: F.lower(_attr(e, "name")) == "viewport"), fields)


# --- structure -----------------------------------------------------------------------------


@column_cache
def headings_column() -> Column:
    """Headings in document order: ``(pos, level, text)``."""
    return F.transform(
        _els("h1", "h2", "h3", "h4", "h5", "h6"),
        lambda e: F.struct(
            e["pos"].alias("pos"), F.substring(e["tag"], 2, 1).cast("int").alias("level"),
            element_text(F.col("tokens"), e, " ").alias("text"),
        ),
    )


def skipped_levels(levels: Column) -> Column:
    """Gaps between the used levels in numeric order as ``(from, to)``."""
    pairs = F.zip_with(
        levels, F.slice(levels, F.lit(2), F.greatest(F.size(levels), F.lit(1))),
        lambda a, b: F.struct(a.alias("from"), b.alias("to")),
    )
    return F.filter(pairs, lambda p: F.coalesce(p["to"] - p["from"] > 1, F.lit(False)))


@column_cache
def heading_facts_column() -> Column:
    def fields(found: Column) -> Column:
        levels = F.array_sort(F.array_distinct(F.transform(found, lambda h: h["level"])))
        counts = [
            F.size(F.filter(found, lambda h: h["level"] == n)).alias(f"h{n}_count") for n in range(1, 7)
        ]
        return F.struct(
            F.size(found).alias("total"),
            F.size(F.filter(found, lambda h: h["text"] == "")).alias("empty"),
            *counts,
            levels.alias("levels_used"),
            skipped_levels(levels).alias("skipped_levels"),
            _first(F.filter(found, lambda h: h["level"] == 1))["text"].alias("first_h1"),
        )

    return let(headings_column(), fields)


@column_cache
def links_column() -> Column:
    """Anchors with a non-blank href in document order, classified."""
    tokens, base = F.col("tokens"), F.col("base")

    # Three passes over the anchors, each building on the fields of the one before: lambda
    # bodies are not deduplicated, so a value used twice is made a field first.
    def read(e: Column) -> Column:
        return F.struct(
            e["pos"].alias("pos"), e["close_pos"].alias("close_pos"),
            strip(_attr(e, "href")).alias("href"), _attr(e, "rel").alias("rel"),
        )

    def locate(x: Column) -> Column:
        href = x["href"]
        special = (
            F.when(href.startswith("#"), "hash")
            .when(F.lower(href.substr(1, 7)) == "mailto:", "mailto")
            .when(F.lower(href.substr(1, 11)) == "javascript:", "javascript")
        )
        return F.struct(
            x["pos"].alias("pos"), x["close_pos"].alias("close_pos"), href.alias("href"), x["rel"].alias("rel"), special.alias("special"),
            host_of(href, base).alias("target_host"), element_text(tokens, x, " ").alias("text"),
        )

    def classify(page_host: Column):
        def row(x: Column) -> Column:
            external = ((x["target_host"] != "") & (page_host != "") & (x["target_host"] != page_host)) | (
                x["href"].startswith("http") & (page_host == "")
            )
            counted = x["special"].isNull()
            nofollow = F.coalesce(x["rel"].contains("nofollow"), F.lit(False)) & F.array_contains(F.split(x["rel"], r"\s+"), "nofollow")
            inner = F.slice(tokens, x["pos"] + 2, F.greatest(x["close_pos"] - x["pos"] - 1, F.lit(0)))  # read for anchors without text only
            image = F.exists(inner, lambda t: F.coalesce((t["kind"] == "open") & (t["tag"] == "img"), F.lit(False)))
            return F.struct(
                x["pos"].alias("pos"), x["href"].alias("href"), x["target_host"].alias("target_host"),
                F.coalesce(x["special"], F.when(external, "external").otherwise("internal")).alias("link_class"),
                (counted & nofollow).alias("nofollow"),
                (counted & (x["text"] == "") & ~image).alias("empty_anchor"),
                x["text"].alias("text"),
            )

        return row

    anchors = F.filter(F.transform(_els("a"), read), lambda x: is_text(x["href"]))
    located = F.transform(anchors, locate)
    return let(hostname(base), lambda page_host: F.transform(located, classify(page_host)))


def _leading(items: Column, n: int | None) -> Column:
    """The first n items, or all."""
    return items if n is None else F.slice(items, 1, n)


@column_cache
def link_facts_column(examples: int | None = None) -> Column:
    def count(links: Column, test) -> Column:
        return F.size(F.filter(links, test))

    def fields(links: Column) -> Column:
        internal = F.filter(links, lambda x: x["link_class"] == "internal")
        external = F.filter(links, lambda x: x["link_class"] == "external")
        return F.struct(
            F.size(internal).alias("internal"),
            F.size(external).alias("external"),
            (F.size(internal) + F.size(external)).alias("total"),
            count(links, lambda x: x["nofollow"]).alias("nofollow"),
            count(links, lambda x: x["empty_anchor"]).alias("empty_anchor"),
            count(links, lambda x: x["link_class"] == "hash").alias("hash_only"),
            count(links, lambda x: x["link_class"] == "javascript").alias("javascript"),
            count(links, lambda x: x["link_class"] == "mailto").alias("mailto"),
            F.size(F.array_distinct(F.transform(internal, lambda x: resolve_url(F.col("base"), x["href"])))).alias("unique_internal"),
            _top(F.transform(external, lambda x: x["target_host"])).alias("external_hosts"),
            F.transform(
                _leading(internal, examples),
                lambda x: F.struct(x["href"].alias("href"), x["text"].alias("text")),
            ).alias("internal_examples"),
        )

    return let(links_column(), fields)


@column_cache
def images_column() -> Column:
    def flags(e: Column) -> Column:
        src = strip(F.coalesce(_attr(e, "src"), F.lit("")))
        path = F.split(src, r"\?")[0]
        # Everything after the last dot, so a URL without file name yields its host suffix.
        extension = F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).otherwise("")
        alt = _attr(e, "alt")
        return F.struct(
            e["pos"].alias("pos"), src.alias("src"),
            alt.isNull().alias("missing_alt"),
            F.coalesce(strip(alt) == "", F.lit(False)).alias("empty_alt"),
            (~(is_text(_attr(e, "width")) & is_text(_attr(e, "height")))).alias("no_dimensions"),
            F.coalesce(F.lower(_attr(e, "loading")) == "lazy", F.lit(False)).alias("lazy"),
            is_text(_attr(e, "srcset")).alias("has_srcset"),
            src.startswith("data:").alias("data_uri"),
            (~src.startswith("data:") & ~extension.isin("", "webp", "avif")).alias("legacy_format"),
        )

    return F.transform(_els("img"), flags)


@column_cache
def image_facts_column(examples: int | None = None) -> Column:
    def fields(images: Column) -> Column:
        def count(flag: str) -> Column:
            return F.size(F.filter(images, lambda x: x[flag]))

        return F.struct(
            F.size(images).alias("total"),
            (count("missing_alt") + count("empty_alt")).alias("without_alt"),
            count("empty_alt").alias("empty_alt"),
            count("missing_alt").alias("missing_alt"),
            count("no_dimensions").alias("without_dimensions"),
            (F.size(images) - count("no_dimensions")).alias("with_dimensions"),
            count("lazy").alias("lazy"),
            count("has_srcset").alias("with_srcset"),
            count("data_uri").alias("data_uri"),
            count("legacy_format").alias("legacy_format"),
            F.transform(
                _leading(F.filter(images, lambda x: x["missing_alt"]), examples),
                lambda x: x["src"],
            ).alias("examples_missing_alt"),
        )

    return let(images_column(), fields)


# --- rendering -----------------------------------------------------------------------------


@column_cache
def third_party_column() -> Column:
    """Foreign asset hosts by frequency: src of script, link and img first, then link href."""
    page_host = hostname(F.col("base"))
    urls = F.concat(
        F.transform(_els("script", "link", "img"), lambda e: _attr(e, "src")),
        F.transform(_els("link"), lambda e: _attr(e, "href")),
    )
    hosts = F.transform(F.filter(urls, is_text), lambda u: hostname(u))
    foreign = F.filter(hosts, lambda h: (h != "") & F.coalesce((page_host != "") & (h != page_host), F.lit(False)))
    return let(foreign, _top)


@column_cache
def render_signals_column() -> Column:
    """Rendering signals read from the markup; needs ``html``, ``tokens``, ``els`` and ``text``."""
    head = _first(_els("head"))

    def fields(p: Column) -> Column:
        scripts, links = p["scripts"], p["links"]

        def linked(part: str) -> Column:
            return F.size(F.filter(links, lambda e: _rel(e, part)))

        # A value-less defer or async is the empty string and does not count.
        blocking = F.filter(
            scripts,
            lambda e: F.coalesce((p["head"]["pos"] < e["pos"]) & (e["pos"] < p["head"]["close_pos"]), F.lit(False))
            & (
                ~is_text(_attr(e, "src"))
                | ~(is_text(_attr(e, "defer")) | is_text(_attr(e, "async")) | F.coalesce(_attr(e, "type") == "module", F.lit(False)))
            ),
        )

        def total_length(items: Column) -> Column:
            return F.aggregate(items, F.lit(0), lambda acc, e: acc + F.length(leaf_text(e["raw"])))

        return F.struct(
            F.length(F.col("html")).alias("dom_size_bytes"),
            F.size(F.filter(F.col("tokens"), lambda t: t["kind"] == "open")).alias("dom_nodes"),
            F.size(p["images"]).alias("image_count"),
            F.size(F.filter(p["images"], lambda e: ~(is_text(_attr(e, "width")) & is_text(_attr(e, "height"))))).alias("images_without_dimensions"),
            F.size(scripts).alias("scripts_count"),
            linked("stylesheet").alias("stylesheets_count"),
            F.size(blocking).alias("render_blocking_scripts"),
            linked("stylesheet").alias("render_blocking_styles"),
            F.size(F.filter(scripts, lambda e: is_text(_attr(e, "defer")))).alias("defer_scripts"),
            F.size(F.filter(scripts, lambda e: is_text(_attr(e, "async")))).alias("async_scripts"),
            total_length(scripts).alias("inline_script_bytes"),
            total_length(_els("style")).alias("inline_style_bytes"),
            F.size(F.filter(p["images"], lambda e: F.lower(_attr(e, "loading")) == "lazy")).alias("lazy_images"),
            linked("preconnect").alias("preconnect"),
            linked("preload").alias("preload"),
            F.size(_els("iframe")).alias("iframes"),
            F.size(_els("embed")).alias("embeds"),
            F.length(F.col("text")).alias("text_length_chars"),
        )

    parts = F.struct(
        _els("script").alias("scripts"), _els("link").alias("links"), _els("img").alias("images"), head.alias("head")
    )
    return let(parts, fields)


@column_cache
def vitals_column(signals: str = "signals") -> Column:
    """Markup-based estimates of the three vitals."""
    s = F.col(signals)
    text, size, images = s["text_length_chars"], s["dom_size_bytes"], s["image_count"]
    scripts, styles, bare = s["scripts_count"], s["stylesheets_count"], s["images_without_dimensions"]
    return F.struct(
        F.when((text > 200_000) | (size > 5_000_000) | (images > 100), "poor")
        .when((text > 50_000) | (size > 1_000_000) | (images > 20), "needs improvement")
        .otherwise("good").alias("lcp"),
        F.when((size > 2_000_000) | (scripts > 30), "poor")
        .when((size > 500_000) | (scripts > 10) | (styles > 5), "needs improvement")
        .otherwise("good").alias("fcp"),
        F.when((bare > 5) | (s["iframes"] > 3), "poor")
        .when((bare > 0) | (s["iframes"] > 0) | (s["embeds"] > 0), "needs improvement")
        .otherwise("good").alias("cls"),
        F.lit("markup-estimate").alias("source"),
    )


# --- operators -----------------------------------------------------------------------------


def meta_tags(pages: DataFrame) -> DataFrame:
    facts = parse_pages(pages, nested=False).select("page_id", meta_facts_column().alias("m"))
    return facts.select(
        "page_id", "m.*", F.length(F.coalesce(F.col("m.description"), F.lit(""))).alias("description_length")
    )


def meta_map(pages: DataFrame) -> DataFrame:
    """Every meta by name, property, http-equiv or charset; the last one of a key wins."""
    def entry(e: Column) -> Column:
        key = F.coalesce(*[F.nullif(_attr(e, a), F.lit("")) for a in ("name", "property", "http-equiv", "charset")])
        content = F.coalesce(F.nullif(_attr(e, "content"), F.lit("")), _attr(e, "charset"), F.lit(""))
        return F.struct(key.alias("key"), content.alias("value"))

    entries = F.filter(F.transform(_els("meta"), entry), lambda m: m["key"].isNotNull())
    return parse_pages(pages, nested=False).select("page_id", last_values(entries).alias("tags"))


def title_stats(pages: DataFrame) -> DataFrame:
    return parse_pages(pages).select("page_id", title_column().alias("t")).select("page_id", "t.*")


def doc_lang_charset(pages: DataFrame) -> DataFrame:
    return parse_pages(pages, nested=False).select("page_id", document_column().alias("d")).select("page_id", "d.*")


def canonical(pages: DataFrame) -> DataFrame:
    return parse_pages(pages, nested=False).select("page_id", canonical_column().alias("c")).select("page_id", "c.*")


def favicon(pages: DataFrame) -> DataFrame:
    return parse_pages(pages, nested=False).select("page_id", has_favicon_column().alias("has_favicon"))


def hreflang(pages: DataFrame) -> DataFrame:
    return explode_rows(parse_pages(pages, nested=False), hreflang_column(), "page_id")


def robots(pages: DataFrame) -> DataFrame:
    facts = parse_pages(pages, nested=False).select("page_id", meta_facts_column()["robots"].alias("robots"))
    listed = F.transform(robots_directives(F.col("robots")), lambda d, i: F.struct((i + 1).cast("int").alias("ordinal"), d.alias("directive")))
    return explode_rows(facts, listed, "page_id")


def headings(pages: DataFrame) -> DataFrame:
    """Per page and used level: count, empties and texts."""
    def level(found: Column) -> Column:
        return F.transform(
            F.array_sort(F.array_distinct(F.transform(found, lambda h: h["level"]))),
            lambda n: let(
                F.filter(found, lambda h: h["level"] == n),
                lambda same: F.struct(
                    n.alias("level"), F.size(same).alias("n"),
                    F.size(F.filter(same, lambda h: h["text"] == "")).alias("n_empty"),
                    F.transform(same, lambda h: h["text"]).alias("texts"),
                ),
            ),
        )

    return explode_rows(parse_pages(pages), let(headings_column(), level), "page_id")


def heading_skips(pages: DataFrame) -> DataFrame:
    skips = F.transform(
        heading_facts_column()["skipped_levels"],
        lambda s: F.struct(s["from"].alias("skipped_from"), s["to"].alias("skipped_to")),
    )
    return explode_rows(parse_pages(pages), skips, "page_id")


def links_detail(pages: DataFrame) -> DataFrame:
    return explode_rows(parse_pages(pages), links_column(), "page_id")


def links_summary(pages: DataFrame, examples: int | None = None) -> DataFrame:
    return parse_pages(pages).select("page_id", link_facts_column(examples).alias("f")).select("page_id", "f.*")


def images_detail(pages: DataFrame) -> DataFrame:
    return explode_rows(parse_pages(pages, nested=False), images_column(), "page_id")


def images_summary(pages: DataFrame, examples: int | None = None) -> DataFrame:
    return parse_pages(pages, nested=False).select("page_id", image_facts_column(examples).alias("f")).select("page_id", "f.*")


def viewport(pages: DataFrame) -> DataFrame:
    return parse_pages(pages, nested=False).select("page_id", viewport_column().alias("v")).select("page_id", "v.*")


def third_party_hosts(pages: DataFrame, top: int | None = None) -> DataFrame:
    """Foreign asset hosts of every page by frequency; ``top=TOP_HOSTS`` gives the short list of a report."""
    found = third_party_column() if top is None else F.slice(third_party_column(), 1, top)
    return explode_rows(parse_pages(pages, nested=False), found, "page_id")


def broken_link_candidates(pages: DataFrame) -> DataFrame:
    """Anchors whose href leads nowhere: '#', '' or javascript:void(0)."""
    anchors = F.transform(
        F.filter(_els("a"), lambda e: _attr(e, "href").isin("#", "", "javascript:void(0)")),
        lambda e: F.struct(e["pos"].alias("pos"), _attr(e, "href").alias("href")),
    )
    return explode_rows(parse_pages(pages, nested=False), anchors, "page_id")
