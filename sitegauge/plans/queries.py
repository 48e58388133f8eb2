"""Registered queries: every operator over whole given tables, or tables derived from them.

Nested results are flattened to scalars, so that rows can be compared across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.operators import accounts as A
from sitegauge.operators import elements as E
from sitegauge.operators import history as H
from sitegauge.operators import page_facts as P
from sitegauge.operators import prices as PR
from sitegauge.operators import products as PD
from sitegauge.operators import routing as R
from sitegauge.operators import scores as S
from sitegauge.operators import text_analytics as TA
from sitegauge.operators import url_ops as U
from sitegauge.operators.structured import structured_data
from sitegauge.plans.page_report import fact_columns, page_report
from sitegauge.sources import derived as D
from sitegauge.sources import files as FS
from sitegauge.streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]


def _pages(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(D.pages_aug(spark, sf))


def _points(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(D.price_points(spark, sf))


def _products(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(D.product_pages(spark, sf))


def _events(columns: dict[str, str], build: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return build(_timestamps(D.derive(D.table(spark, sf, "events"), columns)))

    return run


def _timestamps(df: DataFrame) -> DataFrame:
    casts = {n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def _joined(df: DataFrame, *names: str, sep: str = "|") -> DataFrame:
    return df.withColumns({n: F.array_join(n, sep) for n in names})



# --- composed queries ----------------------------------------------------------------------


def elements_summary(pages: DataFrame) -> DataFrame:
    """Elements by page and tag, with checksums of position, nesting and attributes."""
    return E.elements(pages).groupBy("page_id", "tag").agg(
        F.count("*").alias("n"), F.sum("pos").alias("sum_pos"), F.sum("depth_boiler").alias("sum_depth"),
        F.count_if("in_head").alias("n_in_head"), F.sum(F.size("attrs")).alias("n_attrs"),
    )


def meta_map_rows(pages: DataFrame) -> DataFrame:
    return P.meta_map(pages).select("page_id", F.explode_outer("tags").alias("key", "value")).where(F.col("key").isNotNull())


def signals(pages: DataFrame) -> DataFrame:
    names = ("dom_size_bytes dom_nodes image_count images_without_dimensions scripts_count stylesheets_count render_blocking_scripts "
             "render_blocking_styles defer_scripts async_scripts inline_script_bytes inline_style_bytes lazy_images preconnect preload "
             "iframes embeds text_length_chars").split()
    staged = E.with_text(E.parse_pages(pages)).select("page_id", P.render_signals_column().alias("signals"))
    return staged.select("page_id", *[F.col(f"signals.{n}") for n in names])


def vitals(pages: DataFrame) -> DataFrame:
    staged = E.with_text(E.parse_pages(pages)).withColumn("signals", P.render_signals_column())
    return staged.select("page_id", P.vitals_column().alias("v")).select("page_id", "v.*")


def external_hosts(pages: DataFrame) -> DataFrame:
    links = E.parse_pages(pages).select("page_id", P.link_facts_column()["external_hosts"].alias("hosts"))
    return E.explode_rows(links, F.col("hosts"), "page_id")


def syllable_counts(pages: DataFrame) -> DataFrame:
    words = TA.keyword_tokens(pages).select("word")
    return TA.syllables(words)


def document_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Readability of the plain documents: the text part alone, over another table."""
    docs = D.work_table(spark, sf, "documents")
    return docs.select("doc_id", TA.T.readability(F.col("text")).alias("r")).select("doc_id", "r.*")


def difficulty(spark: SparkSession, sf: str) -> DataFrame:
    keywords = D.derive(D.table(spark, sf, "part").where("p_partkey is not null"), {"p_partkey": "p_partkey", **D.KEYWORDS})
    return _joined(TA.keyword_difficulty(keywords), "modifiers", "stop_words", sep=",").drop("url")


def _captures(spark: SparkSession, sf: str) -> DataFrame:
    return D.derive(D.table(spark, sf, "pages"), D.CAPTURES)


def redirects(spark: SparkSession, sf: str) -> DataFrame:
    return R.redirect_resolve(D.hops(spark, sf), D.table(spark, sf, "pages").select("url"), D.hop_dns(spark, sf))


def admission(spark: SparkSession, sf: str) -> DataFrame:
    return U.url_admission(D.derive(D.table(spark, sf, "pages"), D.FETCH_URLS))


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    pages = D.table(spark, sf, "pages")
    return U.address_admission(pages.select("url"), D.derive(pages, D.DNS))


def networks(spark: SparkSession, sf: str) -> DataFrame:
    return D.derive(D.table(spark, sf, "customer"), D.NETWORKS).select("network", "public")


def network_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return U.networks_of(D.derive(D.table(spark, sf, "orders"), D.ADDRESSES), networks(spark, sf))


def addresses_in_networks(spark: SparkSession, sf: str) -> DataFrame:
    pages = D.table(spark, sf, "pages")
    return U.address_admission(pages.select("url"), D.derive(pages, D.DNS), networks=networks(spark, sf))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return D.derive(D.table(spark, sf, "part"), D.JSON_DOCUMENTS)


def document_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = FS.document_rows(_documents(spark, sf))
    return rows.select("doc_id", "pos", F.explode("fields").alias("name", "value"))


def export_header(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of documents with results written under the header of the first, and read back by it."""
    path = FS.work_folder(spark, "documents")
    FS.export_documents(_documents(spark, sf).where("doc_id % 5 = 0"), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


def _scored_accounts(spark: SparkSession, sf: str) -> DataFrame:
    scored = S.audited(D.pages_aug(spark, sf)).withColumns({k: F.expr(v) for k, v in D.OWNERS.items()})
    flat = scored.select(F.struct("email", "url", "created_at", "audit").alias("kept"), *fact_columns())
    return flat.select("kept.*", S.legacy_score_column().alias("additive"))


def history_append(spark: SparkSession, sf: str) -> DataFrame:
    """Rows go through the append table and come back from it."""
    path = FS.work_folder(spark, "history")
    FS.append_history(H.history_rows(_scored_accounts(spark, sf), F.col("additive")), path)
    return spark.read.parquet(path).drop("created_month")


def history_compact(spark: SparkSession, sf: str) -> DataFrame:
    return H.history_compact(_scored_accounts(spark, sf), F.col("additive"))


def price_append(spark: SparkSession, sf: str) -> DataFrame:
    path = FS.work_folder(spark, "points")
    FS.append_points(PR.price_values(D.price_points(spark, sf)), path)
    return spark.read.parquet(path).select("product", "store", "price_text", "price_value", "currency", "captured_at")


def price_json(spark: SparkSession, sf: str) -> DataFrame:
    """Daily series written as JSON and read back with the declared schema."""
    path = FS.work_folder(spark, "daily")
    points = PR.price_values(D.price_points(spark, sf))
    daily = points.groupBy(F.to_date("captured_at").cast("string").alias("date"), "currency").agg(F.max("price_value").alias("price"))
    FS.export(daily.select("date", "price", "currency"), path, "json")
    return FS.read_daily_prices(spark, path, multi_line=False)


def export_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Products exported as CSV and read back: arrays arrive as JSON text."""
    path = FS.work_folder(spark, "export")
    FS.export(PD.product_extract(D.product_pages(spark, sf)), path, "csv")
    columns = "page_id long, url string, platform string, title string, price string, description string, images string, variants string, currency string"
    rows = spark.read.schema(columns).option("header", True).option("escape", '"').csv(path)
    return rows.select("page_id", "title", "price", "variants")


def price_csv(points: DataFrame) -> DataFrame:
    error = F.when(PR.parse_price(F.col("price_text")).isNull(), "no price")
    return PR.price_csv(points.withColumns({"title": F.concat(F.lit("part "), "product"), "error": error}))


def price_history(points: DataFrame) -> DataFrame:
    history = PR.price_history(points)
    series = F.array_join(F.transform("history", lambda h: F.coalesce(h["price_text"], F.lit(""))), "|")
    return history.withColumn("history", series)


def price_values(points: DataFrame) -> DataFrame:
    text = F.col("price_text")
    return points.select(
        "price_text", PR.parse_price(text).alias("parsed"), PR.strip_price(text).alias("stripped"),
        PR.strip_price(text, "$,").alias("stripped_dollar"), PR.currency_of(text).alias("currency"),
    ).distinct()


def locale_prices(points: DataFrame) -> DataFrame:
    return points.select("price_text", PR.parse_price(F.col("price_text"), locale_aware=True).alias("value")).distinct()


def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    limits = D.derive(D.table(spark, sf, "part"), D.THRESHOLDS)
    return PR.price_threshold_alerts(D.price_points(spark, sf), limits)


def compare(spark: SparkSession, sf: str) -> DataFrame:
    products = D.product_pages(spark, sf)
    return PD.price_compare(products, products.select(F.col("page_id").alias("ordinal"), "url"))


def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    events = _timestamps(D.derive(D.table(spark, sf, "events"), D.ACCOUNT_EVENTS))
    return A.subscription_state(D.accounts(spark, sf), events)


# --- streams -------------------------------------------------------------------------------


def stream_page_audit(spark: SparkSession, sf: str) -> DataFrame:
    pages = D.derive(J.read_stream(spark, f"{sf}/pages.parquet"), D.PAGES_AUG)
    output = J.run_available(J.page_audit(pages), FS.work_folder(spark, "audit"))
    return spark.read.parquet(output)


def _event_stream(spark: SparkSession, sf: str, columns: dict[str, str]) -> DataFrame:
    return D.derive(J.read_stream(spark, f"{sf}/events.parquet"), columns)


def stream_capture_dedup(spark: SparkSession, sf: str) -> DataFrame:
    J.use_rocksdb(spark)
    captures = J.capture_dedup(_event_stream(spark, sf, D.PAGE_VISITS))
    return spark.read.parquet(J.run_available(captures, FS.work_folder(spark, "dedup"), "update")).drop("batch_id")


def stream_rate_breaches(spark: SparkSession, sf: str) -> DataFrame:
    counts = J.rate_counts(_event_stream(spark, sf, D.REQUEST_LOG), window="1 day")
    output = J.run_available(counts, FS.work_folder(spark, "rates"), "update")
    return J.final_breaches(spark, output, F.lit(D.DAILY_LIMIT))


def stream_price_alerts(spark: SparkSession, sf: str) -> DataFrame:
    stream = J.read_stream(spark, f"{sf}/lineitem.parquet")
    limits = D.derive(J.read_stream(spark, f"{sf}/part.parquet"), D.THRESHOLDS)
    output = J.price_changes(D.derive(stream, D.PRICE_POINTS), FS.work_folder(spark, "alerts"), thresholds=limits)
    return spark.read.parquet(output).drop("batch_id")


def stream_subscription_state(spark: SparkSession, sf: str) -> DataFrame:
    J.use_rocksdb(spark)
    updates = J.subscription_updates(_event_stream(spark, sf, D.ACCOUNT_EVENTS), D.accounts(spark, sf))
    output = J.run_available(updates, FS.work_folder(spark, "subscriptions"), "update")
    return J.latest_state(spark, output)


#: A caller's selectors of all forms.
SELECTOR_FORMS = (
    "div.summary > p.price > span", "h1 + h1", "h1 ~ img", "img:not([data-src])", "li:first-child", "li:nth-child(2n+1)", '[class^="a-price"]',
    'span[class|="a"]', 'img[src$=".jpg"]', '[class~="price"]', "option:last-child", "ul > li:not(.product-card) > a.product-link + a",
)


# --- registry ------------------------------------------------------------------------------


def _with_message(df: DataFrame) -> DataFrame:
    return df.select("page_id", "rule", "category", "severity", "impact")


def _headings(df: DataFrame) -> DataFrame:
    return _joined(P.headings(df), "texts")


QUERIES: dict[str, Query] = {
    # sources, sinks, routing
    "page_intake": lambda spark, sf: R.page_intake(D.derive(D.table(spark, sf, "pages"), D.SUBMISSIONS)),
    "capture_routing": lambda spark, sf: R.capture_routing(_captures(spark, sf)),
    "redirect_resolve": redirects,
    "batch_report": lambda spark, sf: R.batch_report(_captures(spark, sf)),
    "batch_documents": lambda spark, sf: R.batch_documents(_aug_captures(spark, sf)),
    "report_csv": lambda spark, sf: R.report_csv(_aug_captures(spark, sf)),
    "export_json_csv": export_csv,
    "document_rows": document_fields,
    "export_documents_csv": lambda spark, sf: FS.documents_csv(_documents(spark, sf)),
    "export_documents_header": export_header,
    "price_csv": _points(price_csv),
    "price_json_source": price_json,
    "history_append": history_append,
    "history_latest": lambda spark, sf: H.history_latest(H.history_rows(_scored_accounts(spark, sf), F.col("additive"))),
    "history_compact": history_compact,
    "price_append": price_append,
    "price_latest": _points(lambda p: PR.price_latest(p).select("product", "rank", "price_text", "price_value", "currency", "captured_at")),
    # extraction
    "elements": _pages(E.token_counts),
    "elements_nesting": _pages(elements_summary),
    "visible_text": _pages(E.visible_text),
    "meta_tags": _pages(P.meta_tags),
    "meta_map": _pages(meta_map_rows),
    "title_stats": _pages(P.title_stats),
    "doc_lang_charset": _pages(P.doc_lang_charset),
    "canonical": _pages(P.canonical),
    "favicon": _pages(P.favicon),
    "hreflang": _pages(P.hreflang),
    "robots_directives": _pages(P.robots),
    "headings": _pages(_headings),
    "heading_skips": _pages(P.heading_skips),
    "links_detail": _pages(P.links_detail),
    "links_summary": _pages(lambda p: P.links_summary(p).drop("external_hosts", "internal_examples")),
    "external_hosts": _pages(external_hosts),
    "images_detail": _pages(P.images_detail),
    "images_summary": _pages(lambda p: _joined(P.images_summary(p), "examples_missing_alt")),
    "structured_data": _pages(structured_data),
    "viewport": _pages(P.viewport),
    "render_signals": _pages(signals),
    "third_party_hosts": _pages(P.third_party_hosts),
    "vitals_estimate": _pages(vitals),
    "page_report": _pages(page_report),
    # text
    "keyword_tokens": _pages(TA.keyword_tokens),
    "top_words": _pages(lambda p: TA.top_phrases(p, 1)),
    "top_bigrams": _pages(lambda p: TA.top_phrases(p, 2)),
    "top_trigrams": _pages(lambda p: TA.top_phrases(p, 3)),
    "content_stats": _pages(TA.content_stats),
    "syllables": _pages(syllable_counts),
    "readability": _pages(TA.readability),
    "readability_documents": document_stats,
    "quick_text_stats": _pages(TA.quick_text_stats),
    "keyword_difficulty": difficulty,
    # rules and scores
    "findings": _pages(lambda p: _with_message(S.findings(p))),
    "findings_ranked": _pages(lambda p: S.findings_ranked(p).select("page_id", "rank", "rule", "severity", "impact")),
    "finding_messages": _pages(lambda p: S.findings(p).select("page_id", "rule", "message", "fix", "evidence")),
    "category_scores": _pages(S.category_scores),
    "page_score": _pages(S.page_score),
    "legacy_score": _pages(lambda p: S.legacy_score(page_report(p))),
    "quick_score": _pages(S.quick_score),
    "status_bands": _pages(S.status_bands),
    "category_bands": _pages(S.category_bands),
    "alt_bands": _pages(S.alt_bands),
    "broken_link_candidates": _pages(P.broken_link_candidates),
    "rules_catalog": _pages(S.rules_catalog),
    "grade_by_host": _pages(S.grade_by_host),
    # URLs
    "host_of": _pages(U.link_hosts),
    "is_absolute": _pages(U.link_absolute),
    "is_external": _pages(U.link_external),
    "resolve_url": _pages(U.link_resolved),
    "url_admission": admission,
    "address_admission": addresses,
    "address_admission_networks": addresses_in_networks,
    "network_lookup": network_lookup,
    # products
    "platform_detect": _products(PD.platform_detect),
    "product_extract": _products(lambda p: _joined(PD.product_extract(p), "images", "variants")),
    "product_custom": _products(lambda p: _joined(PD.product_custom(p, {"title": "h1, #productTitle"}), "images", "variants")),
    "product_selectors": _products(lambda p: _joined(PD.select_elements(p, SELECTOR_FORMS), "texts").drop("url")),
    "product_links": _products(PD.product_links),
    "competitor_batch": _products(PD.competitor_batch),
    "price_compare": compare,
    # prices
    "parse_price": _points(price_values),
    "parse_price_locale": _points(locale_prices),
    "price_history": _points(price_history),
    "price_series": _points(PR.price_series),
    "price_change_alerts": _points(lambda p: PR.price_change_alerts(p).drop("message")),
    "price_threshold_alerts": thresholds,
    "price_drop_strict": _points(PR.price_drop_strict),
    "price_report_summary": _points(PR.price_report_summary),
    "price_report_products": _points(PR.price_report_products),
    "price_report_alerts": _points(PR.price_report_alerts),
    "price_trend_30d": _points(PR.price_trend_30d),
    # accounts
    "subscription_state": subscriptions,
    "premium_flag": lambda spark, sf: A.premium_flag(subscriptions(spark, sf)),
    "rate_breaches": _events(D.REQUEST_LOG, lambda log: A.rate_breaches(log, "1 day", F.lit(D.DAILY_LIMIT))),
    "request_counts": _events(D.REQUEST_LOG, A.request_counts),
    "monthly_quota": _events(D.REQUEST_LOG, A.monthly_quota),
    # streams
    "stream_page_audit": stream_page_audit,
    "stream_price_alerts": stream_price_alerts,
    "stream_capture_dedup": stream_capture_dedup,
    "stream_rate_breaches": stream_rate_breaches,
    "stream_subscription_state": stream_subscription_state,
}


def _aug_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Captures whose documents are the augmented pages."""
    return D.derive(D.work_table(spark, sf, "pages"), {**D.CAPTURES, "html": D.PAGES_AUG["html"]})
