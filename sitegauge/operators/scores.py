"""Findings, category scores, page score, the two additive scores and their status bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.constants import CATEGORY_WEIGHTS, RULESET_VERSION
from sitegauge.functions.cache import column_cache
from sitegauge.functions.html import is_text, let
from sitegauge.functions.numbers import rounded
from sitegauge.operators.elements import explode_rows, parse_pages
from sitegauge.operators import page_facts as P
from sitegauge.operators.rules import CATALOG, findings_column
from sitegauge.operators.text_analytics import quick_text_column
from sitegauge.functions.urls import is_external_link
from sitegauge.plans.page_report import page_facts

SEVERITIES = ("critical", "warning", "notice")


def with_findings(facts: DataFrame, texts: bool = True) -> DataFrame:
    """Add the ``findings`` array to page facts."""
    return facts.withColumn("findings", findings_column(texts))


def severity_order(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def findings(pages: DataFrame) -> DataFrame:
    return explode_rows(with_findings(page_facts(pages)), F.col("findings"), "page_id")


def findings_ranked(pages: DataFrame) -> DataFrame:
    """Findings with their report position: severity, impact descending, rule id."""
    ordered = F.array_sort(F.transform(
        F.col("findings"),
        lambda f: F.struct(severity_order(f["severity"]).alias("o"), (-f["impact"]).alias("i"), f["rule"].alias("rule"), f.alias("f")),
    ))
    ranked = F.transform(
        ordered,
        lambda x, n: F.struct(
            (n + 1).cast("int").alias("rank"), *[x["f"][k].alias(k) for k in
            ("rule", "category", "severity", "impact", "message", "fix", "evidence")]
        ),
    )
    return explode_rows(with_findings(page_facts(pages)), ranked, "page_id")


@column_cache
def categories_column() -> Column:
    """Score of every category, also of those without finding."""
    def entry(category: str, weight: int) -> Column:
        own = F.filter(F.col("findings"), lambda f: f["category"] == category)
        return let(
            own,
            lambda found: let(
                F.aggregate(found, F.lit(0), lambda acc, f: acc + f["impact"]),
                lambda lost: F.struct(
                    F.lit(category).alias("category"), F.greatest(F.lit(0), F.lit(weight) - lost).alias("score"),
                    F.lit(weight).alias("max"), lost.alias("lost"), F.size(found).alias("issues"),
                ),
            ),
        )

    return F.array(*[entry(name, weight) for name, weight in CATEGORY_WEIGHTS.items()])


def with_scores(found: DataFrame) -> DataFrame:
    """Add ``categories`` and the ``audit`` struct to rows with ``findings``."""
    def severity_count(name: str) -> Column:
        return F.size(F.filter(F.col("findings"), lambda f: f["severity"] == name)).alias(name)

    staged = found.withColumn("categories", categories_column()).withColumn(
        "counts", F.struct(*[severity_count(s) for s in SEVERITIES])
    )
    staged = staged.withColumn("audit_score", F.aggregate(F.col("categories"), F.lit(0), lambda acc, x: acc + x["score"]))
    score, n = F.col("audit_score"), F.col("counts")
    grade = (
        F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C")
        .when(score >= 60, "D").when(score >= 40, "E").otherwise("F")
    )
    # --- fixed values: the four summary sentences ---
    summary = (
        F.when(n["critical"] > 0, F.format_string(
            "%d critical issue(s) block this page from ranking well, %d warning(s) and %d notice(s).",
            n["critical"], n["warning"], n["notice"]))
        .when(n["warning"] > 0, F.format_string(
            "No blocking issue, but %d warning(s) and %d notice(s) hold the score at %d/100.",
            n["warning"], n["notice"], score))
        .when(n["notice"] > 0, F.format_string("Solid page: %d minor notice(s), score %d/100.", n["notice"], score))
        .otherwise(F.format_string(f"No issue found by ruleset {RULESET_VERSION}: score %d/100.", score))
    )
    audit = F.struct(
        score.alias("score"), grade.alias("grade"), F.lit(100).alias("max_score"),
        F.lit(RULESET_VERSION).alias("ruleset"), summary.alias("summary"), n.alias("counts"),
        F.size("findings").alias("issues_total"),
    )
    return staged.withColumn("audit", audit).drop("counts", "audit_score")


def audited(pages: DataFrame, texts: bool = False) -> DataFrame:
    return with_scores(with_findings(page_facts(pages), texts))


def category_scores(pages: DataFrame) -> DataFrame:
    return explode_rows(audited(pages), F.col("categories"), "page_id")


def page_score(pages: DataFrame) -> DataFrame:
    return flat_scores(audited(pages))


def flat_scores(scored: DataFrame) -> DataFrame:
    return scored.select(
        "page_id", "url", "audit.score", "audit.grade",
        *[F.col(f"audit.counts.{s}").alias(s) for s in SEVERITIES], "audit.issues_total", "audit.summary",
    )


# --- fixed values: points of the additive score ---


@column_cache
def legacy_score_column() -> Column:
    """Additive score over flat facts named as in ``page_report``, capped at 100.

    Nulls read as absent, so partial fact rows score what they have.
    """
    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    def points(condition: Column, value: int) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0)

    title, description = is_text(F.col("title")), is_text(F.col("description"))
    ease, h1, total = F.coalesce(F.col("reading_ease"), F.lit(0.0)), number("headings_h1_count"), number("images_total")
    parts = [
        F.when(title & number("title_length").between(30, 65), 10).when(title, 5).otherwise(0),
        F.when(description & number("description_length").between(120, 160), 10).when(description, 5).otherwise(0),
        points(is_text(F.col("og_title")), 5), points(is_text(F.col("og_description")), 5),
        points(is_text(F.col("og_image")), 5), points(is_text(F.col("twitter_card")), 3),
        points(is_text(F.col("canonical")), 5),
        F.when(h1 == 1, 10).when(h1 > 1, 5).otherwise(0),
        F.when(total > 0, F.floor((total - number("images_without_alt")) / F.nullif(total, F.lit(0)) * 10).cast("int")).otherwise(0),
        points(F.col("has_viewport"), 10), points(F.col("schema_has_structured_data"), 10),
        F.when(ease.between(60, 70), 8).when(ease >= 50, 4).otherwise(0),
        F.least(F.lit(5), number("links_internal")),
        points(F.col("lcp") == "good", 3), points(F.col("cls") == "good", 2),
        points(number("keyword_count") > 0, 3),
    ]
    score = F.lit(0)
    for part in parts:
        score = score + part
    return F.least(F.lit(100), score)


def legacy_score(report: DataFrame) -> DataFrame:
    return report.select("page_id", legacy_score_column().alias("score"))


def quick_facts(pages: DataFrame) -> DataFrame:
    """Facts of the in-page check: first matching tags, raw anchors, whole body text."""
    els = F.col("els")

    def first_meta(attribute: str, name: str) -> Column:
        found = F.filter(els, lambda e: (e["tag"] == "meta") & F.coalesce(e["attrs"][attribute] == name, F.lit(False)))
        return F.coalesce(F.get(found, F.lit(0))["attrs"]["content"], F.lit(""))

    links = F.transform(
        F.filter(els, lambda e: (e["tag"] == "a") & e["attrs"]["href"].isNotNull()),
        lambda e: is_external_link(e["attrs"]["href"], F.col("url")),
    )
    rows = parse_pages(pages).select(
        "page_id",
        P.title_column()["title"].alias("title"),
        first_meta("name", "description").alias("description"),
        first_meta("name", "viewport").alias("viewport"),
        first_meta("name", "robots").alias("robots"),
        first_meta("property", "og:title").alias("og_title"),
        F.get(F.filter(els, lambda e: (e["tag"] == "link") & F.coalesce(e["attrs"]["rel"] == "canonical", F.lit(False))), F.lit(0))["attrs"]["href"].alias("canonical"),
        *[F.size(F.filter(els, lambda e: e["tag"] == tag)).alias(tag) for tag in ("h2", "h3", "h4")],
        links.alias("links"),
        quick_text_column().alias("text"),
        P.image_facts_column().alias("images"),
    )
    return rows.withColumns({
        "title": F.coalesce("title", F.lit("")),
        "links_total": F.size("links"),
        "links_external": F.size(F.filter("links", lambda x: x)),
        "words": F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " "))),
    }).drop("links", "text")


# --- fixed values: points and grades of the in-page score ---


def quick_score(pages: DataFrame) -> DataFrame:
    """Score of the in-page check. The h1 and image parts never change there: 0 and 10."""
    title, description = F.length("title"), F.length("description")
    parts = {
        "title_points": F.when(title.between(30, 60), 25).when(title.between(20, 70), 17).when(title > 0, 8).otherwise(0),
        "description_points": F.when(description.between(120, 160), 25).when(description.between(80, 180), 17)
        .when(description > 0, 8).otherwise(0),
        "heading_points": F.when(F.col("h2") > 0, 5).otherwise(0) + F.when(F.col("h3") > 0, 3).otherwise(0)
        + F.when(F.col("h4") > 0, 2).otherwise(0),
        "link_points": F.lit(15) - F.when(F.col("links_total") == F.col("links_external"), 5).otherwise(0)
        - F.when((F.col("links_external") == 0) & (F.col("links_total") > 0), 3).otherwise(0),
        "image_points": F.lit(10),
        "content_points": F.when(F.col("words") >= 300, 5).otherwise(0),
    }
    scored = quick_facts(pages).select("page_id", *[v.alias(k) for k, v in parts.items()])
    total = F.lit(0)
    for name in parts:
        total = total + F.col(name)
    scored = scored.withColumn("score", F.least(F.lit(100), total))
    score = F.col("score")
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    return scored.withColumn("grade", grade)


def status_bands(pages: DataFrame) -> DataFrame:
    """Six-row checklist of the in-page check per page: ``(page_id, check, status, advice)``."""
    def present(name: str) -> Column:
        return is_text(F.col(name))

    def sized(name: str, low: int, high: int) -> Column:
        return F.when(~present(name), "fail").when(F.length(name).between(low, high), "pass").otherwise("warn")

    none = F.lit(None).cast("string")
    noindex = F.col("robots").contains("noindex")
    # --- fixed values: checks and advice ---
    checks = [
        ("Title Tag", sized("title", 30, 60),
         F.when(~present("title"), "Add a title tag (30–60 characters)")
         .when(F.length("title") < 30, "Too short — aim for 30–60 chars")
         .when(F.length("title") > 60, "Too long — trim to 60 chars")),
        ("Meta Description", sized("description", 120, 160),
         F.when(~present("description"), "Add a meta description (120–160 characters)")
         .when(F.length("description") < 120, "Too short — aim for 120–160 chars")
         .when(F.length("description") > 160, "Too long — trim to 160 chars")),
        ("Canonical URL", F.when(present("canonical"), "pass").otherwise("warn"),
         F.when(present("canonical"), none).otherwise("Consider adding a canonical URL")),
        ("Viewport Meta", F.when(present("viewport"), "pass").otherwise("fail"),
         F.when(present("viewport"), none).otherwise("Add a viewport meta tag for mobile")),
        ("Robots Meta", F.when(noindex, "warn").otherwise("pass"),
         F.when(noindex, "Page is set to noindex!").otherwise(none)),
        ("Open Graph Title", F.when(present("og_title"), "pass").otherwise("warn"),
         F.when(present("og_title"), none).otherwise("Add OG tags for social sharing")),
    ]
    rows = F.array(*[
        F.struct(F.lit(name).alias("check"), status.alias("status"), advice.alias("advice")) for name, status, advice in checks
    ])
    return explode_rows(quick_facts(pages), rows, "page_id")


def category_bands(pages: DataFrame) -> DataFrame:
    """Band of every category score and of the share of images with alt text."""
    ratio = F.col("score") / F.col("max")
    band = F.when(ratio >= 0.85, "pass").when(ratio >= 0.6, "warn").otherwise("fail")
    return category_scores(pages).select("page_id", "category", band.alias("status"))


def alt_bands(pages: DataFrame) -> DataFrame:
    facts = parse_pages(pages).select("page_id", P.image_facts_column().alias("i"))
    total, bare = F.col("i.total"), F.col("i.without_alt")
    pct = F.when(total > 0, F.floor((total - bare) / F.nullif(total, F.lit(0)) * 100 + 0.5)).otherwise(100).cast("int")
    staged = facts.select("page_id", pct.alias("alt_pct"))
    band = F.when(F.col("alt_pct") >= 80, "pass").when(F.col("alt_pct") >= 50, "warn").otherwise("fail")
    return staged.withColumn("status", band)


def rules_catalog(pages: DataFrame) -> DataFrame:
    """The documented checks with their category weight and the findings counted in the category."""
    rows = [(rule, category, severity, check, CATEGORY_WEIGHTS[category]) for rule, category, severity, check in CATALOG]
    catalog = pages.sparkSession.createDataFrame(rows, "rule string, category string, severity string, check string, weight int")
    counted = category_scores(pages).groupBy("category").agg(
        F.sum("issues").alias("issues"), F.count_if(F.col("issues") > 0).alias("pages")
    )
    return catalog.join(counted, "category", "left").select(
        "rule", "category", "severity", "check", "weight", F.coalesce("issues", F.lit(0)).alias("issues"),
        F.coalesce("pages", F.lit(0)).alias("pages"),
    )


def grade_by_host(pages: DataFrame) -> DataFrame:
    """Pages and average score by host and grade: the flagship corpus report."""
    from sitegauge.functions.urls import hostname

    return (
        page_score(pages)
        .groupBy(hostname(F.col("url")).alias("host"), "grade")
        .agg(F.count("*").alias("pages"), rounded(F.avg("score"), 2).alias("avg_score"), F.sum("critical").alias("critical"))
    )
