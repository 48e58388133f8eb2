"""On-page facts, rules and scores on literal pages."""

import time

import pytest
from pyspark.sql import functions as F

from sitegauge.constants import CATEGORY_WEIGHTS, STOP_WORDS
from sitegauge.operators import elements as E
from sitegauge.operators import page_facts as P
from sitegauge.operators import scores as S
from sitegauge.operators import structured
from sitegauge.operators import text_analytics as TA
from sitegauge.operators.rules import CATALOG, RULES
from sitegauge.plans.page_report import page_report

ARTICLE = """<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8">
<meta name="viewport" content="width=device-width, initial-scale=1.0">
<title>A Field Guide to Growing Tomatoes on Small Balconies</title>
<meta name="description" content="How to grow tomatoes.">
<meta property="og:title" content="Growing Tomatoes"><meta property="og:image" content="https://example.com/t.jpg">
<meta name="twitter:card" content="summary_large_image"><meta name="robots" content="index, follow">
<link rel="canonical" href="https://example.com/tomatoes"></head>
<body><h1>Tomatoes at home</h1><h2>Soil</h2><p>Good soil drains well. It holds water.</p><h2>Light</h2><h3>South</h3>
<img src="/a.png" alt="chart"><img src="/b.png" alt="soil"><img src="/c.png">
<a href="https://example.com/blog">Blog</a><a href="/about">About</a><a href="https://seeds.org">Seeds</a><a href="https://tools.net/x">Tools</a>
<script type="application/ld+json">
{"@context": "https://schema.org", "@type": "Article", "headline": "H", "author": {"@type": "Person", "name": "N"}}
</script></body></html>"""


def test_article_report(page):
    r = page_report(page(ARTICLE, "https://example.com/tomatoes")).first()
    assert r.title == "A Field Guide to Growing Tomatoes on Small Balconies" and r.title_length == 52
    assert (r.og_title, r.twitter_card, r.robots) == ("Growing Tomatoes", "summary_large_image", "index, follow")
    assert r.canonical == "https://example.com/tomatoes" and r.canonical_self and r.canonical_absolute
    assert (r.headings_h1_count, r.headings_h2_count, r.headings_h3_count) == (1, 2, 1)
    assert (r.images_total, r.images_without_alt) == (3, 1)
    assert (r.links_internal, r.links_external) == (2, 2)
    assert r.schema_has_structured_data and r.schema_missing == 1
    assert r.has_viewport and r.lang == "en" and r.charset == "UTF-8"


def test_missing_title(page):
    r = P.title_stats(page("<html><head></head><body></body></html>")).first()
    assert (r.title, r.title_length, r.title_words) == (None, 0, 0)


def test_malformed_page(page):
    r = page_report(page("<html><head><title>Broken</title><body><h1>Missing closing tags<p>content</body>", None)).first()
    assert r.title == "Broken" and r.headings_h1_count == 1


def test_heading_counts(page):
    markup = "<body><h1>a</h1><h1>b</h1><h2>c</h2><h2>d</h2><h2> </h2><h4>e</h4><h5>f</h5><h6>g</h6></body>"
    rows = {r.level: (r.n, r.n_empty) for r in P.headings(page(markup)).collect()}
    assert rows == {1: (2, 0), 2: (3, 1), 4: (1, 0), 5: (1, 0), 6: (1, 0)}
    assert [tuple(r)[1:] for r in P.heading_skips(page(markup)).collect()] == [(2, 4)]


@pytest.mark.parametrize("markup, base, expected", [
    ('<a href="/page1">1</a><a href="/page2">2</a><a href="https://example.com/page3">3</a>', "https://example.com", (3, 0, 3)),
    ('<a href="https://other.com">O</a><a href="https://another.com">A</a>', "https://example.com", (0, 2, 2)),
    ('<a href="#s">A</a><a href="javascript:void(0)">J</a><a href="mailto:t@test.com">E</a>', None, (0, 0, 0)),
    ('<a href="https://other.com">O</a><a href="tel:1">T</a>', None, (1, 1, 2)),
])
def test_link_classes(page, markup, base, expected):
    r = P.links_summary(page(markup, base)).first()
    assert (r.internal, r.external, r.total) == expected


def test_image_flags(page):
    r = P.images_summary(page('<img src="a.jpg"><img src="b.jpg" alt=""><img src="c.jpg" alt="Has alt">')).first()
    assert (r.total, r.without_alt, r.missing_alt, r.empty_alt, r.legacy_format) == (3, 2, 1, 1, 3)


def test_last_meta_wins_and_aliases_meet(page):
    markup = """<meta name="description" content="a"><meta name="Description" content=" b ">
    <meta property="twitter:image:alt" content="x"><meta name="twitter:creator" content="@c">"""
    r = P.meta_tags(page(markup)).first()
    assert (r.description, r.description_length, r.og_image_alt, r.twitter_site) == ("b", 1, "x", "@c")


def test_structured_data_shapes(page):
    markup = """<script type="application/ld+json">{"@context": "https://schema.org", "@type": "Article", "headline": "T"}</script>
    <script type="application/ld+json">{"@graph": [{"@type": ["WebSite", "Thing"], "name": "n"}]}</script>
    <script type="application/ld+json">{oops}</script><script type="application/ld+json">[[{"@type": "Event"}], {"x": 1}]</script>"""
    rows = [tuple(r)[1:] for r in structured.structured_data(page(markup)).orderBy("block", "type").collect()]
    assert rows == [
        (1, True, "Article", "image,datePublished,author"), (2, True, "Thing", ""), (2, True, "WebSite", "url"),
        (3, False, None, ""), (4, True, "Event", "name,startDate,location"),
    ]


def test_structured_data_of_any_depth_in_document_order(page):
    deep = "[" * 9 + '{"@graph": {"@graph": [{"@type": "A"}]}}' + "]" * 9
    markup = f'<script type="application/ld+json">[{deep}, {{"@type": "B"}}, [{{"@type": "C"}}], 5, null]</script>'
    schema = structured.with_structured(P.parse_pages(page(markup))).first().schema
    assert schema.types == ["A", "B", "C"] and schema.invalid_blocks == 0


def test_blocking_scripts_need_a_value(page):
    markup = '<head><script src="a" defer></script><script src="b" async="x"></script><script>1</script><script src="c" type="module"></script></head>'
    r = page_report(page(markup)).first()
    assert (r.scripts_count, r.render_blocking_scripts, r.defer_scripts, r.async_scripts, r.inline_script_bytes) == (4, 2, 0, 1, 1)


def test_syllables(spark):
    words = spark.createDataFrame([(w,) for w in ("hello", "world", "a", "the", "beautiful", "yxes", "edes")], "word string")
    counts = {r.word: r.n for r in TA.syllables(words).collect()}
    assert counts == {"hello": 2, "world": 1, "a": 1, "the": 1, "beautiful": 4, "yxes": 1, "edes": 1}


def test_whole_text_syllables_equal_the_word_sum(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select("doc_id", TA.T.letter_words(F.col("text")).alias("words"))
    summed = F.aggregate("words", F.lit(0), lambda acc, w: acc + TA.T.syllables(w))
    assert words.where(summed != TA.T.total_syllables(F.col("words"))).count() == 0


def test_readability_of_little_text(page):
    assert tuple(TA.readability(page("<body></body>")).first())[1:] == (0.0, 0.0, 0, 0, 0, 0.0, "unknown")
    assert TA.readability(page("<body>Hello.</body>")).first().word_count == 1


def test_stop_words_only_give_no_phrases(page):
    assert len(set(STOP_WORDS)) == len(STOP_WORDS) == 111
    assert TA.top_phrases(page("<body>the and or but not is at in of a an</body>"), 1).count() == 0


def test_top_phrases(page):
    pages = page("<body>red apple green apple red apple blue</body>")
    rows = sorted(TA.top_phrases(pages, 2).collect(), key=lambda r: r["rank"])
    assert [(r.phrase, r.n) for r in rows] == [
        ("red apple", 2), ("apple green", 1), ("green apple", 1), ("apple red", 1), ("apple blue", 1),
    ]
    assert TA.top_phrases(pages, 3, top=2).count() == 2


def test_rule_table():
    assert sum(CATEGORY_WEIGHTS.values()) == 100
    assert len({r.rule for r in RULES}) == 63
    assert len(CATALOG) == 24


def test_scores_add_up(spark, sf_dir):
    from sitegauge.sources.derived import pages_aug

    pages = pages_aug(spark, sf_dir)
    totals = S.category_scores(pages).groupBy("page_id").agg(F.sum("score").alias("total"), F.sum("max").alias("max"))
    joined = totals.join(S.page_score(pages), "page_id")
    assert joined.where((F.col("total") != F.col("score")) | (F.col("max") != 100)).count() == 0


def test_finding_texts(page):
    rows = {r.rule: r for r in S.findings(page(ARTICLE, "https://example.com/tomatoes")).collect()}
    assert rows["media.images.alt"].message == "1 of 3 images have no alt text (33%)."
    assert rows["media.images.alt"].evidence == '{"examples":["/c.png"]}'
    assert rows["content.description.short"].message == "Meta description is 21 characters."
    assert rows["structure.schema.missing_properties"].message == "Structured data is incomplete: Article lacks image, datePublished"
    assert "indexability.canonical.missing" not in rows


FACTS = (
    "title string, title_length int, description string, description_length int, og_title string, og_description string, "
    "og_image string, twitter_card string, canonical string, headings_h1_count int, images_total int, images_without_alt int, "
    "has_viewport boolean, schema_has_structured_data boolean, reading_ease double, links_internal int, lcp string, cls string, keyword_count int"
)


@pytest.mark.parametrize("facts, expected", [
    (("t", 50, "d", 140, "o", "o", "o", "summary", "c", 1, 5, 0, True, True, 65.0, 10, None, None, 1), 99),
    ((None,) * 19, 0),
    (("Good Title", 10) + (None,) * 17, 5),
    (("Test", 4) + (None,) * 7 + (3,) + (None,) * 9, 10),
    ((None,) * 10 + (4, 2) + (None,) * 7, 5),
])
def test_legacy_score(spark, facts, expected):
    row = spark.createDataFrame([facts], FACTS).select(S.legacy_score_column().alias("score")).first()
    assert row.score == expected


def test_page_audit_has_no_shuffle(page):
    plan = S.page_score(page(ARTICLE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan
    # Only the ends of elements are found in Arrow batches; flat facts stay in the JVM.
    assert plan.count("ArrowEvalPython") == 1 and plan.count("nesting(") == 1
    flat = P.viewport(page(ARTICLE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in flat and "Python" not in flat


@pytest.mark.parametrize("markup", ["<p>x</p>", "<p>", "<b><i>x</b></i>", "<a href='//h/'>x</a>"])
def test_parse_time_grows_with_the_page(page, markup):
    def seconds(n):
        frame = E.elements(page(markup * n)).agg({"close_pos": "sum"})
        start = time.perf_counter()
        frame.collect()
        return time.perf_counter() - start

    seconds(1000)
    small = min(seconds(20_000) for _ in range(2))
    assert seconds(200_000) < 12 * max(small, 0.5)
