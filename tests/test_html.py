"""Tokens, element tree and visible text on hand-made markup."""

from pyspark.sql import functions as F

from sitegauge.functions import html as H
from sitegauge.operators import elements as E


def elements_of(page, markup):
    rows = E.elements(page(markup)).orderBy("pos").collect()
    return [(r.tag, r.pos, r.close_pos) for r in rows]


def text_of(page, markup):
    return E.visible_text(page(markup)).first().text


def test_nested_elements_of_one_name_pair_by_level(page):
    assert elements_of(page, "<div><div>a</div>b</div>") == [("div", 0, 5), ("div", 1, 3)]


def test_closing_tag_ends_what_was_opened_inside(page):
    markup = "<html><body><h1>Missing <b>closing<p>content</body>"
    assert elements_of(page, markup) == [("html", 0, 9), ("body", 1, 8), ("h1", 2, 8), ("b", 4, 8), ("p", 6, 8)]


def test_stray_closing_tag_is_ignored(page):
    assert elements_of(page, "<p>a</span>b</p>") == [("p", 0, 4)]


def test_void_and_self_closed_elements_have_no_content(page):
    assert elements_of(page, "<br><img src=x><div/>t") == [("br", 0, 0), ("img", 1, 1), ("div", 2, 2)]


def test_attributes(page):
    markup = """<a href='a>b' DEFER title="x &amp; &#8364; &#x27;" data-n=5 href="last">t</a>"""
    attrs = E.elements(page(markup)).first().attrs
    assert attrs == {"href": "last", "defer": "", "title": "x & € '", "data-n": "5"}


def test_script_content_is_not_markup(page):
    found = elements_of(page, "<script>var t='</p><h1>';</script><p>x</p>")
    assert [t for t, _, _ in found] == ["script", "p"]


def test_lone_angle_bracket_is_text(page):
    assert text_of(page, "<body>1 < 2 and 3<4</body>") == "1 < 2 and 3<4"


def test_visible_text_is_reversed_and_keeps_comments(page):
    markup = "<body>one<!-- note --><nav>menu <form>f</form></nav><p>two &lt;b&gt;</p><aside>no</aside></body>after"
    assert text_of(page, markup) == "two <b> note one"


def test_unclosed_boilerplate_ends_with_its_parent(page):
    assert text_of(page, "<body><div>a<form>b</div>c</body>") == "c a"


def test_text_without_body_is_the_whole_page(page):
    assert text_of(page, "<p>a</p><footer>b</footer><p>c</p>") == "c a"


def test_unescape_leaves_unknown_and_invalid_references(spark):
    row = spark.range(1).select(
        H.unescape(F.lit("&bogus; &#99999999; &#xD800; &#65;&#x42;")).alias("a"), H.unescape(F.lit("&amp;lt;")).alias("b")
    ).first()
    assert row.a == "&bogus; &#99999999; &#xD800; AB"
    assert row.b == "&lt;"


def test_large_page_stays_in_linear_reach(page):
    markup = "<body>" + "<div><p>word</p></div>" * 20_000 + "</body>"
    assert E.parse_pages(page(markup)).select(F.size("tokens")).first()[0] == 100_002
