"""The audit rules as one declarative list over the fact structs of ``plans.page_report``.

A rule is a condition, an impact and its texts. Rules never look at other rows, so evaluating
all of them is one projection per page.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.cache import column_cache
from sitegauge.functions.html import is_text, let, strip
from sitegauge.functions.urls import hostname
from sitegauge.operators.page_facts import robots_directives


@dataclass(frozen=True)
class Rule:
    category: str
    name: str
    severity: str
    impact: int
    when: Callable[[], Column]
    message: str
    fix: str
    args: Callable[[], list[Column]] = list
    evidence: Callable[[], Column] | None = None

    @property
    def rule(self) -> str:
        return f"{self.category}.{self.name}"


def c(name: str) -> Column:
    return F.col(name)


def _text(name: str) -> Column:
    return is_text(c(name))


def _as_json(**fields: str) -> Callable[[], Column]:
    return lambda: F.to_json(F.struct(*[c(path).alias(key) for key, path in fields.items()]))


def _noindex() -> Column:
    listed = robots_directives(c("meta.robots"))
    return F.exists(listed, lambda d: d.isin("noindex", "none"))


def _repeated_words() -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(c("title_facts.title"), F.lit(""))), r"(?U)\s+"), lambda w: F.length(w) > 2)
    return let(
        words,
        lambda all_words: F.array_sort(
            F.filter(F.array_distinct(all_words), lambda w: F.size(F.filter(all_words, lambda x: x == w)) > 1)
        ),
    )


def _same_h1() -> Column:
    h1 = F.lower(strip(F.coalesce(c("headings.first_h1"), F.lit(""))))
    return (h1 != "") & (h1 == F.lower(F.coalesce(c("title_facts.title"), F.lit(""))))


def _kb(name: str) -> Column:
    return F.floor(c(name) / 1024).cast("string")


def _missing_list() -> Column:
    return F.array_join(F.transform(c("schema.missing_properties"), lambda m: F.concat(m["type"], F.lit(" lacks "), F.array_join(m["missing"], ", "))), "; ")


def _alt_ratio() -> Column:
    return c("images.without_alt") / F.nullif(c("images.total"), F.lit(0))


def _description_length() -> Column:
    return F.length(c("meta.description"))


# --- fixed values: rule ids, severities, impacts, thresholds and report texts ---
RULES: tuple[Rule, ...] = (
    # content
    Rule("content", "title.missing", "critical", 8, lambda: ~_text("title_facts.title"),
         "The page has no <title>.",
         "Add a unique title that states the topic and the brand: search engines show it as the title link."),
    Rule("content", "title.short", "notice", 2, lambda: _text("title_facts.title") & (c("title_facts.title_length") < 30),
         "Title is %s characters.",
         "Short titles waste the click opportunity. There is no hard length limit — the title link is truncated by pixel width, and Google may rewrite it — but aim for a descriptive 30-60 characters.",
         lambda: [c("title_facts.title_length")], _as_json(title="title_facts.title")),
    Rule("content", "title.long", "notice", 2, lambda: c("title_facts.title_length") > 65,
         "Title is %s characters and may be rewritten or truncated.",
         "Keep the distinctive part first: Google truncates by pixel width and can replace the title link entirely.",
         lambda: [c("title_facts.title_length")], _as_json(title="title_facts.title")),
    Rule("content", "title.repetition", "notice", 2, lambda: F.size(_repeated_words()) > 0,
         "Title repeats the same word: %s.",
         "Use each significant word once; repetition reads as keyword stuffing.",
         lambda: [F.array_join(_repeated_words(), ", ")]),
    Rule("content", "title.duplicate_h1", "warning", 3, _same_h1,
         "The title tag and the H1 are identical.",
         "Give them different wording: the H1 addresses the reader, the title also has to work out of context in search results.",
         evidence=_as_json(title="title_facts.title")),
    Rule("content", "description.missing", "critical", 8, lambda: ~_text("meta.description"),
         "The page has no meta description.",
         "Write a description that summarises the page and invites the click. It is advisory text: Google ignores it when a better snippet can be built from the page."),
    Rule("content", "description.short", "notice", 2, lambda: _text("meta.description") & (_description_length() < 120),
         "Meta description is %s characters.",
         "No hard limit exists, but a short description leaves the snippet to Google. Aim for 120-160 characters, value proposition first.",
         lambda: [_description_length()], _as_json(description="meta.description")),
    Rule("content", "description.long", "notice", 2, lambda: _text("meta.description") & (_description_length() > 160),
         "Meta description is %s characters and will be cut off.",
         "The snippet is truncated by pixel width: put the useful part in the first 120 characters.",
         lambda: [_description_length()], _as_json(description="meta.description")),
    Rule("content", "content.thin", "critical", 8, lambda: c("stats.word_count") < 100,
         "Only %s words of visible text.",
         "Search engines need substance: expand the page or merge it with a related one.",
         lambda: [c("stats.word_count")], _as_json(word_count="stats.word_count")),
    Rule("content", "content.short", "warning", 5, lambda: c("stats.word_count").between(100, 299),
         "%s words of visible text — thin for most queries.",
         "Target 300+ words of text a visitor actually needs.",
         lambda: [c("stats.word_count")], _as_json(word_count="stats.word_count")),
    Rule("content", "content.no_headings", "warning", 3, lambda: c("headings.total") == 0,
         "The page has no headings at all.",
         "Structure the content with H2/H3 sections; headings are how both readers and crawlers scan."),
    Rule("content", "content.readability", "warning", 3, lambda: c("readability.grade") > 12,
         "Text reads at US grade %s — harder than the recommended 6-10.",
         "Shorten sentences, prefer common words, split long paragraphs.",
         lambda: [c("readability.grade")],
         _as_json(grade="readability.grade", avg_sentence_length="readability.avg_sentence_length")),
    Rule("content", "content.long_sentences", "notice", 2, lambda: c("stats.long_sentences") > 3,
         "%s sentences run past 25 words.",
         "Keep sentences under ~25 words for readability.",
         lambda: [c("stats.long_sentences")]),
    # indexability
    Rule("indexability", "robots.noindex", "critical", 10, _noindex,
         "Meta robots says: %s — this page is excluded from search.",
         "Remove noindex once the page is ready to rank.",
         lambda: [c("meta.robots")], _as_json(robots="meta.robots")),
    Rule("indexability", "canonical.missing", "warning", 5, lambda: ~_text("canonical_facts.canonical"),
         "No canonical URL declared.",
         'Add <link rel="canonical"> pointing at the preferred URL to consolidate duplicates.'),
    Rule("indexability", "canonical.relative", "warning", 2,
         lambda: _text("canonical_facts.canonical") & ~c("canonical_facts.canonical_absolute"),
         "Canonical is relative: %s.",
         "Use an absolute URL including scheme and host.",
         lambda: [c("canonical_facts.canonical")], _as_json(canonical="canonical_facts.canonical")),
    Rule("indexability", "canonical.noindex_conflict", "critical", 6,
         lambda: _text("canonical_facts.canonical") & _noindex(),
         "The page is both canonical to another URL and marked noindex.",
         "Pick one strategy: index it, or canonicalise it — not both.",
         evidence=_as_json(canonical="canonical_facts.canonical", robots="meta.robots")),
    Rule("indexability", "canonical.cross_domain", "warning", 4,
         lambda: _text("canonical_facts.canonical") & ~c("canonical_facts.canonical_self")
         & (hostname(c("url")) != "") & (c("canonical_facts.canonical_host") != "")
         & (hostname(c("url")) != c("canonical_facts.canonical_host")),
         "Canonical points at another domain (%s).",
         "Cross-domain canonicals hand the ranking to the other site. Keep it on your own host unless that is deliberate.",
         lambda: [c("canonical_facts.canonical_host")], _as_json(canonical="canonical_facts.canonical")),
    Rule("indexability", "html.lang_missing", "warning", 3, lambda: ~_text("document.lang"),
         "The <html> element has no lang attribute.",
         'Declare the page language (e.g. lang="fr") for search and screen readers.'),
    Rule("indexability", "meta.refresh", "warning", 3, lambda: _text("document.meta_refresh"),
         "The page uses a meta refresh: %s.",
         "Replace it with a permanent (301) redirect.",
         lambda: [c("document.meta_refresh")]),
    Rule("indexability", "hreflang.relative", "notice", 2,
         lambda: F.exists(c("hreflang"), lambda h: ~h["href"].startswith("http")),
         "%s hreflang entries are relative URLs.",
         "Use absolute URLs in hreflang annotations.",
         lambda: [F.size(F.filter(c("hreflang"), lambda h: ~h["href"].startswith("http")))]),
    Rule("indexability", "hreflang.no_xdefault", "notice", 1,
         lambda: (F.size("hreflang") > 0) & ~F.exists(c("hreflang"), lambda h: F.lower(h["lang"]) == "x-default"),
         "No x-default hreflang entry.",
         "Add an x-default entry for visitors whose language does not match any variant."),
    Rule("indexability", "meta.keywords", "notice", 1, lambda: _text("meta.keywords_meta"),
         "The obsolete meta keywords tag is present.",
         "Remove it: it has no ranking effect and exposes your keyword list."),
    # structure
    Rule("structure", "headings.h1_missing", "critical", 6, lambda: c("headings.h1_count") == 0,
         "No H1 on the page.",
         "Add one H1 stating the page's main subject."),
    Rule("structure", "headings.h1_multiple", "warning", 3, lambda: c("headings.h1_count") > 1,
         "%s H1 headings found.",
         "Keep a single H1 and demote the others to H2.",
         lambda: [c("headings.h1_count")], _as_json(h1_count="headings.h1_count")),
    Rule("structure", "headings.empty", "notice", 2, lambda: c("headings.empty") > 0,
         "%s headings are empty.",
         "Remove empty headings or fill them: they add noise to the outline.",
         lambda: [c("headings.empty")]),
    Rule("structure", "headings.skipped_levels", "notice", 3, lambda: F.size("headings.skipped_levels") > 0,
         "Heading levels jump (e.g. H%s then H%s).",
         "Keep the outline sequential: H1, then H2, then H3.",
         lambda: [F.get(c("headings.skipped_levels"), F.lit(0))["from"], F.get(c("headings.skipped_levels"), F.lit(0))["to"]],
         _as_json(skipped="headings.skipped_levels")),
    Rule("structure", "links.few_internal", "warning", 4, lambda: c("links.internal") < 3,
         "Only %s internal link(s) on the page.",
         "Link to related pages: internal links are how crawlers discover and rank the rest of the site.",
         lambda: [c("links.internal")], _as_json(internal="links.internal")),
    Rule("structure", "links.no_external", "notice", 2, lambda: c("links.external") == 0,
         "No outbound links.",
         "Cite at least one authoritative source; outbound links to trusted sites are a positive signal."),
    Rule("structure", "links.empty_anchor", "notice", 2, lambda: c("links.empty_anchor") > 0,
         "%s links have no text (and no image).",
         "Give every link an explicit label: crawlers use anchor text to understand the target.",
         lambda: [c("links.empty_anchor")]),
    Rule("structure", "links.hash_only", "notice", 1, lambda: c("links.hash_only") > 0,
         "%s links point to '#'.",
         "Point them at real URLs or make them buttons.",
         lambda: [c("links.hash_only")]),
    Rule("structure", "links.too_many", "notice", 2, lambda: c("links.total") > 100,
         "%s links on a single page.",
         "Beyond ~100 links, link equity dilutes; move secondary links to a hub page.",
         lambda: [c("links.total")]),
    Rule("structure", "schema.missing", "warning", 5, lambda: ~c("schema.has_structured_data"),
         "No structured data (JSON-LD) found.",
         "Add schema.org markup for the page type: eligible rich results in search."),
    Rule("structure", "schema.invalid", "warning", 4,
         lambda: c("schema.has_structured_data") & (c("schema.invalid_blocks") > 0),
         "%s JSON-LD block(s) are not valid JSON.",
         "Fix the syntax: an invalid block is ignored entirely by search engines.",
         lambda: [c("schema.invalid_blocks")]),
    Rule("structure", "schema.missing_properties", "notice", 3,
         lambda: c("schema.has_structured_data") & (F.size("schema.missing_properties") > 0),
         "Structured data is incomplete: %s",
         "Add the properties Google lists for that type, otherwise it is ineligible for rich results.",
         lambda: [_missing_list()],
         lambda: F.to_json(F.struct(c("schema.missing_properties").alias("missing")))),
    Rule("structure", "schema.context", "notice", 1,
         lambda: c("schema.has_structured_data") & ~c("schema.uses_schema_org"),
         "Structured data does not declare the schema.org context.",
         'Set "@context": "https://schema.org" on the top-level object.'),
    # social
    Rule("social", "og.og_title_missing", "warning", 2, lambda: ~_text("meta.og_title"),
         "Open Graph og:title is missing.",
         "Add the og:title tag: shared links then carry an image and a real title."),
    Rule("social", "og.og_description_missing", "warning", 2, lambda: ~_text("meta.og_description"),
         "Open Graph og:description is missing.",
         "Add the og:description tag: shared links then carry an image and a real title."),
    Rule("social", "og.og_image_missing", "warning", 2, lambda: ~_text("meta.og_image"),
         "Open Graph og:image is missing.",
         "Add the og:image tag: shared links then carry an image and a real title."),
    Rule("social", "og.image_alt_missing", "notice", 1, lambda: _text("meta.og_image") & ~_text("meta.og_image_alt"),
         "og:image has no og:image:alt.",
         "Describe the image for screen readers and for cases where it fails to load."),
    Rule("social", "twitter.card_missing", "notice", 1, lambda: ~_text("meta.twitter_card"),
         "No twitter:card declared.",
         "Add twitter:card (summary_large_image for articles) to control the card on X."),
    Rule("social", "twitter.card_invalid", "notice", 1,
         lambda: _text("meta.twitter_card") & ~F.lower(c("meta.twitter_card")).isin("summary", "summary_large_image", "app", "player"),
         "Unknown twitter:card value: %s.",
         "Use summary, summary_large_image, app or player.",
         lambda: [c("meta.twitter_card")]),
    # mobile
    Rule("mobile", "viewport.missing", "critical", 6, lambda: ~c("viewport.has_viewport"),
         "No viewport meta tag: the page renders as a desktop layout on phones.",
         'Add <meta name="viewport" content="width=device-width, initial-scale=1">.'),
    Rule("mobile", "viewport.width", "warning", 3, lambda: c("viewport.has_viewport") & ~c("viewport.width_device"),
         "Viewport does not set width=device-width (%s).",
         "Set width=device-width so the layout matches the device instead of the desktop canvas.",
         lambda: [c("viewport.content")]),
    Rule("mobile", "viewport.zoom_blocked", "warning", 2,
         lambda: c("viewport.has_viewport") & c("viewport.user_scalable_disabled"),
         "The viewport forbids user zoom (user-scalable=no or maximum-scale=1).",
         "Let visitors zoom: blocking it fails accessibility checkpoints."),
    # performance
    Rule("performance", "perf.blocking_styles", "warning", 3, lambda: c("signals.render_blocking_styles") > 3,
         "%s stylesheets block rendering.",
         "Inline the critical CSS and load the rest asynchronously.",
         lambda: [c("signals.render_blocking_styles")]),
    Rule("performance", "perf.blocking_scripts", "warning", 4, lambda: c("signals.render_blocking_scripts") > 2,
         "%s scripts in <head> block rendering.",
         "Add defer or async, or move them to the end of the body.",
         lambda: [c("signals.render_blocking_scripts")], _as_json(count="signals.render_blocking_scripts")),
    Rule("performance", "perf.image_dimensions", "warning", 3, lambda: c("images.without_dimensions") > 0,
         "%s images have no width/height.",
         "Set the intrinsic dimensions: the browser then reserves space and the layout stops jumping (CLS).",
         lambda: [c("images.without_dimensions")]),
    Rule("performance", "perf.lazy_loading", "notice", 2, lambda: (c("images.total") >= 10) & (c("images.lazy") == 0),
         "%s images, none lazy-loaded.",
         'Add loading="lazy" to images below the fold.',
         lambda: [c("images.total")]),
    Rule("performance", "perf.dom_huge", "warning", 4, lambda: c("signals.dom_nodes") > 3000,
         "%s DOM nodes — well past the ~1500 recommended.",
         "Simplify the markup or virtualise long lists.",
         lambda: [c("signals.dom_nodes")], _as_json(dom_nodes="signals.dom_nodes")),
    Rule("performance", "perf.dom_large", "notice", 2, lambda: c("signals.dom_nodes").between(1501, 3000),
         "%s DOM nodes, above the ~1500 recommended.",
         "Trim wrapper elements and repeated lists.",
         lambda: [c("signals.dom_nodes")]),
    Rule("performance", "perf.inline_js", "notice", 2, lambda: c("signals.inline_script_bytes") > 100_000,
         "%s KB of inline JavaScript.",
         "Extract it into cacheable files: inline code is re-downloaded on every page.",
         lambda: [_kb("signals.inline_script_bytes")]),
    Rule("performance", "perf.inline_css", "notice", 2, lambda: c("signals.inline_style_bytes") > 60_000,
         "%s KB of inline CSS.",
         "Move it to a stylesheet so browsers can cache it.",
         lambda: [_kb("signals.inline_style_bytes")]),
    Rule("performance", "perf.third_party", "notice", 2, lambda: F.size("third_party") >= 5,
         "Assets come from %s third-party hosts.",
         "Each host costs a DNS lookup and a connection: self-host or remove.",
         lambda: [F.size("third_party")],
         lambda: F.to_json(F.struct(F.transform(c("third_party"), lambda h: h["host"]).alias("hosts")))),
    Rule("performance", "perf.preconnect", "notice", 1,
         lambda: F.size("third_party").between(1, 4) & (c("signals.preconnect") == 0),
         "Third-party assets are loaded without preconnect.",
         'Add <link rel="preconnect"> for the critical third-party origins.'),
    Rule("performance", "perf.lcp", "warning", 3, lambda: c("vitals.lcp") == "poor",
         "Rendering signals suggest a poor Largest Contentful Paint.",
         "Compress the main image, remove render-blocking resources."),
    Rule("performance", "perf.lcp_improve", "notice", 2, lambda: c("vitals.lcp") == "needs improvement",
         "Rendering signals suggest LCP needs improvement.",
         "Trim the critical path: smaller hero image, fewer blocking resources."),
    Rule("performance", "perf.cls", "warning", 3, lambda: c("vitals.cls") == "poor",
         "Rendering signals suggest a poor Cumulative Layout Shift.",
         "Reserve space for images, ads and embeds."),
    Rule("performance", "perf.html_size", "warning", 3, lambda: c("signals.dom_size_bytes") > 500_000,
         "HTML document is %s KB.",
         "Aim for under ~100 KB of HTML; move data out of the markup.",
         lambda: [_kb("signals.dom_size_bytes")]),
    # media; the alt rule has two severities by the share of images without text
    Rule("media", "images.alt", "critical", 6, lambda: _alt_ratio() > 0.5,
         "%s of %s images have no alt text (%s%%).",
         "Describe each content image; use an empty alt only for decoration.",
         lambda: [c("images.without_alt"), c("images.total"), F.bround(_alt_ratio() * 100, 0).cast("int")],
         lambda: F.to_json(F.struct(c("images.examples_missing_alt").alias("examples")))),
    Rule("media", "images.alt", "warning", 4, lambda: (c("images.without_alt") > 0) & (_alt_ratio() <= 0.5),
         "%s of %s images have no alt text (%s%%).",
         "Describe each content image; use an empty alt only for decoration.",
         lambda: [c("images.without_alt"), c("images.total"), F.bround(_alt_ratio() * 100, 0).cast("int")],
         lambda: F.to_json(F.struct(c("images.examples_missing_alt").alias("examples")))),
    Rule("media", "images.format", "notice", 2, lambda: c("images.legacy_format") > 0,
         "%s images are not WebP/AVIF.",
         "Serve modern formats: typically 25-50% smaller for the same quality.",
         lambda: [c("images.legacy_format")]),
    Rule("media", "images.srcset", "notice", 1, lambda: (c("images.total") >= 5) & (c("images.with_srcset") == 0),
         "No responsive images (srcset/sizes).",
         "Provide several widths so phones do not download desktop-size images."),
    Rule("media", "images.data_uri", "notice", 1, lambda: c("images.data_uri") >= 5,
         "%s images are inlined as data URIs.",
         "Inline only tiny icons: data URIs block caching and inflate the HTML.",
         lambda: [c("images.data_uri")]),
)

# --- fixed values: the documented checks, whose ids are coarser than the emitted rule ids ---
CATALOG = (
    ("content.title.missing", "content", "critical", "Page has a <title>."),
    ("content.title.length", "content", "warning", "Title is 30-60 characters."),
    ("content.description.missing", "content", "critical", "Meta description exists."),
    ("content.description.length", "content", "warning", "Description is 120-160 characters."),
    ("content.thin", "content", "critical", "At least 300 words of visible text."),
    ("content.readability", "content", "warning", "Reads at US grade 6-10."),
    ("indexability.robots.noindex", "indexability", "critical", "Page is indexable."),
    ("indexability.canonical", "indexability", "warning", "Absolute, self-referencing canonical."),
    ("indexability.html.lang", "indexability", "warning", "Language declared on <html>."),
    ("indexability.hreflang", "indexability", "notice", "hreflang set is absolute and has x-default."),
    ("structure.h1", "structure", "critical", "Exactly one H1."),
    ("structure.headings.order", "structure", "notice", "Heading levels are sequential."),
    ("structure.links.internal", "structure", "warning", "At least 3 internal links."),
    ("structure.links.anchors", "structure", "notice", "Every link has anchor text."),
    ("structure.schema", "structure", "warning", "Valid JSON-LD with the properties Google needs."),
    ("social.og", "social", "warning", "og:title, og:description and og:image present."),
    ("social.twitter", "social", "notice", "Valid twitter:card."),
    ("mobile.viewport", "mobile", "critical", "width=device-width viewport, zoom allowed."),
    ("performance.blocking", "performance", "warning", "No render-blocking head resources."),
    ("performance.cls", "performance", "warning", "Images have intrinsic dimensions."),
    ("performance.dom", "performance", "notice", "DOM under ~1500 nodes."),
    ("performance.weight", "performance", "notice", "Bounded inline code and HTML size."),
    ("media.alt", "media", "warning", "Images carry alt text."),
    ("media.formats", "media", "notice", "WebP/AVIF images with srcset."),
)


@column_cache
def findings_column(texts: bool = True) -> Column:
    """Array of the findings of one page; ``texts=False`` leaves message, fix and evidence out."""

    def finding(rule: Rule) -> Column:
        fields = [
            F.lit(rule.rule).alias("rule"), F.lit(rule.category).alias("category"),
            F.lit(rule.severity).alias("severity"), F.lit(rule.impact).alias("impact"),
        ]
        if texts:
            args = rule.args()
            message = F.format_string(rule.message, *[a.cast("string") for a in args]) if args else F.lit(rule.message)
            evidence = rule.evidence() if rule.evidence else F.lit(None).cast("string")
            fields += [message.alias("message"), F.lit(rule.fix).alias("fix"), evidence.alias("evidence")]
        return F.when(F.coalesce(rule.when(), F.lit(False)), F.struct(*fields))

    return F.array_compact(F.array(*[finding(rule) for rule in RULES]))
