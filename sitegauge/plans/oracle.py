"""Comparison SQL for the registered queries, in the dialect of an independent engine.

The page part is written relationally (token rows, running levels, interval joins), unlike the
row-wise expressions of the library, so the two agree only if both are right. It relies on the
test pages being well formed where nesting matters.
"""

from __future__ import annotations

from sitegauge.constants import (
    ALLOWED_PORTS,
    BLOCKED_HOST_SUFFIXES,
    BLOCKED_HOSTNAMES,
    BOILERPLATE_TAGS,
    CATEGORY_WEIGHTS,
    COMMERCIAL_MODIFIERS,
    METADATA_ADDRESSES,
    ROUTE_RATE_LIMITS,
    SCHEMA_REQUIREMENTS,
    STOP_WORDS,
    VOID_TAGS,
)
from sitegauge.functions.urls import NON_PUBLIC_NETWORKS, network_bounds
from sitegauge.operators.page_facts import META_KEYS
from sitegauge.operators.rules import CATALOG, RULES
from sitegauge.sources import derived as D


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def derived(columns: dict[str, str], table: str, where: str = "") -> str:
    items = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return f"SELECT {items} FROM {table}" + (f" WHERE {where}" if where else "")


def attr(name: str, e: str = "") -> str:
    p = f"{e}." if e else ""
    return f"list_extract(list_reverse({p}vals), list_position(list_reverse({p}names), '{name}'))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def unescape(x: str) -> str:
    for entity, char in (("&#8364;", "€"), ("&#x27;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&iuml;", "ï"), ("&Eacute;", "É"),
                         ("&uuml;", "ü"), ("&#150;", "–"), ("&#00000065;", "A"), ("&#x0000000042;", "B"), ("&szlig;", "ß"), ("&frac12;", "½"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def host(x: str) -> str:
    return f"lower(regexp_extract(coalesce({x}, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]*)', 1))"


SCHEME = "'^[A-Za-z][A-Za-z0-9+.-]*:'"


def host_of(x: str, base: str) -> str:
    return (f"CASE WHEN coalesce({x}, '') = '' THEN '' WHEN regexp_matches({x}, {SCHEME}) OR {x} LIKE '//%' "
            f"THEN {host(x)} ELSE {host(base)} END")


def resolve(base: str, ref: str) -> str:
    origin = f"regexp_extract({base}, '^[a-z]+://[^/?#]*', 0)"
    path = f"regexp_extract({base}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    folder = f"regexp_replace({path}, '[^/]*$', '')"
    query = f"regexp_extract({base}, '^[^?#]*(\\?[^#]*)', 1)"
    return (
        f"CASE WHEN {ref} = '' THEN {base} WHEN regexp_matches({ref}, {SCHEME}) THEN {ref} "
        f"WHEN {ref} LIKE '//%' THEN regexp_extract({base}, '^[a-z]+:', 0) || {ref} "
        f"WHEN {ref} LIKE '#%' THEN regexp_replace({base}, '#.*$', '') || {ref} "
        f"WHEN {ref} LIKE '?%' THEN {origin} || {path} || {ref} "
        f"WHEN {ref} LIKE '/%' THEN {origin} || {ref} "
        f"WHEN {ref} LIKE '../%' THEN {origin} || regexp_replace({folder}, '[^/]*/$', '') || substr({ref}, 4) "
        f"ELSE {origin} || {folder} || {ref} END"
    )


TOKEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z][^>]*>|<[!?][^>]*>|[^<]+"
ATTR = r"""([a-zA-Z_:@][-a-zA-Z0-9_:.]*)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?"""
_ATTR_VALUE = "CASE WHEN v LIKE '\"%' OR v LIKE '''%' THEN substr(v, 2, length(v) - 2) ELSE v END"
_BODY = "regexp_extract(raw, '(?is)^<[a-z][^\\s/>]*([^>]*)>', 1)"
_WHOLE = "(tag IN ('script', 'style') AND regexp_matches(raw, '(?is)</(script|style)\\s*>$'))"
_LEAF = f"(tag IN {_in(VOID_TAGS)} OR raw LIKE '%/>' OR {_WHOLE})"
_HEADINGS = "('h1', 'h2', 'h3', 'h4', 'h5', 'h6')"


def page_ctes(source: str) -> str:
    """Tokens, elements with their ends, text nodes and visible text of ``source`` pages."""
    return f"""
src AS ({source}),
tok AS (
  SELECT page_id, url, unnest(t) AS raw, generate_subscripts(t, 1) - 1 AS pos, len(t) AS n_tok
  FROM (SELECT page_id, url, regexp_extract_all(html, '{TOKEN}') AS t FROM src)
),
tk AS (
  SELECT *, CASE WHEN raw NOT LIKE '<%' THEN 'text' WHEN raw LIKE '<!--%' THEN 'comment' WHEN raw LIKE '</%' THEN 'close'
      WHEN raw LIKE '<!%' THEN 'decl' ELSE 'open' END AS kind,
    CASE WHEN regexp_matches(raw, '^</?[a-zA-Z]') THEN lower(regexp_extract(raw, '^</?([a-zA-Z][^\\s/>]*)', 1)) END AS tag
  FROM tok
),
lv AS (
  SELECT *, sum(CASE WHEN kind = 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, tag ORDER BY pos)
    + CASE WHEN kind = 'close' THEN 1 ELSE 0 END AS lvl
  FROM tk WHERE kind = 'close' OR (kind = 'open' AND NOT {_LEAF})
),
ends AS (
  SELECT page_id, pos, kind, coalesce(min(CASE WHEN kind = 'close' THEN pos END) OVER (
    PARTITION BY page_id, tag, lvl ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n_tok) AS close_pos
  FROM lv
),
el AS (
  SELECT t.page_id, t.url, t.pos, t.tag, t.raw, t.n_tok, coalesce(e.close_pos, t.pos) AS close_pos,
    list_transform(regexp_extract_all({_BODY.replace('raw', 't.raw')}, '{ATTR}', 1), lambda n: lower(n)) AS names,
    list_transform(regexp_extract_all({_BODY.replace('raw', 't.raw')}, '{ATTR}', 2), lambda v: coalesce({unescape(_ATTR_VALUE)}, '')) AS vals
  FROM tk t LEFT JOIN ends e ON e.page_id = t.page_id AND e.pos = t.pos AND e.kind = 'open' WHERE t.kind = 'open'
),
txt AS (SELECT page_id, pos, {trim(unescape('raw'))} AS s FROM tk WHERE kind = 'text'),
body AS (SELECT page_id, min(pos) AS pos, arg_min(close_pos, pos) AS close_pos FROM el WHERE tag = 'body' GROUP BY page_id),
head AS (SELECT page_id, min(pos) AS pos, arg_min(close_pos, pos) AS close_pos FROM el WHERE tag = 'head' GROUP BY page_id),
dep AS (
  SELECT *, sum(CASE WHEN tag IN {_in(BOILERPLATE_TAGS)} AND NOT {_LEAF} AND kind = 'open' THEN 1
      WHEN tag IN {_in(BOILERPLATE_TAGS)} AND kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth
  FROM tk
),
chunk AS (
  SELECT d.page_id, d.pos, {trim("CASE WHEN d.kind = 'text' THEN " + unescape('d.raw') + " ELSE regexp_replace(d.raw, '(?s)^<!--|-->$', '', 'g') END")} AS s
  FROM dep d JOIN body b USING (page_id)
  WHERE d.kind IN ('text', 'comment') AND d.depth = 0 AND d.pos > b.pos AND d.pos < b.close_pos
),
vis AS (
  SELECT src.page_id, coalesce(v.text, '') AS text FROM src
  LEFT JOIN (SELECT page_id, string_agg(s, ' ' ORDER BY pos DESC) AS text FROM chunk WHERE s <> '' GROUP BY page_id) v USING (page_id)
),
etext AS (
  SELECT e.page_id, e.pos, coalesce(string_agg(x.s, ' ' ORDER BY x.pos) FILTER (WHERE x.s <> ''), '') AS text
  FROM el e LEFT JOIN txt x ON x.page_id = e.page_id AND x.pos > e.pos AND x.pos < e.close_pos
  WHERE e.tag IN ('title', 'a', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') GROUP BY e.page_id, e.pos
),
metas AS (
  SELECT page_id, pos, lower({trim("coalesce(nullif(" + attr('name') + ", ''), " + attr('property') + ", '')")}) AS key,
    {trim("coalesce(" + attr('content') + ", '')")} AS content FROM el WHERE tag = 'meta'
),
meta AS (
  SELECT src.page_id, {", ".join(f"m.{k}" for k in META_KEYS)} FROM src LEFT JOIN (
    SELECT page_id, {", ".join(f"arg_max(content, pos) FILTER (WHERE key IN {_in(v)}) AS {k}" for k, v in META_KEYS.items())}
    FROM metas GROUP BY page_id) m USING (page_id)
),
title AS (
  SELECT src.page_id, nullif(t.title, '') AS title, length(coalesce(t.title, '')) AS title_length,
    CASE WHEN coalesce(t.title, '') = '' THEN 0 ELSE len(regexp_split_to_array(t.title, '\\s+')) END AS title_words
  FROM src LEFT JOIN (
    SELECT e.page_id, arg_min(x.text, e.pos) AS title FROM el e JOIN etext x USING (page_id, pos) WHERE e.tag = 'title' GROUP BY e.page_id
  ) t USING (page_id)
),
doc AS (
  SELECT src.page_id, d.lang, d.charset, d.meta_refresh FROM src LEFT JOIN (
    SELECT page_id, arg_min({attr('lang')}, pos) FILTER (WHERE tag = 'html') AS lang,
      arg_min({attr('charset')}, pos) FILTER (WHERE tag = 'meta' AND {attr('charset')} IS NOT NULL) AS charset,
      arg_min(coalesce({attr('content')}, ''), pos) FILTER (WHERE tag = 'meta' AND lower({attr('http-equiv')}) = 'refresh') AS meta_refresh
    FROM el GROUP BY page_id) d USING (page_id)
),
canon AS (
  SELECT src.page_id, c.href AS canonical, coalesce(regexp_matches(c.href, {SCHEME}), false) AS canonical_absolute,
    coalesce(regexp_replace({resolve('src.url', 'c.href')}, '/+$', '') = regexp_replace(src.url, '/+$', ''), false) AS canonical_self,
    coalesce({host_of('c.href', 'src.url')}, '') AS canonical_host
  FROM src LEFT JOIN (
    SELECT page_id, nullif(arg_min({trim(attr('href'))}, pos), '') AS href FROM el WHERE tag = 'link' AND {attr('rel')} LIKE '%canonical%' GROUP BY page_id
  ) c USING (page_id)
),
hre AS (
  SELECT page_id, pos, {attr('hreflang')} AS lang, coalesce({attr('href')}, '') AS href, url FROM el
  WHERE tag = 'link' AND {attr('rel')} LIKE '%alternate%' AND coalesce({attr('hreflang')}, '') <> ''
),
hd AS (SELECT e.page_id, e.pos, cast(substr(e.tag, 2, 1) AS int) AS level, x.text FROM el e JOIN etext x USING (page_id, pos) WHERE e.tag IN {_HEADINGS}),
lvls AS (SELECT page_id, level, lead(level) OVER (PARTITION BY page_id ORDER BY level) AS nxt FROM (SELECT DISTINCT page_id, level FROM hd)),
hfacts AS (
  SELECT src.page_id, coalesce(h.total, 0) AS headings_total, coalesce(h.empty, 0) AS headings_empty,
    {", ".join(f"coalesce(h.h{n}, 0) AS headings_h{n}_count" for n in range(1, 7))}, h.first_h1, coalesce(k.skips, 0) AS skips
  FROM src LEFT JOIN (
    SELECT page_id, count(*) AS total, count(*) FILTER (WHERE text = '') AS empty,
      {", ".join(f"count(*) FILTER (WHERE level = {n}) AS h{n}" for n in range(1, 7))},
      arg_min(text, pos) FILTER (WHERE level = 1) AS first_h1
    FROM hd GROUP BY page_id) h USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) AS skips FROM lvls WHERE nxt - level > 1 GROUP BY page_id) k USING (page_id)
),
lk0 AS (
  SELECT e.page_id, e.url, e.pos, {trim(attr('href', 'e'))} AS href, coalesce({attr('rel', 'e')}, '') AS rel, x.text,
    exists(SELECT 1 FROM tk i WHERE i.page_id = e.page_id AND i.tag = 'img' AND i.pos > e.pos AND i.pos < e.close_pos) AS has_img
  FROM el e JOIN etext x USING (page_id, pos) WHERE e.tag = 'a' AND {attr('href', 'e')} IS NOT NULL
),
lk AS (
  SELECT page_id, url, pos, href, {host_of('href', 'url')} AS target_host, text, rel, has_img,
    CASE WHEN lower(href) LIKE 'mailto:%' THEN 'mailto' WHEN lower(href) LIKE 'javascript:%' THEN 'javascript' WHEN href LIKE '#%' THEN 'hash'
      WHEN {host_of('href', 'url')} NOT IN ('', {host('url')}) THEN 'external' ELSE 'internal' END AS link_class
  FROM lk0 WHERE href <> ''
),
lks AS (
  SELECT *, link_class IN ('internal', 'external') AND list_contains(string_split(rel, ' '), 'nofollow') AS nofollow,
    link_class IN ('internal', 'external') AND text = '' AND NOT has_img AS empty_anchor
  FROM lk
),
lfacts AS (
  SELECT src.page_id, {", ".join(f"coalesce(l.{c}, 0) AS links_{c}" for c in "internal external total nofollow empty_anchor hash_only javascript mailto unique_internal".split())}
  FROM src LEFT JOIN (
    SELECT page_id, count(*) FILTER (WHERE link_class = 'internal') AS internal, count(*) FILTER (WHERE link_class = 'external') AS external,
      count(*) FILTER (WHERE link_class IN ('internal', 'external')) AS total, count(*) FILTER (WHERE nofollow) AS nofollow,
      count(*) FILTER (WHERE empty_anchor) AS empty_anchor, count(*) FILTER (WHERE link_class = 'hash') AS hash_only,
      count(*) FILTER (WHERE link_class = 'javascript') AS javascript, count(*) FILTER (WHERE link_class = 'mailto') AS mailto,
      count(DISTINCT {resolve('url', 'href')}) FILTER (WHERE link_class = 'internal') AS unique_internal
    FROM lks GROUP BY page_id) l USING (page_id)
),
im0 AS (
  SELECT page_id, pos, {trim("coalesce(" + attr('src') + ", '')")} AS src, {attr('alt')} AS alt,
    coalesce({attr('width')}, '') <> '' AND coalesce({attr('height')}, '') <> '' AS sized,
    coalesce(lower({attr('loading')}) = 'lazy', false) AS lazy, coalesce({attr('srcset')}, '') <> '' AS has_srcset
  FROM el WHERE tag = 'img'
),
im AS (
  SELECT page_id, pos, src, alt IS NULL AS missing_alt, coalesce({trim('alt')} = '', false) AS empty_alt, NOT sized AS no_dimensions, lazy, has_srcset,
    src LIKE 'data:%' AS data_uri,
    src NOT LIKE 'data:%' AND string_split(src, '?')[1] LIKE '%.%'
      AND lower(string_split(string_split(src, '?')[1], '.')[-1]) NOT IN ('', 'webp', 'avif') AS legacy_format
  FROM im0
),
ifacts AS (
  SELECT src.page_id, {", ".join(f"coalesce(i.{c}, 0) AS images_{c}" for c in "total without_alt empty_alt missing_alt without_dimensions with_dimensions lazy with_srcset data_uri legacy_format".split())}
  FROM src LEFT JOIN (
    SELECT page_id, count(*) AS total, count(*) FILTER (WHERE missing_alt OR empty_alt) AS without_alt, count(*) FILTER (WHERE empty_alt) AS empty_alt,
      count(*) FILTER (WHERE missing_alt) AS missing_alt, count(*) FILTER (WHERE no_dimensions) AS without_dimensions,
      count(*) FILTER (WHERE NOT no_dimensions) AS with_dimensions, count(*) FILTER (WHERE lazy) AS lazy, count(*) FILTER (WHERE has_srcset) AS with_srcset,
      count(*) FILTER (WHERE data_uri) AS data_uri, count(*) FILTER (WHERE legacy_format) AS legacy_format
    FROM im GROUP BY page_id) i USING (page_id)
),
vp AS (
  SELECT src.page_id, v.content IS NOT NULL AS has_viewport, coalesce(v.content, '') AS content,
    replace(lower(coalesce(v.content, '')), ' ', '') AS low
  FROM src LEFT JOIN (SELECT page_id, arg_min(coalesce({attr('content')}, ''), pos) AS content FROM el
    WHERE tag = 'meta' AND lower({attr('name')}) = 'viewport' GROUP BY page_id) v USING (page_id)
),
vport AS (
  SELECT page_id, has_viewport, content, low LIKE '%width=device-width%' AS width_device,
    low LIKE '%user-scalable=no%' OR low LIKE '%maximum-scale=1%' AS user_scalable_disabled, low LIKE '%initial-scale%' AS has_initial_scale FROM vp
),
ld0 AS (
  SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS block, regexp_extract(raw, '(?is)^<script[^>]*>(.*)</script\\s*>$', 1) AS txt
  FROM el WHERE tag = 'script' AND {attr('type')} = 'application/ld+json' AND regexp_matches(regexp_extract(raw, '(?is)^<script[^>]*>(.*)</script\\s*>$', 1), '\\S')
),
ld AS (SELECT *, json_valid(txt) AS valid FROM ld0),
n0 AS (SELECT page_id, block, cast(txt AS json) AS node FROM ld WHERE valid),
{_json_levels()}
objs AS (SELECT * FROM n4 WHERE json_type(node) = 'OBJECT'),
typed AS (
  SELECT page_id, block, node, unnest(CASE WHEN json_type(node -> '$."@type"') = 'ARRAY'
    THEN cast(node -> '$."@type"' AS varchar[]) ELSE [node ->> '$."@type"'] END) AS type FROM objs WHERE (node -> '$."@type"') IS NOT NULL
),
reqs AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {i}, '{p}')" for t, ps in SCHEMA_REQUIREMENTS.items() for i, p in enumerate(ps))}) r(type, i, prop)),
tmiss AS (
  SELECT page_id, block, type, (SELECT string_agg(prop, ',' ORDER BY i) FROM reqs r WHERE r.type = typed.type AND NOT list_contains(json_keys(node), prop)) AS missing
  FROM typed
),
sfacts AS (
  SELECT src.page_id, coalesce(t.n, 0) AS schema_types, coalesce(t.n, 0) > 0 AS schema_has_structured_data, coalesce(t.m, 0) AS schema_missing,
    coalesce(b.blocks, 0) AS schema_blocks, coalesce(b.invalid, 0) AS schema_invalid_blocks, coalesce(c.uses, false) AS schema_uses_schema_org
  FROM src LEFT JOIN (SELECT page_id, count(*) AS n, count(missing) AS m FROM tmiss GROUP BY page_id) t USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) AS blocks, count(*) FILTER (WHERE NOT valid) AS invalid FROM ld GROUP BY page_id) b USING (page_id)
  LEFT JOIN (SELECT page_id, bool_or((node ->> '$."@context"') LIKE '%schema.org%') AS uses FROM objs GROUP BY page_id) c USING (page_id)
),
tp0 AS (
  SELECT page_id, url, 0 AS grp, pos, {host(attr('src'))} AS host FROM el WHERE tag IN ('script', 'link', 'img') AND coalesce({attr('src')}, '') <> ''
  UNION ALL SELECT page_id, url, 1, pos, {host(attr('href'))} FROM el WHERE tag = 'link' AND coalesce({attr('href')}, '') <> ''
),
tp1 AS (SELECT page_id, host, count(*) AS n, min(grp * 1000000 + pos) AS first FROM tp0 WHERE host NOT IN ('', {host('url')}) GROUP BY page_id, host),
tp AS (SELECT page_id, host, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS rank FROM tp1)),
sig AS (
  SELECT src.page_id, length(src.html) AS dom_size_bytes, s.dom_nodes, s.scripts_count, s.stylesheets_count, s.defer_scripts, s.async_scripts,
    s.inline_script_bytes, s.inline_style_bytes, s.preconnect, s.preload, s.iframes, s.embeds, length(vis.text) AS text_length_chars,
    coalesce(b.n, 0) AS render_blocking_scripts, coalesce(t.n, 0) AS third_party_count
  FROM src JOIN vis USING (page_id) JOIN (
    SELECT page_id, count(*) AS dom_nodes, count(*) FILTER (WHERE tag = 'script') AS scripts_count,
      count(*) FILTER (WHERE tag = 'link' AND {attr('rel')} LIKE '%stylesheet%') AS stylesheets_count,
      count(*) FILTER (WHERE tag = 'script' AND coalesce({attr('defer')}, '') <> '') AS defer_scripts,
      count(*) FILTER (WHERE tag = 'script' AND coalesce({attr('async')}, '') <> '') AS async_scripts,
      coalesce(sum(length(regexp_extract(raw, '(?is)^<script[^>]*>(.*)</script\\s*>$', 1))) FILTER (WHERE tag = 'script'), 0) AS inline_script_bytes,
      coalesce(sum(length(regexp_extract(raw, '(?is)^<style[^>]*>(.*)</style\\s*>$', 1))) FILTER (WHERE tag = 'style'), 0) AS inline_style_bytes,
      count(*) FILTER (WHERE tag = 'link' AND {attr('rel')} LIKE '%preconnect%') AS preconnect,
      count(*) FILTER (WHERE tag = 'link' AND {attr('rel')} LIKE '%preload%') AS preload,
      count(*) FILTER (WHERE tag = 'iframe') AS iframes, count(*) FILTER (WHERE tag = 'embed') AS embeds
    FROM el GROUP BY page_id) s USING (page_id)
  LEFT JOIN (
    SELECT e.page_id, count(*) AS n FROM el e JOIN head h ON h.page_id = e.page_id AND e.pos > h.pos AND e.pos < h.close_pos
    WHERE e.tag = 'script' AND (coalesce({attr('src', 'e')}, '') = '' OR NOT (coalesce({attr('defer', 'e')}, '') <> '' OR coalesce({attr('async', 'e')}, '') <> ''
      OR coalesce({attr('type', 'e')} = 'module', false))) GROUP BY e.page_id) b USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) AS n FROM tp GROUP BY page_id) t USING (page_id)
),
vit AS (
  SELECT s.page_id,
    CASE WHEN text_length_chars > 200000 OR dom_size_bytes > 5000000 OR images_total > 100 THEN 'poor'
      WHEN text_length_chars > 50000 OR dom_size_bytes > 1000000 OR images_total > 20 THEN 'needs improvement' ELSE 'good' END AS lcp,
    CASE WHEN dom_size_bytes > 2000000 OR scripts_count > 30 THEN 'poor'
      WHEN dom_size_bytes > 500000 OR scripts_count > 10 OR stylesheets_count > 5 THEN 'needs improvement' ELSE 'good' END AS fcp,
    CASE WHEN images_without_dimensions > 5 OR iframes > 3 THEN 'poor'
      WHEN images_without_dimensions > 0 OR iframes > 0 OR embeds > 0 THEN 'needs improvement' ELSE 'good' END AS cls
  FROM sig s JOIN ifacts i USING (page_id)
),
{text_ctes('SELECT page_id, text FROM vis')},
kw AS (SELECT page_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM (
  SELECT page_id, {_keyword_list('text')} AS w FROM vis)),
kws AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, word FROM kw WHERE word NOT IN {_in(STOP_WORDS)}),
kcount AS (
  SELECT src.page_id, coalesce(a.n, 0) AS keyword_word_count, coalesce(b.n, 0) AS keyword_count FROM src
  LEFT JOIN (SELECT page_id, count(*) AS n FROM kw GROUP BY page_id) a USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) AS n FROM kws GROUP BY page_id) b USING (page_id)
),
report AS (
  SELECT src.page_id, src.url, title, title_length, title_words, length(coalesce(description, '')) AS description_length, {", ".join(META_KEYS)},
    canonical, canonical_absolute, canonical_self, canonical_host, lang, charset, meta_refresh,
    exists(SELECT 1 FROM el WHERE el.page_id = src.page_id AND tag = 'link' AND {attr('rel')} LIKE '%icon%') AS has_favicon,
    (SELECT count(*) FROM hre WHERE hre.page_id = src.page_id) AS hreflang_count,
    hfacts.* EXCLUDE (page_id), tstats.* EXCLUDE (page_id, reading_ease_raw), lfacts.* EXCLUDE (page_id), ifacts.* EXCLUDE (page_id), sfacts.* EXCLUDE (page_id),
    has_viewport, vport.content AS viewport_content, width_device, user_scalable_disabled, has_initial_scale, sig.* EXCLUDE (page_id), stylesheets_count AS render_blocking_styles,
    keyword_count, keyword_word_count, lcp, fcp, cls
  FROM src JOIN title USING (page_id) JOIN meta USING (page_id) JOIN canon USING (page_id) JOIN doc USING (page_id) JOIN hfacts USING (page_id)
  JOIN tstats USING (page_id) JOIN lfacts USING (page_id) JOIN ifacts USING (page_id) JOIN sfacts USING (page_id) JOIN vport USING (page_id)
  JOIN sig USING (page_id) JOIN kcount USING (page_id) JOIN vit USING (page_id)
),
{finding_ctes()}"""


def _json_levels() -> str:
    level = """n{b} AS (
  SELECT page_id, block, unnest(cast(node AS json[])) AS node FROM n{a} WHERE json_type(node) = 'ARRAY'
  UNION ALL SELECT page_id, block, node -> '$."@graph"' FROM n{a} WHERE json_type(node) = 'OBJECT' AND (node -> '$."@graph"') IS NOT NULL
  UNION ALL SELECT page_id, block, node FROM n{a} WHERE json_type(node) <> 'ARRAY' AND (json_type(node) <> 'OBJECT' OR (node -> '$."@graph"') IS NULL)
),"""
    return "\n".join(level.format(a=i, b=i + 1) for i in range(4))


def _keyword_list(x: str) -> str:
    ascii_text = f"regexp_replace(regexp_replace(lower({x}), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}\\p{{M}}]', ' ', 'g'), '[^\\x00-\\x7F]', '0', 'g')"
    return f"regexp_extract_all({ascii_text}, '\\b[a-z][a-z''-]{{2,}}\\b')"


def syllables(w: str) -> str:
    stem = f"regexp_replace(regexp_replace(lower({w}), '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', '')"
    return f"CASE WHEN length({w}) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all({stem}, '[aeiouy]{{1,2}}'))) END"


def text_ctes(source: str) -> str:
    """Statistics and readability of ``source`` rows ``(page_id, text)``."""
    return f"""
cl AS (SELECT page_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM ({source})),
ws AS (
  SELECT page_id, clean, regexp_extract_all(clean, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+') AS words,
    list_filter(string_split(regexp_replace(clean, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS sents FROM cl
),
ms AS (
  SELECT page_id, length(clean) AS chars, len(words) AS nw, len(sents) AS ns,
    len(list_filter(sents, lambda s: len(string_split(s, ' ')) > 25)) AS long_sentences,
    coalesce(list_sum(list_transform(words, lambda w: {syllables('w')})), 0) AS syl FROM ws
),
rd AS (
  SELECT *, nw = 0 OR ns = 0 AS none, nw / nullif(ns, 0) AS asl, syl / nullif(nw, 0) AS asw,
    greatest(0.0, least(100.0, cast(206.835 AS double) - cast(1.015 AS double) * (nw / nullif(ns, 0)) - cast(84.6 AS double) * (syl / nullif(nw, 0)))) AS ease FROM ms
),
tstats AS (
  SELECT page_id, nw AS word_count, chars AS text_chars, CASE WHEN chars = 0 THEN 0 ELSE greatest(ns, 1) END AS sentence_count,
    CASE WHEN chars = 0 THEN 0.0 ELSE round(nw / greatest(ns, 1), 1) END AS avg_sentence_length, long_sentences,
    CASE WHEN chars = 0 THEN 0 ELSE 1 END AS paragraph_count, ease AS reading_ease_raw,
    CASE WHEN none THEN 0.0 ELSE round(ease, 1) END AS reading_ease,
    CASE WHEN none THEN 0.0 ELSE round(cast(0.39 AS double) * asl + cast(11.8 AS double) * asw - cast(15.59 AS double), 1) END AS grade,
    syl AS syllable_count,
    CASE WHEN none THEN 'unknown' WHEN ease >= 90 THEN 'very easy' WHEN ease >= 80 THEN 'easy' WHEN ease >= 70 THEN 'fairly easy'
      WHEN ease >= 60 THEN 'standard' WHEN ease >= 50 THEN 'fairly difficult' WHEN ease >= 30 THEN 'difficult' ELSE 'very difficult' END AS level
  FROM rd
)"""


_NOINDEX = "len(list_intersect(list_transform(string_split(coalesce(robots, ''), ','), lambda d: lower(trim(d))), ['noindex', 'none'])) > 0"
_HAS = "coalesce({0}, '') <> ''"
_TITLE_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(title, '')), '\\s+'), lambda w: length(w) > 2)"
_CANON = _HAS.format("canonical")

# Rule conditions over ``report``: (rule, severity, impact, condition).
_RULES = [
    ("content.title.missing", "critical", 8, "coalesce(title, '') = ''"),
    ("content.title.short", "notice", 2, f"{_HAS.format('title')} AND title_length < 30"),
    ("content.title.long", "notice", 2, "title_length > 65"),
    ("content.title.repetition", "notice", 2, f"len({_TITLE_WORDS}) > len(list_distinct({_TITLE_WORDS}))"),
    ("content.title.duplicate_h1", "warning", 3, f"{_HAS.format('first_h1')} AND lower(trim(first_h1)) = lower(coalesce(title, ''))"),
    ("content.description.missing", "critical", 8, "coalesce(description, '') = ''"),
    ("content.description.short", "notice", 2, "description_length BETWEEN 1 AND 119"),
    ("content.description.long", "notice", 2, "description_length > 160"),
    ("content.content.thin", "critical", 8, "word_count < 100"),
    ("content.content.short", "warning", 5, "word_count >= 100 AND word_count < 300"),
    ("content.content.no_headings", "warning", 3, "headings_total = 0"),
    ("content.content.readability", "warning", 3, "grade > 12"),
    ("content.content.long_sentences", "notice", 2, "long_sentences > 3"),
    ("indexability.robots.noindex", "critical", 10, _NOINDEX),
    ("indexability.canonical.missing", "warning", 5, "coalesce(canonical, '') = ''"),
    ("indexability.canonical.relative", "warning", 2, f"{_CANON} AND NOT canonical_absolute"),
    ("indexability.canonical.noindex_conflict", "critical", 6, f"{_CANON} AND {_NOINDEX}"),
    ("indexability.canonical.cross_domain", "warning", 4, f"{_CANON} AND NOT canonical_self AND canonical_host <> '' AND canonical_host <> {host('url')}"),
    ("indexability.html.lang_missing", "warning", 3, "coalesce(lang, '') = ''"),
    ("indexability.meta.refresh", "warning", 3, _HAS.format("meta_refresh")),
    ("indexability.hreflang.relative", "notice", 2, "exists(SELECT 1 FROM hre WHERE hre.page_id = report.page_id AND href NOT LIKE 'http%')"),
    ("indexability.hreflang.no_xdefault", "notice", 1, "hreflang_count > 0 AND NOT exists(SELECT 1 FROM hre WHERE hre.page_id = report.page_id AND lower(lang) = 'x-default')"),
    ("indexability.meta.keywords", "notice", 1, _HAS.format("keywords_meta")),
    ("structure.headings.h1_missing", "critical", 6, "headings_h1_count = 0"),
    ("structure.headings.h1_multiple", "warning", 3, "headings_h1_count > 1"),
    ("structure.headings.empty", "notice", 2, "headings_empty > 0"),
    ("structure.headings.skipped_levels", "notice", 3, "skips > 0"),
    ("structure.links.few_internal", "warning", 4, "links_internal < 3"),
    ("structure.links.no_external", "notice", 2, "links_external = 0"),
    ("structure.links.empty_anchor", "notice", 2, "links_empty_anchor > 0"),
    ("structure.links.hash_only", "notice", 1, "links_hash_only > 0"),
    ("structure.links.too_many", "notice", 2, "links_total > 100"),
    ("structure.schema.missing", "warning", 5, "schema_types = 0"),
    ("structure.schema.invalid", "warning", 4, "schema_types > 0 AND schema_invalid_blocks > 0"),
    ("structure.schema.missing_properties", "notice", 3, "schema_types > 0 AND schema_missing > 0"),
    ("structure.schema.context", "notice", 1, "schema_types > 0 AND NOT schema_uses_schema_org"),
    ("social.og.og_title_missing", "warning", 2, "coalesce(og_title, '') = ''"),
    ("social.og.og_description_missing", "warning", 2, "coalesce(og_description, '') = ''"),
    ("social.og.og_image_missing", "warning", 2, "coalesce(og_image, '') = ''"),
    ("social.og.image_alt_missing", "notice", 1, f"{_HAS.format('og_image')} AND coalesce(og_image_alt, '') = ''"),
    ("social.twitter.card_missing", "notice", 1, "coalesce(twitter_card, '') = ''"),
    ("social.twitter.card_invalid", "notice", 1, f"{_HAS.format('twitter_card')} AND lower(twitter_card) NOT IN ('summary', 'summary_large_image', 'app', 'player')"),
    ("mobile.viewport.missing", "critical", 6, "NOT has_viewport"),
    ("mobile.viewport.width", "warning", 3, "has_viewport AND NOT width_device"),
    ("mobile.viewport.zoom_blocked", "warning", 2, "has_viewport AND user_scalable_disabled"),
    ("performance.perf.blocking_styles", "warning", 3, "stylesheets_count > 3"),
    ("performance.perf.blocking_scripts", "warning", 4, "render_blocking_scripts > 2"),
    ("performance.perf.image_dimensions", "warning", 3, "images_without_dimensions > 0"),
    ("performance.perf.lazy_loading", "notice", 2, "images_total >= 10 AND images_lazy = 0"),
    ("performance.perf.dom_huge", "warning", 4, "dom_nodes > 3000"),
    ("performance.perf.dom_large", "notice", 2, "dom_nodes > 1500 AND dom_nodes <= 3000"),
    ("performance.perf.inline_js", "notice", 2, "inline_script_bytes > 100000"),
    ("performance.perf.inline_css", "notice", 2, "inline_style_bytes > 60000"),
    ("performance.perf.third_party", "notice", 2, "third_party_count >= 5"),
    ("performance.perf.preconnect", "notice", 1, "third_party_count BETWEEN 1 AND 4 AND preconnect = 0"),
    ("performance.perf.lcp", "warning", 3, "lcp = 'poor'"),
    ("performance.perf.lcp_improve", "notice", 2, "lcp = 'needs improvement'"),
    ("performance.perf.cls", "warning", 3, "cls = 'poor'"),
    ("performance.perf.html_size", "warning", 3, "dom_size_bytes > 500000"),
    ("media.images.alt", "critical", 6, "images_without_alt > 0 AND images_without_alt * 2 > images_total"),
    ("media.images.alt", "warning", 4, "images_without_alt > 0 AND images_without_alt * 2 <= images_total"),
    ("media.images.format", "notice", 2, "images_legacy_format > 0"),
    ("media.images.srcset", "notice", 1, "images_total >= 5 AND images_with_srcset = 0"),
    ("media.images.data_uri", "notice", 1, "images_data_uri >= 5"),
]


def _json_of(**columns: str) -> str:
    """JSON object of columns of the report."""
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || to_json({v})" for k, v in columns.items()) + " || '}'"


_ALT_MESSAGE = "images_without_alt || ' of ' || images_total || ' images have no alt text (' || cast(round_even(images_without_alt / images_total * 100, 0) AS int) || '%).'"
_EXAMPLES = "'{\"examples\":' || coalesce((SELECT to_json(list(src ORDER BY pos)) FROM im WHERE im.page_id = report.page_id AND missing_alt), '[]') || '}'"
_SKIPS = "(SELECT string_agg('{\"from\":' || level || ',\"to\":' || nxt || '}', ',' ORDER BY level) FROM lvls WHERE lvls.page_id = report.page_id AND nxt - level > 1)"
_LACKING = ("(SELECT string_agg({0}, '{1}' ORDER BY t.block, strpos(txt, '\"' || type || '\"')) FROM tmiss t JOIN ld0 ON ld0.page_id = t.page_id AND ld0.block = t.block "
            "WHERE t.page_id = report.page_id AND missing IS NOT NULL)")

# Message and evidence of every rule over ``report``; None: no evidence.
_MESSAGES: dict[str, tuple[str, str | None]] = {
    "content.title.missing": ("'The page has no <title>.'", None),
    "content.title.short": ("'Title is ' || title_length || ' characters.'", _json_of(title="title")),
    "content.title.long": ("'Title is ' || title_length || ' characters and may be rewritten or truncated.'", _json_of(title="title")),
    "content.title.repetition": (
        f"'Title repeats the same word: ' || array_to_string(list_sort(list_filter(list_distinct({_TITLE_WORDS}), lambda w: len(list_filter({_TITLE_WORDS}, lambda x: x = w)) > 1)), ', ') || '.'", None),
    "content.title.duplicate_h1": ("'The title tag and the H1 are identical.'", _json_of(title="title")),
    "content.description.missing": ("'The page has no meta description.'", None),
    "content.description.short": ("'Meta description is ' || description_length || ' characters.'", _json_of(description="description")),
    "content.description.long": ("'Meta description is ' || description_length || ' characters and will be cut off.'", _json_of(description="description")),
    "content.content.thin": ("'Only ' || word_count || ' words of visible text.'", _json_of(word_count="word_count")),
    "content.content.short": ("word_count || ' words of visible text — thin for most queries.'", _json_of(word_count="word_count")),
    "content.content.no_headings": ("'The page has no headings at all.'", None),
    "content.content.readability": (
        "'Text reads at US grade ' || grade || ' — harder than the recommended 6-10.'", _json_of(grade="grade", avg_sentence_length="avg_sentence_length")),
    "content.content.long_sentences": ("long_sentences || ' sentences run past 25 words.'", None),
    "indexability.robots.noindex": ("'Meta robots says: ' || robots || ' — this page is excluded from search.'", _json_of(robots="robots")),
    "indexability.canonical.missing": ("'No canonical URL declared.'", None),
    "indexability.canonical.relative": ("'Canonical is relative: ' || canonical || '.'", _json_of(canonical="canonical")),
    "indexability.canonical.noindex_conflict": ("'The page is both canonical to another URL and marked noindex.'", _json_of(canonical="canonical", robots="robots")),
    "indexability.canonical.cross_domain": ("'Canonical points at another domain (' || canonical_host || ').'", _json_of(canonical="canonical")),
    "indexability.html.lang_missing": ("'The <html> element has no lang attribute.'", None),
    "indexability.meta.refresh": ("'The page uses a meta refresh: ' || meta_refresh || '.'", None),
    "indexability.hreflang.relative": (
        "(SELECT count(*) FROM hre WHERE hre.page_id = report.page_id AND href NOT LIKE 'http%') || ' hreflang entries are relative URLs.'", None),
    "indexability.hreflang.no_xdefault": ("'No x-default hreflang entry.'", None),
    "indexability.meta.keywords": ("'The obsolete meta keywords tag is present.'", None),
    "structure.headings.h1_missing": ("'No H1 on the page.'", None),
    "structure.headings.h1_multiple": ("headings_h1_count || ' H1 headings found.'", _json_of(h1_count="headings_h1_count")),
    "structure.headings.empty": ("headings_empty || ' headings are empty.'", None),
    "structure.headings.skipped_levels": (
        "(SELECT 'Heading levels jump (e.g. H' || min(level) || ' then H' || arg_min(nxt, level) || ').' FROM lvls WHERE lvls.page_id = report.page_id AND nxt - level > 1)",
        f"'{{\"skipped\":[' || {_SKIPS} || ']}}'"),
    "structure.links.few_internal": ("'Only ' || links_internal || ' internal link(s) on the page.'", _json_of(internal="links_internal")),
    "structure.links.no_external": ("'No outbound links.'", None),
    "structure.links.empty_anchor": ("links_empty_anchor || ' links have no text (and no image).'", None),
    "structure.links.hash_only": ("links_hash_only || ' links point to ''#''.'", None),
    "structure.links.too_many": ("links_total || ' links on a single page.'", None),
    "structure.schema.missing": ("'No structured data (JSON-LD) found.'", None),
    "structure.schema.invalid": ("schema_invalid_blocks || ' JSON-LD block(s) are not valid JSON.'", None),
    "structure.schema.missing_properties": (
        "'Structured data is incomplete: ' || " + _LACKING.format("type || ' lacks ' || replace(missing, ',', ', ')", "; "),
        "'{\"missing\":[' || " + _LACKING.format("'{\"type\":\"' || type || '\",\"missing\":' || to_json(string_split(missing, ',')) || '}'", ",") + " || ']}'"),
    "structure.schema.context": ("'Structured data does not declare the schema.org context.'", None),
    "social.og.og_title_missing": ("'Open Graph og:title is missing.'", None),
    "social.og.og_description_missing": ("'Open Graph og:description is missing.'", None),
    "social.og.og_image_missing": ("'Open Graph og:image is missing.'", None),
    "social.og.image_alt_missing": ("'og:image has no og:image:alt.'", None),
    "social.twitter.card_missing": ("'No twitter:card declared.'", None),
    "social.twitter.card_invalid": ("'Unknown twitter:card value: ' || twitter_card || '.'", None),
    "mobile.viewport.missing": ("'No viewport meta tag: the page renders as a desktop layout on phones.'", None),
    "mobile.viewport.width": ("'Viewport does not set width=device-width (' || viewport_content || ').'", None),
    "mobile.viewport.zoom_blocked": ("'The viewport forbids user zoom (user-scalable=no or maximum-scale=1).'", None),
    "performance.perf.blocking_styles": ("render_blocking_styles || ' stylesheets block rendering.'", None),
    "performance.perf.blocking_scripts": ("render_blocking_scripts || ' scripts in <head> block rendering.'", _json_of(count="render_blocking_scripts")),
    "performance.perf.image_dimensions": ("images_without_dimensions || ' images have no width/height.'", None),
    "performance.perf.lazy_loading": ("images_total || ' images, none lazy-loaded.'", None),
    "performance.perf.dom_huge": ("dom_nodes || ' DOM nodes — well past the ~1500 recommended.'", _json_of(dom_nodes="dom_nodes")),
    "performance.perf.dom_large": ("dom_nodes || ' DOM nodes, above the ~1500 recommended.'", None),
    "performance.perf.inline_js": ("inline_script_bytes // 1024 || ' KB of inline JavaScript.'", None),
    "performance.perf.inline_css": ("inline_style_bytes // 1024 || ' KB of inline CSS.'", None),
    "performance.perf.third_party": (
        "'Assets come from ' || third_party_count || ' third-party hosts.'",
        "'{\"hosts\":' || (SELECT to_json(list(host ORDER BY rank)) FROM tp WHERE tp.page_id = report.page_id) || '}'"),
    "performance.perf.preconnect": ("'Third-party assets are loaded without preconnect.'", None),
    "performance.perf.lcp": ("'Rendering signals suggest a poor Largest Contentful Paint.'", None),
    "performance.perf.lcp_improve": ("'Rendering signals suggest LCP needs improvement.'", None),
    "performance.perf.cls": ("'Rendering signals suggest a poor Cumulative Layout Shift.'", None),
    "performance.perf.html_size": ("'HTML document is ' || dom_size_bytes // 1024 || ' KB.'", None),
    "media.images.alt": (_ALT_MESSAGE, _EXAMPLES),
    "media.images.format": ("images_legacy_format || ' images are not WebP/AVIF.'", None),
    "media.images.srcset": ("'No responsive images (srcset/sizes).'", None),
    "media.images.data_uri": ("images_data_uri || ' images are inlined as data URIs.'", None),
}


def _messages_sql() -> str:
    """Message, fix and evidence of all findings; the fixes are constant texts."""
    fixes = ", ".join(f"('{r}', '{f}')" for r, f in {r.rule: r.fix.replace("'", "''") for r in RULES}.items())
    message = " ".join(f"WHEN '{rule}' THEN {m}" for rule, (m, _) in _MESSAGES.items())
    evidence = " ".join(f"WHEN '{rule}' THEN {e}" for rule, (_, e) in _MESSAGES.items() if e)
    return f"""SELECT fnd.page_id, fnd.rule, CASE fnd.rule {message} END AS message, fix, CASE fnd.rule {evidence} END AS evidence
FROM fnd JOIN report ON report.page_id = fnd.page_id JOIN (VALUES {fixes}) x(rule, fix) ON x.rule = fnd.rule"""


def finding_ctes() -> str:
    union = "\n  UNION ALL ".join(
        f"SELECT page_id, '{rule}' AS rule, '{rule.split('.')[0]}' AS category, '{severity}' AS severity, {impact} AS impact FROM report WHERE {condition}"
        for rule, severity, impact, condition in _RULES
    )
    weights = ", ".join(f"('{k}', {v})" for k, v in CATEGORY_WEIGHTS.items())
    return f"""
fnd AS ({union}),
weights AS (SELECT * FROM (VALUES {weights}) w(category, weight)),
cats AS (
  SELECT src.page_id, w.category, greatest(0, weight - coalesce(sum(impact), 0)) AS score, weight AS max, coalesce(sum(impact), 0) AS lost, count(impact) AS issues
  FROM src CROSS JOIN weights w LEFT JOIN fnd f ON f.page_id = src.page_id AND f.category = w.category GROUP BY src.page_id, w.category, weight
),
sev AS (
  SELECT src.page_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning,
    count(*) FILTER (WHERE severity = 'notice') AS notice, count(impact) AS issues_total
  FROM src LEFT JOIN fnd USING (page_id) GROUP BY src.page_id
),
scored AS (
  SELECT src.page_id, src.url, c.score, CASE WHEN c.score >= 90 THEN 'A' WHEN c.score >= 80 THEN 'B' WHEN c.score >= 70 THEN 'C'
      WHEN c.score >= 60 THEN 'D' WHEN c.score >= 40 THEN 'E' ELSE 'F' END AS grade, critical, warning, notice, issues_total,
    CASE WHEN critical > 0 THEN critical || ' critical issue(s) block this page from ranking well, ' || warning || ' warning(s) and ' || notice || ' notice(s).'
      WHEN warning > 0 THEN 'No blocking issue, but ' || warning || ' warning(s) and ' || notice || ' notice(s) hold the score at ' || c.score || '/100.'
      WHEN notice > 0 THEN 'Solid page: ' || notice || ' minor notice(s), score ' || c.score || '/100.'
      ELSE 'No issue found by ruleset 2026-09-1: score ' || c.score || '/100.' END AS summary
  FROM src JOIN (SELECT page_id, sum(score) AS score FROM cats GROUP BY page_id) c USING (page_id) JOIN sev USING (page_id)
),
legacy AS (
  SELECT page_id, least(100,
    CASE WHEN title IS NULL THEN 0 WHEN title_length BETWEEN 30 AND 65 THEN 10 ELSE 5 END
    + CASE WHEN description_length BETWEEN 120 AND 160 THEN 10 WHEN description_length > 0 THEN 5 ELSE 0 END
    + CASE WHEN {_HAS.format('og_title')} THEN 5 ELSE 0 END + CASE WHEN {_HAS.format('og_description')} THEN 5 ELSE 0 END
    + CASE WHEN {_HAS.format('og_image')} THEN 5 ELSE 0 END + CASE WHEN {_HAS.format('twitter_card')} THEN 3 ELSE 0 END
    + CASE WHEN {_CANON} THEN 5 ELSE 0 END + CASE headings_h1_count WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 5 END
    + CASE WHEN images_total > 0 THEN cast(floor((images_total - images_without_alt) / images_total * 10) AS int) ELSE 0 END
    + CASE WHEN has_viewport THEN 10 ELSE 0 END + CASE WHEN schema_types > 0 THEN 10 ELSE 0 END
    + CASE WHEN reading_ease BETWEEN 60 AND 70 THEN 8 WHEN reading_ease >= 50 THEN 4 ELSE 0 END + least(5, links_internal)
    + CASE WHEN lcp = 'good' THEN 3 ELSE 0 END + CASE WHEN cls = 'good' THEN 2 ELSE 0 END + CASE WHEN keyword_count > 0 THEN 3 ELSE 0 END) AS score
  FROM report
)"""


# --- prices --------------------------------------------------------------------------------

_ORDER = "captured_at DESC, store DESC, price_cents DESC, l_orderkey DESC, l_linenumber DESC"


def _parse(x: str) -> str:
    return f"try_cast(replace(regexp_extract(replace(replace({x}, ' ', ''), ' ', ''), '[0-9]+(?:[.,][0-9]+)?', 0), ',', '.') AS double)"


def _strip(x: str, symbols: str) -> str:
    bare = x
    for s in symbols:
        bare = f"replace({bare}, '{s}', '')"
    bare = f"trim({bare})"
    return f"CASE WHEN regexp_full_match({bare}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN try_cast({bare} AS double) END"


def _currency(x: str) -> str:
    return f"coalesce(regexp_extract({x}, '(?i)(?:[$€£¥]|EUR|USD|CHF|GBP)', 0), '')"


def _locale(x: str) -> str:
    number = f"regexp_extract(replace(replace({x}, ' ', ''), ' ', ''), '[0-9]+(?:[.,][0-9]+)*', 0)"
    whole = f"regexp_replace(regexp_extract({number}, '^(.*?)(?:[.,][0-9]{{1,2}})?$', 1), '[.,]', '', 'g')"
    return f"try_cast({whole} || '.' || coalesce(nullif(regexp_extract({number}, '[.,]([0-9]{{1,2}})$', 1), ''), '0') AS double)"


def _points(sql: str) -> str:
    return f"""WITH pp AS ({derived(D.PRICE_POINTS, 'lineitem')}),
pv AS (SELECT *, {_parse('price_text')} AS price_value, {_currency('price_text')} AS currency, {_strip('price_text', '$,€£')} AS price,
  {_strip('price_text', '$,')} AS dollar_price FROM pp),
pr AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY {_ORDER}) AS rank FROM pv),
ok AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY {_ORDER}) AS prank,
  row_number() OVER (PARTITION BY product, store ORDER BY {_ORDER}) AS srank FROM pv WHERE price IS NOT NULL),
cur AS (SELECT product, store, price, captured_at AS last_checked FROM ok WHERE srank = 1)
{sql}"""


_PCT = "round(abs(curr - prev) / nullif(prev, 0) * 100, 1)"

# --- addresses -----------------------------------------------------------------------------


def _ip(x: str) -> str:
    return (f"(cast(split_part({x}, '.', 1) AS bigint) * 16777216 + cast(split_part({x}, '.', 2) AS bigint) * 65536 "
            f"+ cast(split_part({x}, '.', 3) AS bigint) * 256 + cast(split_part({x}, '.', 4) AS bigint))")


def _public(x: str) -> str:
    ranges = " OR ".join("{ip} BETWEEN %d AND %d" % network_bounds(n) for n in NON_PUBLIC_NETWORKS)
    v4 = "^[0-9.]+$"
    return (f"CASE WHEN {x} IN {_in(METADATA_ADDRESSES)} THEN false WHEN regexp_matches({x}, '{v4}') THEN NOT ({ranges.format(ip=_ip(x))}) "
            f"WHEN {x} LIKE '::ffff:%' THEN false WHEN {x} = '::1' THEN false ELSE {x} LIKE '2%' END")


#: Numbers of addresses: an IPv4 address maps to an IPv6 one; first two groups of an IPv6 address.
_V4 = ("(281470681743360::HUGEINT + split_part({x}, '.', 1)::HUGEINT * 16777216 + split_part({x}, '.', 2)::HUGEINT * 65536"
       " + split_part({x}, '.', 3)::HUGEINT * 256 + split_part({x}, '.', 4)::HUGEINT)")
_V6 = "(10752::HUGEINT * 5192296858534827628530496329220096 + ('0x' || split_part({x}, ':', 2))::HUGEINT * 79228162514264337593543950336)"


def _networks_sql() -> str:
    """Readable networks as ranges of numbers, equal ones once."""
    return f"""given AS ({derived(D.NETWORKS, 'customer')}),
sized AS (SELECT network, public, k % 5 AS form, CASE k % 5 WHEN 0 THEN 256::HUGEINT WHEN 1 THEN 131072 WHEN 3 THEN 1
    ELSE CASE k % 2 WHEN 0 THEN 79228162514264337593543950336 ELSE 1208925819614629174706176 END END AS span,
  CASE WHEN k % 5 = 2 THEN {_V6.format(x='network')} ELSE {_V4.format(x="split_part(network, '/', 1)")} END AS n FROM given WHERE k % 5 < 4),
nets AS (SELECT n // span * span AS lo, n // span * span + span - 1 AS hi, min({{'network': network, 'public': public}}).network AS network,
  min({{'network': network, 'public': public}}).public AS public FROM sized GROUP BY ALL)"""


def _admission(url: str) -> str:
    """Columns reason, host, port of a table with ``url``."""
    authority = f"regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1)"
    host_name = f"regexp_replace({host(f'regexp_replace({url}, chr(47) || chr(47) || {chr(39)}[^/?#]*@{chr(39)}, chr(47) || chr(47))')}, '\\.+$', '')"
    scheme = f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    port = f"coalesce(try_cast(nullif(regexp_extract({authority}, ':([0-9]+)$', 1), '') AS int), CASE WHEN {scheme} = 'https' THEN 443 ELSE 80 END)"
    suffixes = " OR ".join(f"{host_name} LIKE '%{s}'" for s in BLOCKED_HOST_SUFFIXES)
    return f"""CASE WHEN coalesce({url}, '') = '' THEN 'URL is required' WHEN length({url}) > 2048 THEN 'URL exceeds maximum length'
  WHEN {scheme} NOT IN ('http', 'https') THEN 'Only http/https URLs are allowed, got: ''' || {scheme} || ''''
  WHEN {authority} LIKE '%@%' THEN 'Credentials in the URL are not allowed' WHEN {host_name} = '' THEN 'URL must include a valid hostname'
  WHEN {host_name} IN {_in(BLOCKED_HOSTNAMES)} OR {suffixes} THEN 'URL hostname is blocked for security reasons'
  WHEN {port} > 65535 THEN 'URL has an invalid port'
  WHEN {port} NOT IN ({", ".join(map(str, ALLOWED_PORTS))}) THEN 'Port ' || {port} || ' is not allowed' END AS reason, {host_name} AS host, {port} AS port"""


def oracle_queries() -> dict[str, str]:
    aug = derived(D.PAGES_AUG, "pages")

    def pages(sql: str, source: str = aug) -> str:
        return f"WITH {page_ctes(source)}\n{sql}"

    def grams(n: int) -> str:
        parts = ["word"] + [f"lead(word, {k}) OVER w" for k in range(1, n)]
        return pages(f"""SELECT page_id, phrase, n, rank FROM (
  SELECT page_id, phrase, count(*) AS n, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(pos)) AS rank FROM (
    SELECT page_id, pos, {" || ' ' || ".join(parts)} AS phrase FROM kws WINDOW w AS (PARTITION BY page_id ORDER BY pos)
  ) WHERE phrase IS NOT NULL GROUP BY page_id, phrase) WHERE rank <= 20""")

    captures = derived(D.CAPTURES, "pages")
    error = ("CASE WHEN refusal IS NOT NULL THEN 'Refused: ' || refusal WHEN status >= 400 THEN 'HTTP ' || status "
             "WHEN content_type NOT LIKE '%html%' AND content_type NOT LIKE '%xml%' THEN 'Not an HTML document (' || content_type || ')' END")
    aug_captures = derived({**D.CAPTURES, "html": D.PAGES_AUG["html"]}, "pages")
    history = pages("SELECT {cols} FROM (SELECT scored.*, legacy.score AS additive, " + ", ".join(f"{v} AS {k}" for k, v in D.OWNERS.items()) + " FROM scored JOIN legacy USING (page_id))")
    compact = ("'{\"url\":\"' || url || '\",\"score\":' || additive || ',\"audit\":{\"score\":' || score || ',\"grade\":\"' || grade || '\",\"counts\":{\"critical\":' || critical"
               " || ',\"warning\":' || warning || ',\"notice\":' || notice || '},\"summary\":\"' || summary || '\"}}' AS analysis")
    events = {k: f"({derived(v, 'events')})" for k, v in (("log", D.REQUEST_LOG), ("acc", D.ACCOUNT_EVENTS), ("visit", D.PAGE_VISITS))}
    accounts = derived(D.ACCOUNTS, "customer")
    subscription = f"""WITH acc AS ({accounts}), ev AS (SELECT * FROM {events['acc']} WHERE type <> 'invoice.paid'),
co AS (SELECT email, max({{'ts': ts, 'event_id': event_id, 'customer': customer}}) AS co FROM ev WHERE type = 'checkout.session.completed' GROUP BY email),
a2 AS (SELECT acc.email, premium, acc.customer_id AS old_id, coalesce(co.customer, acc.customer_id) AS customer_id, co FROM acc LEFT JOIN co USING (email)),
ch AS (SELECT customer, max({{'ts': ts, 'event_id': event_id, 'type': type, 'status': status}}) AS ch FROM ev WHERE type <> 'checkout.session.completed' GROUP BY customer),
st AS (SELECT email, customer_id, premium, co, ch, ch IS NOT NULL AND CASE WHEN co IS NULL THEN old_id IS NOT NULL
    ELSE ch.ts > co.ts OR (ch.ts = co.ts AND ch.event_id > co.event_id) END AS follows,
  coalesce(ch.type = 'customer.subscription.updated' AND ch.status = 'active', false) AS active FROM a2 LEFT JOIN ch ON ch.customer = a2.customer_id),
fin AS (SELECT email, customer_id, CASE WHEN follows THEN active WHEN co IS NOT NULL THEN true ELSE premium END AS premium,
  CASE WHEN follows THEN CASE WHEN active THEN ch.ts END WHEN co IS NOT NULL THEN co.ts END AS since, follows, co FROM st)"""
    breaches = f"""SELECT client, route, date_trunc('day', ts) AS window_start, count(*) AS n, {D.DAILY_LIMIT} AS "limit"
FROM {events['log']} GROUP BY ALL HAVING count(*) > {D.DAILY_LIMIT}"""
    quick = f"""
qtext AS (
  SELECT src.page_id, coalesce(trim(regexp_replace(q.text, '\\s+', ' ', 'g')), '') AS text FROM src LEFT JOIN (
    SELECT t.page_id, string_agg(CASE WHEN t.kind = 'text' THEN {unescape('t.raw')}
      ELSE regexp_extract(t.raw, '(?is)^<(?:script|style)[^>]*>(.*)</(?:script|style)\\s*>$', 1) END, '' ORDER BY t.pos) AS text
    FROM tk t JOIN body b ON b.page_id = t.page_id AND t.pos > b.pos AND t.pos < b.close_pos
    WHERE t.kind = 'text' OR t.tag IN ('script', 'style') GROUP BY t.page_id) q USING (page_id)
),
qs AS (
  SELECT page_id, text, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS words,
    len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s) <> '')) AS sentences FROM qtext
),
qmeta AS (
  SELECT page_id, {", ".join(f"arg_min({attr('content')}, pos) FILTER (WHERE {attr(a)} = '{n}') AS {c}" for a, n, c in (
      ('name', 'description', 'description'), ('name', 'viewport', 'viewport'), ('name', 'robots', 'robots'), ('property', 'og:title', 'og_title')))}
  FROM el WHERE tag = 'meta' GROUP BY page_id
),
qlink AS (
  SELECT page_id, count(*) AS total, count(*) FILTER (WHERE NOT (h = '' OR h LIKE '#%' OR h LIKE 'javascript:%' OR h LIKE 'mailto:%' OR h LIKE 'tel:%')
      AND {host_of('h', 'url')} <> {host('url')}) AS external
  FROM (SELECT page_id, url, {attr('href')} AS h FROM el WHERE tag = 'a' AND {attr('href')} IS NOT NULL) GROUP BY page_id
),
qf AS (
  SELECT src.page_id, coalesce(title.title, '') AS title, coalesce(m.description, '') AS description, coalesce(m.viewport, '') AS viewport,
    coalesce(m.robots, '') AS robots, coalesce(m.og_title, '') AS og_title, qs.words, coalesce(l.total, 0) AS links_total, coalesce(l.external, 0) AS links_external,
    (SELECT arg_min({attr('href')}, pos) FROM el WHERE el.page_id = src.page_id AND tag = 'link' AND {attr('rel')} = 'canonical') AS canonical,
    headings_h2_count AS h2, headings_h3_count AS h3, headings_h4_count AS h4
  FROM src JOIN title USING (page_id) JOIN qs USING (page_id) JOIN hfacts USING (page_id) LEFT JOIN qmeta m USING (page_id) LEFT JOIN qlink l USING (page_id)
),
qp AS (
  SELECT page_id, CASE WHEN length(title) BETWEEN 30 AND 60 THEN 25 WHEN length(title) BETWEEN 20 AND 70 THEN 17 WHEN length(title) > 0 THEN 8 ELSE 0 END AS title_points,
    CASE WHEN length(description) BETWEEN 120 AND 160 THEN 25 WHEN length(description) BETWEEN 80 AND 180 THEN 17 WHEN length(description) > 0 THEN 8 ELSE 0 END AS description_points,
    CASE WHEN h2 > 0 THEN 5 ELSE 0 END + CASE WHEN h3 > 0 THEN 3 ELSE 0 END + CASE WHEN h4 > 0 THEN 2 ELSE 0 END AS heading_points,
    15 - CASE WHEN links_total = links_external THEN 5 ELSE 0 END - CASE WHEN links_external = 0 AND links_total > 0 THEN 3 ELSE 0 END AS link_points,
    10 AS image_points, CASE WHEN words >= 300 THEN 5 ELSE 0 END AS content_points FROM qf
)"""

    def sized(col: str, low: int, high: int) -> str:
        return f"CASE WHEN {col} = '' THEN 'fail' WHEN length({col}) BETWEEN {low} AND {high} THEN 'pass' ELSE 'warn' END"

    checks = [
        ("Title Tag", sized("title", 30, 60), "CASE WHEN title = '' THEN 'Add a title tag (30–60 characters)' WHEN length(title) < 30 THEN 'Too short — aim for 30–60 chars' WHEN length(title) > 60 THEN 'Too long — trim to 60 chars' END"),
        ("Meta Description", sized("description", 120, 160), "CASE WHEN description = '' THEN 'Add a meta description (120–160 characters)' WHEN length(description) < 120 THEN 'Too short — aim for 120–160 chars' WHEN length(description) > 160 THEN 'Too long — trim to 160 chars' END"),
        ("Canonical URL", "CASE WHEN coalesce(canonical, '') <> '' THEN 'pass' ELSE 'warn' END", "CASE WHEN coalesce(canonical, '') = '' THEN 'Consider adding a canonical URL' END"),
        ("Viewport Meta", "CASE WHEN viewport <> '' THEN 'pass' ELSE 'fail' END", "CASE WHEN viewport = '' THEN 'Add a viewport meta tag for mobile' END"),
        ("Robots Meta", "CASE WHEN robots LIKE '%noindex%' THEN 'warn' ELSE 'pass' END", "CASE WHEN robots LIKE '%noindex%' THEN 'Page is set to noindex!' END"),
        ("Open Graph Title", "CASE WHEN og_title <> '' THEN 'pass' ELSE 'warn' END", "CASE WHEN og_title = '' THEN 'Add OG tags for social sharing' END"),
    ]
    difficulty_mods = f"list_sort(list_distinct(regexp_extract_all(low, '\\b(?:{'|'.join(COMMERCIAL_MODIFIERS)})\\b')))"
    products = f"prod AS ({_product_sql()})"
    hops = (f"hops AS ({derived(D.HOPS_FIRST, 'pages')} UNION ALL {derived(D.HOPS_SECOND, 'pages', 'page_id % 6 = 2')}), "
            f"dns AS ({derived(D.HOP_DNS, 'pages')} UNION ALL {derived(D.REDIRECTOR_DNS, 'pages')}), "
            "verdicts AS (SELECT lower(host) AS dns_host, min(address) FILTER (address LIKE '10.%') AS bad FROM dns WHERE address IS NOT NULL GROUP BY 1)")
    unsafe = ("WHEN v.dns_host IS NULL THEN 'Refused: Could not resolve URL hostname' "
              "WHEN v.bad IS NOT NULL THEN 'Refused: Hostname resolves to a non-public address (' || v.bad || ')'")

    return {
        "page_intake": f"""SELECT page_id, url, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM (
  SELECT *, CASE WHEN octet_length(encode(html)) > 5242880 THEN 'HTML content exceeds maximum size of 5 MB'
    WHEN length(url) > 2048 THEN 'URL exceeds maximum length of 2048 characters'
    WHEN coalesce(length({trim('html')}), 0) < 50 THEN 'HTML content too short or empty' END AS reason FROM ({derived(D.SUBMISSIONS, 'pages')}))""",
        "capture_routing": f"SELECT url, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error FROM (SELECT url, {error} AS error FROM ({captures}))",
        "redirect_resolve": f"""WITH RECURSIVE {hops},
walk AS (
  SELECT DISTINCT url, url AS current, 0 AS n_hops, CASE {unsafe} END AS error, false AS done FROM pages LEFT JOIN verdicts v ON v.dns_host = {host('url')}
  UNION ALL
  SELECT w.url, coalesce({resolve('w.current', 'h.location')}, w.current), CASE WHEN h.location IS NULL THEN w.n_hops ELSE w.n_hops + 1 END,
    CASE WHEN h.from_url IS NULL THEN NULL WHEN h.location IS NULL THEN 'Refused: Too many redirects'
      WHEN {host(resolve('w.current', 'h.location'))} IN {_in(BLOCKED_HOSTNAMES)} THEN 'Refused: URL hostname is blocked for security reasons'
      {unsafe}
      WHEN w.n_hops = 5 THEN 'Refused: Too many redirects' END, h.from_url IS NULL
  FROM walk w LEFT JOIN (SELECT * FROM hops WHERE status IN (301, 302, 303, 307, 308)) h ON h.from_url = w.current
    LEFT JOIN verdicts v ON v.dns_host = {host(resolve('w.current', 'h.location'))} WHERE w.error IS NULL AND NOT w.done
)
SELECT url, CASE WHEN error IS NULL THEN current END AS final_url, n_hops, error FROM walk WHERE done OR error IS NOT NULL""",
        "batch_report": f"SELECT count(*) AS total, count(*) FILTER (WHERE e IS NULL) AS ok, count(*) FILTER (WHERE e IS NOT NULL) AS errors FROM (SELECT {error} AS e FROM ({captures}))",
        "batch_documents": pages(f"""SELECT batch, count(*) AS total, '[' || string_agg(result, ',' ORDER BY page_id) || ']' AS results FROM (
  SELECT c.page_id, (row_number() OVER (ORDER BY c.page_id) - 1) // 50 AS batch, CASE WHEN e IS NOT NULL THEN '{{"url":"' || c.url || '","status":"error","error":"' || e || '"}}'
    ELSE '{{"url":"' || c.url || '","score":' || l.score || ',"audit":{{"score":' || s.score || ',"grade":"' || s.grade || '","counts":{{"critical":' || s.critical
      || ',"warning":' || s.warning || ',"notice":' || s.notice || '}},"summary":"' || s.summary || '"}},"status":"ok"}}' END AS result
  FROM (SELECT *, {error} AS e FROM ({aug_captures})) c JOIN legacy l USING (page_id) JOIN scored s USING (page_id)) GROUP BY batch"""),
        "report_csv": pages(f"""SELECT c.url, CASE WHEN e IS NULL THEN 'ok' ELSE 'error' END AS status, {", ".join(f"CASE WHEN e IS NULL THEN {v} END AS {k}" for k, v in (
            ('score', 'l.score'), ('critical_issues', 's.critical'), ('warnings', 's.warning'), ('title', 'r.title'), ('title_length', 'r.title_length'),
            ('description_length', 'r.description_length'), ('h1_count', 'r.headings_h1_count'), ('word_count', 'r.word_count'), ('images_total', 'r.images_total'),
            ('images_without_alt', 'r.images_without_alt'), ('has_viewport', 'r.has_viewport'), ('has_schema', 'r.schema_has_structured_data'),
            ('flesch_kincaid_grade', 'r.grade'), ('internal_links', 'r.links_internal'), ('external_links', 'r.links_external'), ('lcp', 'r.lcp'), ('fcp', 'r.fcp'), ('cls', 'r.cls')))}
FROM (SELECT *, {error} AS e FROM ({aug_captures})) c JOIN report r USING (page_id) JOIN legacy l USING (page_id) JOIN sev s USING (page_id)"""),
        "export_json_csv": f"WITH {products} SELECT page_id, title, price, CASE WHEN variants = '' THEN '[]' ELSE '[\"' || replace(variants, '|', '\",\"') || '\"]' END AS variants FROM prod",
        "document_rows": f"""WITH d AS (SELECT p_partkey AS doc_id, p_partkey % 5 AS k, p_name, p_size FROM part)
SELECT doc_id, r.pos, r.name, r.value FROM d, LATERAL (VALUES
  (0, 0, 'url', 'https://a.example/' || doc_id), (0, 0, 'price', '$' || p_size || '.50'), (0, 0, 'tags', '["x","y"]'), (0, 1, 'url', 'https://b.example/'), (0, 1, 'error', 'HTTP 404'),
  (1, 0, 'name', p_name), (1, 0, 'size', p_size || ''), (1, 0, 'note', 'a, b'), (1, 1, 'size', '7'), (1, 1, 'name', NULL),
  (2, 0, 'id', doc_id || ''), (2, 0, 'b', '1.5'), (2, 1, 'b', 'true'), (2, 1, 'id', '2')) r(kind, pos, name, value) WHERE kind = k""",
        "export_documents_csv": """WITH d AS (SELECT p_partkey AS doc_id, p_partkey % 5 AS k, p_name, p_size FROM part)
SELECT doc_id, 2 AS n_rows, replace(CASE k WHEN 0 THEN 'url,price,tags~https://a.example/' || doc_id || ',$' || p_size || '.50,"[""x"",""y""]"~https://b.example/,,~'
  WHEN 1 THEN 'name,size,note~' || p_name || ',' || p_size || ',"a, b"~,7,~' ELSE 'id,b~' || doc_id || ',1.5~2,true~' END, '~', chr(13) || chr(10)) AS csv FROM d WHERE k < 3""",
        "export_documents_header": """SELECT 'https://a.example/' || p_partkey AS url, '$' || p_size || '.50' AS price, '["x","y"]' AS tags FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT 'https://b.example/', NULL, NULL FROM part WHERE p_partkey % 5 = 0""",
        "price_csv": _points("SELECT strftime(captured_at, '%Y-%m-%dT%H:%M:%S') AS timestamp, price_text AS price, 'part ' || product AS title, CASE WHEN price_value IS NULL THEN 'no price' ELSE '' END AS error FROM pv"),
        "price_json_source": _points("SELECT cast(captured_at AS date) AS date, currency, max(price_value) AS price FROM pv GROUP BY ALL"),
        "history_append": history.replace("{cols}", "email, url, score, created_at, " + compact),
        "history_latest": pages("SELECT email, rank, url, score, created_at FROM (SELECT email, url, score, created_at, row_number() OVER (PARTITION BY email ORDER BY created_at DESC, url DESC) AS rank FROM (SELECT *, "
                                + ", ".join(f"{v} AS {k}" for k, v in D.OWNERS.items()) + " FROM scored)) WHERE rank <= 20"),
        "history_compact": history.replace("{cols}", "email, url, " + compact),
        "price_append": _points("SELECT product, store, price_text, price_value, currency, captured_at FROM pv"),
        "price_latest": _points("SELECT product, rank, price_text, price_value, currency, captured_at FROM pr WHERE rank <= 60"),
        # extraction
        "elements": pages("SELECT page_id, kind, coalesce(tag, '') AS tag, count(*) AS n FROM tk GROUP BY ALL"),
        "elements_nesting": pages(f"""SELECT e.page_id, e.tag, count(*) AS n, sum(e.pos) AS sum_pos, sum(d.depth - CASE WHEN e.tag IN {_in(BOILERPLATE_TAGS)} AND e.close_pos > e.pos THEN 1 ELSE 0 END) AS sum_depth,
  count(*) FILTER (WHERE e.pos > h.pos AND e.pos < h.close_pos) AS n_in_head, sum(len(list_distinct(e.names))) AS n_attrs
FROM el e JOIN dep d USING (page_id, pos) LEFT JOIN head h ON h.page_id = e.page_id GROUP BY e.page_id, e.tag"""),
        "visible_text": pages("SELECT page_id, text FROM vis"),
        "meta_tags": pages("SELECT *, length(coalesce(description, '')) AS description_length FROM meta"),
        "meta_map": pages(f"""SELECT page_id, key, arg_max(value, pos) AS value FROM (SELECT page_id, pos,
  coalesce(nullif({attr('name')}, ''), nullif({attr('property')}, ''), nullif({attr('http-equiv')}, ''), nullif({attr('charset')}, '')) AS key,
  coalesce(nullif({attr('content')}, ''), {attr('charset')}, '') AS value FROM el WHERE tag = 'meta') WHERE key IS NOT NULL GROUP BY page_id, key"""),
        "title_stats": pages("SELECT * FROM title"),
        "doc_lang_charset": pages("SELECT * FROM doc"),
        "canonical": pages("SELECT * FROM canon"),
        "favicon": pages("SELECT page_id, has_favicon FROM report"),
        "hreflang": pages(f"SELECT page_id, lang, href, {host_of('href', 'url')} AS host FROM hre"),
        "robots_directives": pages("""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS ordinal, d AS directive FROM (
  SELECT page_id, unnest(ds) AS d, generate_subscripts(ds, 1) AS i FROM (SELECT page_id, list_transform(string_split(robots, ','), lambda d: lower(trim(d))) AS ds FROM meta WHERE robots IS NOT NULL)) WHERE d <> ''"""),
        "headings": pages("SELECT page_id, level, count(*) AS n, count(*) FILTER (WHERE text = '') AS n_empty, string_agg(text, '|' ORDER BY pos) AS texts FROM hd GROUP BY page_id, level"),
        "heading_skips": pages("SELECT page_id, level AS skipped_from, nxt AS skipped_to FROM lvls WHERE nxt - level > 1"),
        "links_detail": pages("SELECT page_id, pos, href, target_host, link_class, nofollow, empty_anchor, text FROM lks"),
        "links_summary": pages("SELECT page_id, COLUMNS('links_(.*)') AS '\\1' FROM lfacts"),
        "external_hosts": pages("""SELECT page_id, host, n, rank FROM (SELECT page_id, target_host AS host, count(*) AS n, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(pos)) AS rank
  FROM lks WHERE link_class = 'external' GROUP BY page_id, target_host)"""),
        "images_detail": pages("SELECT page_id, pos, src, missing_alt, empty_alt, no_dimensions, lazy, has_srcset, data_uri, legacy_format FROM im"),
        "images_summary": pages("""SELECT i.page_id, COLUMNS(i.* EXCLUDE (page_id)), coalesce(e.examples_missing_alt, '') AS examples_missing_alt FROM (SELECT page_id, COLUMNS('images_(.*)') AS '\\1' FROM ifacts) i LEFT JOIN (
  SELECT page_id, string_agg(src, '|' ORDER BY pos) AS examples_missing_alt FROM im WHERE missing_alt GROUP BY page_id) e USING (page_id)"""),
        "structured_data": pages("SELECT l.page_id, l.block, l.valid, t.type, coalesce(t.missing, '') AS missing FROM ld l LEFT JOIN tmiss t USING (page_id, block)"),
        "viewport": pages("SELECT * FROM vport"),
        "render_signals": pages("SELECT s.* EXCLUDE (third_party_count), stylesheets_count AS render_blocking_styles, i.images_total AS image_count, i.images_without_dimensions, i.images_lazy AS lazy_images FROM sig s JOIN ifacts i USING (page_id)"),
        "third_party_hosts": pages("SELECT * FROM tp"),
        "vitals_estimate": pages("SELECT *, 'markup-estimate' AS source FROM vit"),
        "page_report": pages("SELECT * EXCLUDE (first_h1, skips, viewport_content, render_blocking_styles) FROM report"),
        # text
        "keyword_tokens": pages(f"SELECT page_id, pos, word, word IN {_in(STOP_WORDS)} AS is_stop FROM kw"),
        "top_words": grams(1), "top_bigrams": grams(2), "top_trigrams": grams(3),
        "content_stats": pages("SELECT page_id, word_count, text_chars, sentence_count, avg_sentence_length, long_sentences, paragraph_count FROM tstats"),
        "syllables": pages(f"SELECT word, {syllables('word')} AS n FROM (SELECT DISTINCT word FROM kw)"),
        "readability": pages("SELECT page_id, reading_ease, grade, word_count, CASE WHEN level = 'unknown' THEN 0 ELSE sentence_count END AS sentence_count, syllable_count, avg_sentence_length, level FROM tstats"),
        "readability_documents": f"WITH {text_ctes('SELECT doc_id AS page_id, text FROM documents')} SELECT page_id AS doc_id, reading_ease, grade, word_count, CASE WHEN level = 'unknown' THEN 0 ELSE sentence_count END AS sentence_count, syllable_count, CASE WHEN level = 'unknown' THEN 0.0 ELSE avg_sentence_length END AS avg_sentence_length, level FROM tstats",
        "quick_text_stats": pages("SELECT page_id, words, sentences, CASE WHEN sentences > 0 THEN round(words / sentences, 4) ELSE 0.0 END AS avg_sentence_length FROM qs").replace("\nSELECT page_id, words", f",{quick}\nSELECT page_id, words"),
        "keyword_difficulty": f"""WITH k AS (SELECT p_partkey, keyword, trim(keyword) AS t, lower(trim(keyword)) AS low FROM ({derived({'p_partkey': 'p_partkey', **D.KEYWORDS}, 'part')})),
p AS (SELECT *, length(t) AS characters, list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '') AS parts, {difficulty_mods} AS mods FROM k),
s AS (SELECT *, len(parts) AS words, least(40, least(15, characters // 3) + CASE WHEN regexp_matches(low, '^(how|what|why|when|where|who|which)\\b') THEN 10 ELSE 0 END) AS density_score,
  least(60, CASE WHEN len(mods) > 0 THEN 30 ELSE 15 END + greatest(0, 45 - (len(parts) - 1) * 12)) AS competition_score FROM p)
SELECT p_partkey, keyword, characters, array_to_string(mods, ',') AS modifiers, words, array_to_string(list_filter(parts, lambda w: lower(w) IN {_in(STOP_WORDS)}), ',') AS stop_words,
  density_score, competition_score, least(100, density_score + competition_score) AS score,
  CASE WHEN density_score + competition_score <= 25 THEN 'easy' WHEN density_score + competition_score <= 50 THEN 'moderate' WHEN density_score + competition_score <= 75 THEN 'hard' ELSE 'very hard' END AS band, 'low' AS confidence FROM s""",
        # rules and scores
        "findings": pages("SELECT * FROM fnd"),
        "finding_messages": pages(_messages_sql()),
        "findings_ranked": pages("SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, impact DESC, rule) AS rank, rule, severity, impact FROM fnd"),
        "category_scores": pages("SELECT * FROM cats"),
        "page_score": pages("SELECT * FROM scored"),
        "legacy_score": pages("SELECT * FROM legacy"),
        "quick_score": pages("""SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (
  SELECT *, least(100, title_points + description_points + heading_points + link_points + image_points + content_points) AS score FROM qp)""").replace("\nSELECT *, CASE WHEN score >= 90", f",{quick}\nSELECT *, CASE WHEN score >= 90"),
        "status_bands": pages("").rstrip() + "," + quick + "\n" + "\nUNION ALL ".join(f"SELECT page_id, '{n}' AS \"check\", {s} AS status, {a} AS advice FROM qf" for n, s, a in checks),
        "category_bands": pages("SELECT page_id, category, CASE WHEN score / max >= 0.85 THEN 'pass' WHEN score / max >= 0.6 THEN 'warn' ELSE 'fail' END AS status FROM cats"),
        "alt_bands": pages("""SELECT page_id, alt_pct, CASE WHEN alt_pct >= 80 THEN 'pass' WHEN alt_pct >= 50 THEN 'warn' ELSE 'fail' END AS status FROM (
  SELECT page_id, CASE WHEN images_total > 0 THEN cast(floor((images_total - images_without_alt) / images_total * 100 + 0.5) AS int) ELSE 100 END AS alt_pct FROM ifacts)"""),
        "broken_link_candidates": pages(f"SELECT page_id, pos, {attr('href')} AS href FROM el WHERE tag = 'a' AND {attr('href')} IN ('#', '', 'javascript:void(0)')"),
        "rules_catalog": pages(f"""SELECT c.rule, c.category, c.severity, c."check", w.weight, coalesce(x.issues, 0) AS issues, coalesce(x.pages, 0) AS pages
FROM (VALUES {", ".join("('" + "', '".join(p.replace("'", "''") for p in row) + "')" for row in CATALOG)}) c(rule, category, severity, "check") JOIN weights w USING (category)
LEFT JOIN (SELECT category, sum(issues) AS issues, count(*) FILTER (WHERE issues > 0) AS pages FROM cats GROUP BY category) x USING (category)"""),
        "grade_by_host": pages(f"SELECT {host('url')} AS host, grade, count(*) AS pages, round(avg(score), 2) AS avg_score, sum(critical) AS critical FROM scored GROUP BY ALL"),
        # URLs
        "host_of": pages("SELECT page_id, pos, href, target_host AS host FROM lks"),
        "is_absolute": pages(f"SELECT page_id, pos, href, regexp_matches(href, {SCHEME}) AS is_absolute FROM lks"),
        "is_external": pages(f"SELECT page_id, pos, href, NOT (href LIKE '#%' OR href LIKE 'javascript:%' OR href LIKE 'mailto:%' OR href LIKE 'tel:%') AND target_host <> {host('url')} AS is_external FROM lks"),
        "resolve_url": pages(f"SELECT page_id, pos, href, {resolve('url', 'href')} AS resolved FROM lks"),
        "url_admission": f"SELECT url, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN host END AS host, CASE WHEN reason IS NULL THEN port END AS port FROM (SELECT url, {_admission('url')} FROM ({derived(D.FETCH_URLS, 'pages')}))",
        "address_admission": f"""WITH dns AS ({derived(D.DNS, 'pages')}), v AS (SELECT host, min(CASE WHEN NOT ({_public('address')}) THEN address END) AS bad FROM dns WHERE address IS NOT NULL GROUP BY host),
j AS (SELECT a.url, a.reason AS r0, a.host, a.port, v.host AS known, v.bad FROM (SELECT url, {_admission('url')} FROM pages) a LEFT JOIN v ON v.host = a.host),
r AS (SELECT *, CASE WHEN r0 IS NOT NULL THEN r0 WHEN known IS NULL THEN 'Could not resolve URL hostname' WHEN bad IS NOT NULL THEN 'Hostname resolves to a non-public address (' || bad || ')' END AS reason FROM j)
SELECT url, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN host END AS host, CASE WHEN reason IS NULL THEN port END AS port FROM r""",
        "address_admission_networks": f"""WITH {_networks_sql()}, dns AS ({derived(D.DNS, 'pages')}),
listed AS (SELECT address, arg_max(public, lo) AS listed FROM (SELECT DISTINCT address FROM dns WHERE regexp_matches(address, '^[0-9.]+$')) a
  JOIN nets ON {_V4.format(x='a.address')} BETWEEN lo AND hi GROUP BY address),
v AS (SELECT host, min(CASE WHEN NOT coalesce(listed, {_public('address')}) THEN address END) AS bad FROM dns LEFT JOIN listed USING (address) WHERE address IS NOT NULL GROUP BY host),
j AS (SELECT a.url, a.reason AS r0, a.host, a.port, v.host AS known, v.bad FROM (SELECT url, {_admission('url')} FROM pages) a LEFT JOIN v ON v.host = a.host),
r AS (SELECT *, CASE WHEN r0 IS NOT NULL THEN r0 WHEN known IS NULL THEN 'Could not resolve URL hostname' WHEN bad IS NOT NULL THEN 'Hostname resolves to a non-public address (' || bad || ')' END AS reason FROM j)
SELECT url, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN host END AS host, CASE WHEN reason IS NULL THEN port END AS port FROM r""",
        "network_lookup": f"""WITH {_networks_sql()}, a AS (SELECT DISTINCT address FROM ({derived(D.ADDRESSES, 'orders')})),
n AS (SELECT address, CASE WHEN address LIKE 'host%' THEN NULL WHEN address LIKE '11.%' THEN {_V4.format(x='address')}
  ELSE {_V6.format(x='address')} + ('0x' || split_part(address, ':', 3))::HUGEINT * 1208925819614629174706176 + ('0x' || split_part(address, ':', 5))::HUGEINT END AS n FROM a),
hits AS (SELECT address, arg_min({{'network': network, 'public': public}}, hi - lo) AS best FROM n JOIN nets ON n.n BETWEEN lo AND hi GROUP BY address)
SELECT a.address, best.network AS network, best.public AS public FROM a LEFT JOIN hits USING (address)""",
        # products
        "platform_detect": f"WITH {products} SELECT page_id, url, platform FROM prod",
        "product_extract": f"WITH {products} SELECT * FROM prod",
        "product_links": f"WITH prod AS ({derived(D.PRODUCT_PAGES, 'part')}) SELECT page_id, url, cast(r.rank AS int) AS rank, regexp_extract(url, '^[a-z]+://[^/]*', 0) || r.href AS link FROM prod JOIN part ON p_partkey = page_id, (VALUES (1), (2), (3)) k(k), LATERAL (SELECT k AS rank, CASE k WHEN 1 THEN '/products/' || p_partkey WHEN 2 THEN '/product/' || p_size ELSE '/collections/product-x' END AS href) r WHERE page_id % 5 = 4",
        "competitor_batch": f"WITH {products} SELECT platform, count(*) AS total, count(*) FILTER (WHERE title <> '' OR price <> '') AS successful FROM prod GROUP BY platform",
        "price_compare": f"WITH {products} SELECT page_id AS ordinal, url, platform, title, price, currency FROM prod",
        "product_custom": _custom_sql(),
        "product_selectors": _selector_sql(),
        # prices
        "parse_price": _points("SELECT DISTINCT price_text, price_value AS parsed, price AS stripped, dollar_price AS stripped_dollar, currency FROM pv"),
        "parse_price_locale": _points(f"SELECT DISTINCT price_text, {_locale('price_text')} AS value FROM pv"),
        "price_history": _points("""SELECT product, count(*) AS points, min(price_value) AS lowest, max(price_value) AS highest, arg_min(price_text, rank) AS current_price, arg_min(currency, rank) AS currency,
  string_agg(price_text, '|' ORDER BY rank DESC) FILTER (rank <= 60) AS history FROM pr GROUP BY product"""),
        "price_series": _points("SELECT product, cast(captured_at AS date) AS date, price, min(price) OVER (PARTITION BY product) AS lowest, max(price) OVER (PARTITION BY product) AS highest FROM ok"),
        "price_change_alerts": _points(f"SELECT product, prev, curr, {_PCT} AS pct, CASE WHEN curr < prev THEN 'drop' ELSE 'increase' END AS direction FROM (SELECT product, max(price) FILTER (WHERE prank = 2) AS prev, max(price) FILTER (WHERE prank = 1) AS curr FROM ok GROUP BY product) WHERE prev <> curr"),
        "price_threshold_alerts": _points(f"SELECT o.product, o.price AS curr, t.threshold FROM ok o JOIN ({derived(D.THRESHOLDS, 'part')}) t ON t.product = o.product WHERE prank = 1 AND t.threshold > 0 AND o.price <= t.threshold"),
        "price_drop_strict": _points(f"SELECT product, prev, curr, {_PCT} AS pct FROM (SELECT product, max(dollar_price) FILTER (WHERE rank = 2) AS prev, max(dollar_price) FILTER (WHERE rank = 1) AS curr FROM pr GROUP BY product) WHERE curr < prev"),
        "price_report_summary": _points("""SELECT (SELECT count(DISTINCT product) FROM cur) AS num_products, (SELECT round(avg(price), 2) FROM cur) AS avg_price, (SELECT count(DISTINCT store) FROM cur) AS num_stores,
  (SELECT count(*) FROM (SELECT max(price) FILTER (WHERE srank = 2) AS prev, max(price) FILTER (WHERE srank = 1) AS curr FROM ok GROUP BY product, store) WHERE curr < prev) AS price_drops"""),
        "price_report_products": _points("SELECT product, store, price, price = min(price) OVER (PARTITION BY product) AS is_best_price, round(max(price) OVER (PARTITION BY product) - price, 2) AS savings, last_checked FROM cur"),
        "price_report_alerts": _points(f"""SELECT product, store, prev AS previous_price, curr AS current_price, {_PCT} AS change_pct, curr < prev AS is_drop, date FROM (
  SELECT product, store, max(price) FILTER (WHERE srank = 2) AS prev, max(price) FILTER (WHERE srank = 1) AS curr, cast(max(captured_at) AS date) AS date FROM ok GROUP BY product, store) WHERE prev <> curr"""),
        "price_trend_30d": _points("""SELECT product, date, min(low) OVER w AS min_30d, max(high) OVER w AS max_30d, cast(sum(cents) OVER w AS double) / sum(n) OVER w / 100 AS avg_30d FROM (
  SELECT product, cast(captured_at AS date) AS date, sum(cast(round(price * 100) AS bigint)) AS cents, count(*) AS n, min(price) AS low, max(price) AS high FROM ok GROUP BY ALL)
WINDOW w AS (PARTITION BY product ORDER BY date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)"""),
        # accounts
        "subscription_state": f"{subscription} SELECT email, customer_id, premium, since FROM fin",
        "premium_flag": f"{subscription} SELECT email, premium, since FROM fin",
        "rate_breaches": breaches,
        "request_counts": f"SELECT client, route, date_trunc('minute', ts) AS window_start, count(*) AS n FROM {events['log']} GROUP BY ALL",
        "monthly_quota": f"SELECT client AS account, cast(date_trunc('month', ts) AS date) AS month, count(*) AS n, count(*) > 50 AS over_quota FROM {events['log']} WHERE route = 'analyze' GROUP BY ALL",
        # streams
        "stream_page_audit": pages("SELECT * FROM scored"),
        "stream_price_alerts": _points(f"""SELECT product, captured_at, prev, price AS curr, CASE WHEN price < prev THEN 'drop' ELSE 'increase' END AS direction, NULL::DOUBLE AS threshold
FROM (SELECT *, lead(price) OVER (PARTITION BY product ORDER BY prank) AS prev FROM ok) WHERE prev <> price
UNION ALL SELECT o.product, captured_at, NULL, price, 'threshold', t.threshold FROM ok o JOIN ({derived(D.THRESHOLDS, 'part')}) t ON t.product = o.product WHERE t.threshold > 0 AND price <= t.threshold"""),
        "stream_capture_dedup": f"""WITH RECURSIVE v AS (SELECT * FROM {events['visit']}),
kept AS (SELECT url, min(fetched_at) AS fetched_at FROM v GROUP BY url
  UNION ALL SELECT kept.url, min(v.fetched_at) FROM kept JOIN v ON v.url = kept.url AND v.fetched_at >= kept.fetched_at + INTERVAL 1 HOUR GROUP BY kept.url, kept.fetched_at)
SELECT url, fetched_at FROM kept""",
        "stream_rate_breaches": breaches,
        "stream_subscription_state": f"{subscription} SELECT email, customer_id, premium, since FROM fin WHERE follows OR co IS NOT NULL",
    }


def _product_sql() -> str:
    """Products by construction: the markup is built from ``part``, so the fields are known."""
    origin = "regexp_extract(url, '^[a-z]+://[^/]*', 0)"
    return f"""SELECT page_id, url, CASE k WHEN 0 THEN 'shopify' WHEN 1 THEN 'woocommerce' WHEN 2 THEN 'amazon' ELSE 'generic' END AS platform,
  p_name AS title, CASE k WHEN 0 THEN '$' || p_size || '.50' WHEN 1 THEN '$' || p_size || '.25' WHEN 2 THEN p_size || '.99' WHEN 3 THEN p_size || '.75' ELSE '$' || p_size END AS price,
  CASE k WHEN 0 THEN 'Fine' || p_type WHEN 1 THEN p_brand WHEN 2 THEN trim(repeat(p_type || ' text ', 60)) WHEN 3 THEN p_brand ELSE '' END AS description,
  CASE k WHEN 0 THEN {origin} || '/img/' || page_id || '.jpg' WHEN 1 THEN {origin} || '/item/a.jpg' WHEN 2 THEN 'https://img.example/' || page_id || '.jpg'
    WHEN 3 THEN {origin} || '/i/zoom.jpg|' || {origin} || '/i/main-two.jpg|' || {origin} || '/i/one.jpg' ELSE '' END AS images,
  CASE k WHEN 0 THEN 'S|Large' WHEN 1 THEN 'Choose|red' WHEN 2 THEN 'Blue' ELSE '' END AS variants, CASE k WHEN 2 THEN '$' ELSE 'USD' END AS currency
FROM (SELECT *, page_id % 5 AS k FROM ({derived(D.PRODUCT_PAGES, 'part')}) JOIN part ON p_partkey = page_id)"""


def _selector_sql() -> str:
    """Matches by construction of the product pages: selector, kind of page, number and texts."""
    empty4 = "'|||'"
    rows = [
        ("div.summary > p.price > span", 1, 1, "'$' || p_size || '.25'"), ("h1 + h1", 0, 1, "p_name"), ("h1 ~ img", 0, 2, "'|'"), ("h1 ~ img", 3, 4, empty4),
        ("img:not([data-src])", 0, 1, "''"), ("img:not([data-src])", 1, 1, "''"), ("img:not([data-src])", 2, 1, "''"), ("img:not([data-src])", 3, 4, empty4),
        ("li:first-child", 4, 1, "'p'"), ("li:nth-child(2n+1)", 4, 2, "'p|ox'"),
        ('[class^="a-price"]', 2, 4, "'$' || p_size || '99|$|' || p_size || '|99'"), ('span[class|="a"]', 2, 4, "'$' || p_size || '99|$|' || p_size || '|99'"),
        ('img[src$=".jpg"]', 0, 1, "''"), ('img[src$=".jpg"]', 1, 1, "''"), ('img[src$=".jpg"]', 2, 1, "''"), ('img[src$=".jpg"]', 3, 4, empty4),
        ('[class~="price"]', 1, 1, "'$' || p_size || '.25'"), ('[class~="price"]', 3, 1, "''"), ('[class~="price"]', 4, 1, "'$' || p_size"),
        ("option:last-child", 0, 1, "'Large'"), ("option:last-child", 1, 1, "'Red'"),
        ("ul > li:not(.product-card) > a.product-link + a", 4, 1, "'x'"),
    ]
    union = " UNION ALL ".join(
        f"SELECT page_id, '{s}' AS selector, {n} AS n, {t} AS texts FROM prod WHERE k = {k}" for s, k, n, t in rows)
    every = ", ".join(f"('{s}')" for s in dict.fromkeys(r[0] for r in rows))
    return f"""WITH prod AS (SELECT p_partkey AS page_id, p_partkey % 5 AS k, p_name, p_size FROM part), hits AS ({union})
SELECT prod.page_id, s.selector, coalesce(n, 0) AS n, coalesce(texts, '') AS texts
FROM prod, (VALUES {every}) s(selector) LEFT JOIN hits ON hits.page_id = prod.page_id AND hits.selector = s.selector"""


def _custom_sql() -> str:
    return f"""SELECT page_id, url, CASE k WHEN 0 THEN 'Shop' ELSE p_name END AS title,
  CASE k WHEN 1 THEN '$' || p_size || '.25' WHEN 3 THEN '' WHEN 4 THEN '$' || p_size END AS price, CASE k WHEN 3 THEN p_brand END AS description,
  '' AS images, CASE k WHEN 0 THEN 'Small|Large' WHEN 1 THEN 'Choose|Red' ELSE '' END AS variants
FROM (SELECT *, page_id % 5 AS k FROM ({derived(D.PRODUCT_PAGES, 'part')}) JOIN part ON p_partkey = page_id)"""
