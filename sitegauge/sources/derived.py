"""Input tables derived from the given ones, as expressions both SQL dialects share.

The given ``pages`` carry few head elements and no images, prices or JSON-LD; the expressions
insert such markup by page number, so that every rule fires on some pages and not on others.
Each table is a dict of column -> expression over one given table. The same text builds the
DataFrame here and the comparison SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD = [
    """case page_id % 4 when 1 then '<meta name="description" content="' || repeat('Short text. ', 7) || '">'
       when 2 then '<meta name="Description" content=" ' || repeat('A page about goods. ', 7) || '">'
       when 3 then '<meta property="description" content="' || repeat('A longer page about goods. ', 8) || '">' else '' end""",
    """case when page_id % 13 = 5 then '<meta name="description" content="The last one wins.">' else '' end""",
    """case page_id % 5 when 1 then '<link rel="canonical" href="/about">'
       when 2 then '<link rel="canonical" href="' || url || '"><link rel="canonical" href="/second">'
       when 3 then '<link rel="canonical" href="https://Other.example.org/x">'
       when 4 then '<link href="' || url || '/" rel="canonical">' else '' end""",
    """case page_id % 6 when 0 then '<meta name="robots" content="noindex, nofollow">'
       when 1 then '<meta name="robots" content="INDEX,  follow, ,">' when 2 then '<meta name="robots" content="none">' else '' end""",
    """case page_id % 3 when 1 then '<meta property="og:title" content="Goods"><meta property="og:description" content="All goods">'
       when 2 then '<meta property="og:title" content="Goods &amp; more"><meta property="og:description" content="All"><meta property="og:image" content="https://img.example.org/og.png">' else '' end""",
    """case when page_id % 4 = 2 then '<meta property="og:image:alt" content="Goods"><meta property="og:type" content="article">' else '' end""",
    """case page_id % 5 when 1 then '<meta name="twitter:card" content="Summary">'
       when 2 then '<meta name="twitter:card" content="banner"><meta name="twitter:creator" content="@goods">' else '' end""",
    """case page_id % 4 when 1 then '<meta name="viewport" content="width=device-width, initial-scale=1">'
       when 2 then '<meta name="Viewport" content="width = device-width, user-scalable=no">'
       when 3 then '<meta name="viewport" content="width=600, maximum-scale=1.5">' else '' end""",
    """case when page_id % 7 = 0 then '<meta name="keywords" content="goods, shop">' else '' end""",
    """case when page_id % 11 = 0 then '<meta http-equiv="Refresh" content="5; url=/next">' else '' end""",
    """case when page_id % 2 = 0 then '<link rel="shortcut icon" href="/favicon.ico">' else '' end""",
    """case page_id % 8 when 1 then '<link rel="alternate" hreflang="en" href="/en"><link rel="alternate" hreflang="x-default" href="https://www.example.com/">'
       when 2 then '<link rel="alternate" hreflang="de" href="https://de.example.com/">' else '' end""",
    """repeat('<link rel="stylesheet" href="https://cdn.example.net/s.css">', cast(page_id % 7 as int))""",
    """case when page_id % 9 = 1 then '<link rel="preconnect" href="https://cdn.example.net"><link rel="preload" href="/f.woff2">' else '' end""",
    """case page_id % 6 when 3 then '<script src="https://a.example.net/a.js" defer></script><script src="/b.js" async="async"></script><script type="module" src="/c.js"></script>'
       when 4 then '<script src="https://a.example.net/a.js"></script><script src="https://b.example.net/b.js"></script><script src="https://c.example.net/c.js"></script><script src="//d.example.net/d.js"></script>' else '' end""",
    """case page_id % 7 when 1 then '<script type="application/ld+json">{"@context": "https://schema.org", "@type": "Article", "headline": "H"}</script>'
       when 2 then '<script type="application/ld+json">{"@type": "Article", </script><script type="application/ld+json"> </script>'
       when 3 then '<script type="application/ld+json">{"@context": "https://schema.org", "@graph": [{"@type": "Organization", "name": "N", "url": "U"}, {"@type": "WebSite", "name": "N"}]}</script>'
       when 4 then '<script type="application/ld+json">{"@context": "https://schema.org", "@type": ["Product", "Thing"], "name": null}</script>'
       when 5 then '<script type="application/ld+json">[{"@context": "http://schema.org", "@type": "FAQPage"}, {"name": "untyped"}, [{"@type": "Event", "name": "E", "location": {"@type": "Place"}}]]</script><script type="application/ld+json">{broken}</script>'
       when 6 then '<script type="application/ld+json">{"@type": "Product", "name": "N", "image": "I", "offers": {"price": 1}}</script>' else '' end""",
]

_BODY = [
    """case page_id % 6 when 1 then '<img src="/img/a.jpg"><img src="/img/b.png?v=1" alt="b" width="10" height="20"><img src="c.gif" alt=" ">'
       when 2 then repeat('<img src="/img/product.jpg" alt="x" width="10">', 12)
       when 3 then repeat('<img src="/img/p.webp" alt="p" srcset="/img/p2.webp 2x" loading="Lazy" width=10 height=20>', 5)
       when 4 then repeat('<img src="data:image/gif;base64,R0lGOD" alt="d">', 6)
       when 5 then '<img src="https://img.example.org/x" alt><img alt="none">' else '' end""",
    """case page_id % 7 when 1 then '<h1>Other <em>head</em></h1>' when 2 then '<h2> </h2><h2>Second</h2>'
       when 3 then '<h2>Two</h2><h4>Four</h4>' when 4 then '<h3>Sub &amp; part</h3><h6>Six</h6>' else '' end""",
    """case page_id % 4 when 1 then '<a href="mailto:a@example.com">mail</a><a href="#">top</a><a href="javascript:void(0)">js</a><a href="tel:+1">call</a><a href="">none</a>'
       when 2 then '<a rel="nofollow noopener" href="https://ext.example.org/a">ext</a><a href="https://ext.example.org/b"> </a><a href="https://Two.example.org/">two</a>'
       when 3 then '<a href="contact.html">contact</a><a href="?page=3">next</a><a href="../up">up</a><a href="//cdn.example.org/x">cdn</a><a href="/pic"><img src="/img/t.webp" alt="t" width="1" height="1"></a><a href="/The#x">again</a>' else '' end""",
    """case when page_id % 10 = 1 then '<iframe src="https://video.example.org/v"></iframe><embed src="/e.swf">' else '' end""",
    """case when page_id % 9 = 4 then '<p>&#8364; 5 &#x27;ok&#x27; &lt;b&gt; na&iuml;ve &Eacute;tat &uuml;ber &#150; Stra&szlig;e &frac12; &#00000065;&#x0000000042;</p>' else '' end""",
    """case when page_id % 5 = 2 then '<aside>side <form>form<input name="q"></form> end</aside>' else '' end""",
    """case when page_id % 8 = 5 then repeat('<a href="https://ext.example.org/list">item</a> ', 101) else '' end""",
]


def _joined(parts: list[str]) -> str:
    return " || ".join(f"({p})" for p in parts)


_INSERTED = f"replace(replace(html, '</head>', {_joined(_HEAD)} || '</head>'), '<article>', '<article>' || {_joined(_BODY)})"

PAGES_AUG = {
    "page_id": "page_id",
    "url": "url",
    "html": (
        "case when page_id % 17 = 3 then replace({h}, 'title>', 'caption>') "
        "when page_id % 19 = 4 then replace({h}, '<html lang=', '<html data-lang=') else {h} end"
    ).format(h=_INSERTED),
}

CAPTURES = {
    "page_id": "page_id",
    "url": "url",
    "status": "case page_id % 7 when 1 then 404 when 2 then 500 else 200 end",
    "content_type": "case page_id % 5 when 1 then 'application/pdf' when 2 then 'application/xhtml+xml' else 'text/html; charset=utf-8' end",
    "refusal": "case when page_id % 11 = 3 then 'Too many redirects' end",
    "html": "html",
}

# Intake candidates: whole pages, blank pages, pages below the minimum, over-long URLs.
SUBMISSIONS = {
    "page_id": "page_id",
    "url": "case when page_id % 9 = 2 then url || repeat('x', 2048) when page_id % 9 = 5 then null else url end",
    "html": "case page_id % 8 when 1 then '' when 2 then '  <p>short</p>   ' when 3 then null else html end",
}

HOPS_FIRST = {
    "from_url": "url",
    "status": "case page_id % 6 when 1 then 301 when 2 then 302 when 3 then 307 when 4 then 308 when 5 then 303 else 200 end",
    "location": (
        "case page_id % 6 when 1 then '/moved/' || page_id when 2 then 'https://r.example.com/s/' || page_id "
        "when 3 then url when 4 then 'http://localhost/admin' end"
    ),
}
# Second hops of the pages that were sent to the redirector.
HOPS_SECOND = {
    "from_url": "'https://r.example.com/s/' || page_id",
    "status": "302",
    "location": "'final'",
}

_CENTS = "cast(round(l_extendedprice * 100 / nullif(l_quantity, 0)) as bigint)"
_DOLLARS = f"cast(floor({_CENTS} / 100) as bigint)"
_REST = f"lpad(cast({_CENTS} % 100 as string), 2, '0')"
_GROUPED = (
    f"case when {_DOLLARS} >= 1000 then cast(cast(floor({_DOLLARS} / 1000) as bigint) as string) || '{{sep}}' "
    f"|| lpad(cast({_DOLLARS} % 1000 as string), 3, '0') else cast({_DOLLARS} as string) end"
)

PRICE_POINTS = {
    "product": "l_partkey",
    "store": "l_suppkey",
    "captured_at": "l_shipdate",
    "price_cents": _CENTS,
    "price_text": (
        "case (l_orderkey + l_linenumber) % 6 "
        f"when 0 then ({_GROUPED.format(sep=' ')}) || ',' || {_REST} || ' €' "
        f"when 1 then '£' || cast({_DOLLARS} as string) "
        f"when 2 then case when l_quantity > 40 then 'n/a' else '$' || ({_GROUPED.format(sep=',')}) || '.' || {_REST} end "
        f"when 3 then 'USD ' || cast({_DOLLARS} as string) || '.' || {_REST} "
        f"else '$' || cast({_DOLLARS} as string) || '.' || {_REST} end"
    ),
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
}

PRODUCT_PAGES = {
    "page_id": "p_partkey",
    "url": (
        "case p_partkey % 5 when 0 then 'https://shop' || p_size || '.example.com/products/' || p_partkey "
        "when 1 then 'https://store.example.org/item/' || p_partkey "
        "when 2 then 'https://www.amazon.example/dp/' || p_partkey "
        "else 'https://plain.example.net/p/' || p_partkey end"
    ),
    "html": (
        "'<!DOCTYPE html><html><head><title>' || p_name || '</title>' || "
        "(case p_partkey % 5 when 0 then '<script src=\"https://cdn.shopify.example/s.js\"></script>' "
        " when 1 then '<link rel=\"stylesheet\" href=\"/wp-content/woocommerce.css\">' else '' end) || "
        "'</head><body>' || "
        "(case p_partkey % 5 "
        " when 0 then '<h1>Shop</h1><h1 class=\"big product-title\">' || p_name || '</h1><span class=\"money\">$' || p_size || '.50</span>"
        "<div class=\"product__description\">Fine <b>' || p_type || '</b></div>"
        "<img class=\"product-featured-img\" src=\"/img/' || p_partkey || '.jpg\"><img class=\"product-featured-img\" data-src=\"data:x\">"
        "<select data-option=\"size\"><option value=\"S\">Small</option><option>Large</option></select>' "
        " when 1 then '<h1 class=\"product_title\">' || p_name || '</h1><div class=\"summary\"><p class=\"price\"><span class=\"amount\">$' || p_size || '.25</span></p></div>"
        "<div class=\"woocommerce-product-details__short-description\">' || p_brand || '</div>"
        "<div class=\"woocommerce-product-gallery__image\"><img src=\"a.jpg\"></div>"
        "<form class=\"variations_form\"><select><option value=\"\">Choose</option><option value=\"red\">Red</option></select></form>' "
        " when 2 then '<span id=\"productTitle\"> ' || p_name || ' </span><span class=\"a-price\"><span class=\"a-price-symbol\">$</span><span class=\"a-price-whole\">' || p_size || '</span><span class=\"a-price-fraction\">99</span></span>"
        "<div id=\"productDescription\">' || repeat(p_type || ' text ', 60) || '</div><div id=\"imgTagWrapperId\"><img src=\"//img.example/' || p_partkey || '.jpg\"></div>"
        "<span class=\"swatchSelect\">Blue</span>' "
        " when 3 then '<h1>' || p_name || '</h1><span class=\"price\"></span><meta itemprop=\"price\" content=\"' || p_size || '.75\"><div class=\"description\">' || p_brand || '</div>"
        "<img src=\"/i/one.jpg\"><img src=\"/i/main-two.jpg\"><img src=\"/i/zoom.jpg\"><img src=\"/i/one.jpg\">' "
        " else '<h1>' || p_name || '</h1><div class=\"card price\">$' || p_size || '</div><ul>"
        "<li class=\"product-card\"><a href=\"/product/' || p_size || '\">p</a></li><li><a href=\"/products/' || p_partkey || '\">q</a></li>"
        "<li><a class=\"product-link\" href=\"/other\">o</a><a class=\"product-link\" href=\"/collections/product-x\">x</a></li></ul>' end) || "
        "'</body></html>'"
    ),
}

KEYWORDS = {
    "keyword": (
        "case p_partkey % 5 when 0 then p_name when 1 then 'how to buy ' || p_name when 2 then ' Best  ' || p_name || ' near-me ' "
        "when 3 then p_brand || ' price vs ' || p_name || ' for the home' else '' end"
    ),
    "url": "'https://shop.example.com/' || p_partkey",
}

# Accounts in debt have an address that no event names.
ACCOUNTS = {
    "email": "case when c_acctbal >= 0 then 'u' || c_custkey || '@example.com' else 'u' || c_custkey || '@example.org' end",
    "premium": "false",
    "customer_id": "case when c_custkey % 3 = 0 then 'cus_' || c_custkey end",
}

ACCOUNT_EVENTS = {
    "event_id": "event_id",
    "ts": "ts",
    "type": (
        "case event_type when 'signup' then 'checkout.session.completed' when 'error' then 'customer.subscription.deleted' "
        "when 'purchase' then 'customer.subscription.updated' when 'view' then 'customer.subscription.updated' else 'invoice.paid' end"
    ),
    "customer": "'cus_' || user_id",
    "email": "case when event_type = 'signup' or user_id % 4 = 0 then 'u' || user_id || '@example.com' end",
    "status": "case event_type when 'purchase' then 'active' when 'view' then 'past_due' end",
}

REQUEST_LOG = {
    "ts": "ts",
    "client": "user_id",
    "route": "case event_type when 'click' then 'analyze' when 'view' then 'scrape' when 'purchase' then 'batch' when 'signup' then 'login' else 'other' end",
}

PAGE_VISITS = {
    "url": "'https://site' || user_id || '.example.com/' || event_type",
    "fetched_at": "ts",
    "event_id": "event_id",
}

# Requests per client, route and day that count as a breach in the given event log.
DAILY_LIMIT = 2

# Fetch candidates: the page URLs and malformed or refused variants of them.
FETCH_URLS = {
    "url": (
        "case page_id % 14 when 1 then replace(url, 'http', 'ftp') when 2 then 'https://user:pw@' || substr(url, 9) "
        "when 3 then 'http://localhost/' || page_id when 4 then 'http://printer' || page_id || '.local/' "
        "when 5 then 'https://example.com:22/' || page_id when 6 then 'https://Example.com.:8080/' || page_id "
        "when 7 then url || repeat('a', 2100) when 8 then '' when 9 then 'javascript:alert(' || page_id || ')' "
        "when 10 then 'https:///' || page_id when 11 then 'http://example.org:99999/' || page_id "
        "when 12 then 'http://metadata.google.internal/' || page_id else url end"
    ),
}

DNS = {
    "host": "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)",
    "address": (
        "case when page_id % 9 = 8 then null else case page_id % 10 when 1 then '10.0.0.' || (page_id % 250) when 2 then '::1' when 3 then '2606:2800:220:1::1' "
        "when 4 then '::ffff:127.0.0.1' when 5 then '100.100.100.200' when 6 then '172.32.0.1' when 7 then '172.31.0.1' "
        "else '93.184.216.' || (page_id % 250) end end"
    ),
}
# Answers for the hosts that redirects start from and lead to: some hosts have a private address
# beside a public one, and some have no answer (a null address is none).
HOP_DNS = {
    "host": "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)",
    "address": (
        "case when length(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) % 7 = 0 then null "
        "when length(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) % 7 = 1 and page_id % 2 = 0 then '10.1.2.3' "
        "else '93.184.216.34' end"
    ),
}
REDIRECTOR_DNS = {"host": "'r.example.com'", "address": "case when page_id % 2 = 0 then '93.184.216.35' else '2606:2800:220:1::1' end"}

# Networks that a caller lists, IPv4 and IPv6, some inside others, some given twice, some unreadable.
NETWORKS = {
    "k": "c_custkey",
    "network": (
        "case c_custkey % 5 when 0 then '11.' || (c_custkey % 256) || '.' || (cast(floor(c_custkey / 256) as bigint) % 256) || '.77/24' "
        "when 1 then '11.' || (c_custkey % 256) || '.0.0/15' when 2 then '2A00:' || (c_custkey % 10000) || '::/' || (32 + c_custkey % 2 * 16) "
        "when 3 then '93.184.216.' || (c_custkey % 250) else 'net' || c_custkey end"
    ),
    "public": "c_custkey % 2 = 0",
}
ADDRESSES = {
    "address": (
        "case when o_orderkey % 50 = 9 then 'host' || o_orderkey when o_orderkey % 2 = 0 "
        "then '11.' || (o_orderkey % 256) || '.' || (cast(floor(o_orderkey / 7) as bigint) % 8) || '.' || (o_orderkey % 200) "
        "else '2a00:' || (o_orderkey % 10000) || ':' || (o_orderkey % 3) || '::' || (o_orderkey % 99) end"
    ),
}

# JSON documents of several forms: an object with results, a list, an object of lists, no rows, none.
JSON_DOCUMENTS = {
    "doc_id": "p_partkey",
    "body": (
        "case p_partkey % 5 when 0 then '{\"total\": 2, \"results\": [{\"url\": \"https://a.example/' || p_partkey || '\", \"price\": \"$' || p_size || '.50\", "
        "\"tags\": [\"x\", \"y\"]}, {\"url\": \"https://b.example/\", \"error\": \"HTTP 404\"}]}' "
        "when 1 then ' [{\"name\": \"' || p_name || '\", \"size\": ' || p_size || ', \"note\": \"a, b\"}, {\"size\": 7, \"name\": null}]' "
        "when 2 then '{\"note\": \"n\", \"shopify\": [{\"id\": ' || p_partkey || ', \"b\": 1.5}, 5, \"s\"], \"amazon\": [{\"b\": true, \"id\": 2}]}' "
        "when 3 then '{\"results\": []}' else '[{broken' end"
    ),
}

THRESHOLDS = {
    "product": "p_partkey",
    "threshold": "case p_size % 4 when 0 then cast(0 as double) when 1 then null else p_retailprice * 2 end",
}

# Account and time of every audited page.
OWNERS = {
    "email": "'user' || (page_id % 7) || '@example.com'",
    "created_at": "timestamp '2024-01-01 00:00:00' + interval '1' minute * page_id",
}


#: Session setting: deal the rows of costly tables to so many partitions, whatever their splits.
INPUT_PARTITIONS = "sitegauge.inputPartitions"
#: Tasks a core for costly tables. Their rows are small in the file and costly to process, so a file
#: of one row group, or of fewer splits than these, would leave most cores idle.
TASKS_A_CORE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to process: dealt out evenly, unless it has splits for all cores."""
    rows = table(spark, sf_dir, name)
    fixed = spark.conf.get(INPUT_PARTITIONS, None)
    if fixed:
        return rows.repartition(int(fixed))
    wanted = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= wanted else rows.repartition(wanted)


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} as {name}" for name, expr in columns.items()])


def pages_aug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``PAGES_AUG`` with the inserted markup worked out once a row, in methods that the JVM compiles."""
    rows = work_table(spark, sf_dir, "pages")
    for name, parts in (("_head", _HEAD), ("_body", _BODY)):
        rows = rows.select("*", F.explode(F.array(F.expr(_joined(parts)))).alias(name))
    rows = rows.withColumn("_inserted", F.expr(_INSERTED.replace(_joined(_HEAD), "_head").replace(_joined(_BODY), "_body")))
    return derive(rows, {**PAGES_AUG, "html": PAGES_AUG["html"].replace(_INSERTED, "_inserted")})


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(work_table(spark, sf_dir, "part"), PRODUCT_PAGES)


def price_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``PRICE_POINTS`` with cents, dollars and the rest worked out once a row, not at every use in the text.

    The text comes from a generator of one row: filters on it would else be moved below and bring all its
    parts into one generated method, too large for the JVM to compile.
    """
    rows = work_table(spark, sf_dir, "lineitem").withColumn("price_cents", F.expr(_CENTS))
    rows = rows.withColumns({"_dollars": F.expr(_DOLLARS.replace(_CENTS, "price_cents")), "_rest": F.expr(_REST.replace(_CENTS, "price_cents"))})
    text = PRICE_POINTS["price_text"].replace(_DOLLARS, "_dollars").replace(_REST, "_rest")
    rows = rows.select("*", F.explode(F.array(F.expr(text))).alias("price_text"))
    return derive(rows, {name: name if name in ("price_cents", "price_text") else expr for name, expr in PRICE_POINTS.items()})


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    second = derive(pages.where("page_id % 6 = 2"), HOPS_SECOND)
    return derive(pages, HOPS_FIRST).unionByName(second)


def hop_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return derive(pages, HOP_DNS).unionByName(derive(pages, REDIRECTOR_DNS)).where("address is not null")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "customer"), ACCOUNTS)
