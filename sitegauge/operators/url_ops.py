"""URL operators over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.constants import ALLOWED_PORTS
from sitegauge.functions import networks as N
from sitegauge.functions import urls as U
from sitegauge.operators.elements import explode_rows, parse_pages
from sitegauge.operators.joins import join_reduced
from sitegauge.operators.page_facts import links_column, links_detail


def url_admission(urls: DataFrame, allowed_ports: tuple[int, ...] = ALLOWED_PORTS) -> DataFrame:
    """``(url, ok, reason, host, port)`` without looking at addresses."""
    return urls.select("url", U.admission(F.col("url"), allowed_ports).alias("a")).select("url", "a.*")


def networks_of(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """Every different ``address`` with the most specific of the ``networks`` that holds it, null if none does.

    ``networks`` has ``network`` (``address/length``, IPv4 or IPv6) and columns of its own, which come
    along; of equal networks the first by name counts, unreadable ones hold nothing. Networks are
    prefixes of bits, so range and address meet by equality: an address looks up its first bits at
    each length that occurs (at most 129), and the longest hit wins. No loop over networks, no
    bound on their number; an address is looked up once however often it occurs.
    """
    other = [c for c in networks.columns if c != "network"]
    known = networks.withColumn("prefix", N.network_prefix(F.col("network"))).where(F.col("prefix").isNotNull())
    known = known.groupBy("prefix").agg(F.min(F.struct("network", *other)).alias("found"))
    lengths = sorted(r[0] for r in known.select(F.length("prefix")).distinct().collect())
    different = addresses.select("address").distinct().withColumn("bits", N.address_bits(F.col("address")))
    tried = different.select("address", F.explode(F.array(*[F.substring("bits", 1, n) for n in lengths]) if lengths else F.array(F.lit(None).cast("string"))).alias("prefix"))
    hits = tried.join(known, "prefix").groupBy("address").agg(F.max(F.struct(F.length("prefix").alias("length"), "found")).alias("best"))
    return different.select("address").join(hits, "address", "left").select("address", *[F.col(f"best.found.{c}").alias(c) for c in ("network", *other)])


def judged(rows: DataFrame, column: str, dns: DataFrame, allowed_ports: tuple[int, ...] = ALLOWED_PORTS, networks: DataFrame | None = None) -> DataFrame:
    """The rows with ``host``, ``port`` and ``reason`` (null: admitted) of the URL in ``column``.

    One non-public address refuses a host, and so does none (a null address is none). Answers are judged and reduced to one
    row per host before the join; refused URLs have no host and are dealt out. ``networks`` (network,
    public) decides for the addresses of recorded answers that it holds, the rules for all others.
    """
    answers = dns.where(F.col("address").isNotNull())
    public = U.public_address(F.col("address"))
    if networks is not None:
        decided = networks_of(answers, networks.select("network", F.col("public").alias("listed"))).select("address", "listed")
        answers = join_reduced(answers, decided, "address", "left", F.xxhash64("host"))
        public = F.coalesce("listed", public)
    verdicts = (
        answers.groupBy(F.lower("host").alias("dns_host"))
        .agg(F.min(F.when(~public, F.col("address"))).alias("bad_address"))
    )
    checked = rows.withColumn("__a", U.admission(F.col(column), allowed_ports)).select(
        *rows.columns, F.col("__a.ok").alias("ok"), F.col("__a.reason").alias("reason"), F.col("__a.host").alias("host"), F.col("__a.port").alias("port"))
    literal = F.col("host").rlike(U.IPV4_PATTERN) | F.col("host").contains(":")
    verdicts = verdicts.select(F.col("dns_host").alias("host"), "dns_host", "bad_address")
    joined = join_reduced(checked, verdicts, "host", "left", F.xxhash64(column))
    bad = F.when(literal, F.when(~U.public_address(F.col("host")), F.col("host"))).otherwise(F.col("bad_address"))
    reason = (
        F.when(~F.col("ok"), F.col("reason"))
        .when(~literal & F.col("dns_host").isNull(), "Could not resolve URL hostname")
        .when(bad.isNotNull(), F.concat(F.lit("Hostname resolves to a non-public address ("), bad, F.lit(")")))
    )
    return joined.select(*rows.columns, "host", "port", reason.alias("reason"))


def address_admission(
    urls: DataFrame, dns: DataFrame, allowed_ports: tuple[int, ...] = ALLOWED_PORTS, networks: DataFrame | None = None
) -> DataFrame:
    """Admission of ``(url)`` with the recorded addresses, and the caller's networks where given."""
    ok = F.col("reason").isNull()
    return judged(urls.select("url"), "url", dns, allowed_ports, networks).select(
        "url", ok.alias("ok"), "reason", F.when(ok, F.col("host")).alias("host"), F.when(ok, F.col("port")).alias("port")
    )


def link_hosts(pages: DataFrame) -> DataFrame:
    """Host of every link, relative ones resolved against the page."""
    return links_detail(pages).select("page_id", "pos", "href", F.col("target_host").alias("host"))


def link_absolute(pages: DataFrame) -> DataFrame:
    return links_detail(pages).select("page_id", "pos", "href", U.is_absolute(F.col("href")).alias("is_absolute"))


def _page_links(pages: DataFrame) -> DataFrame:
    return explode_rows(parse_pages(pages), links_column(), "page_id", "url")


def link_external(pages: DataFrame) -> DataFrame:
    return _page_links(pages).select(
        "page_id", "pos", "href", U.is_external_link(F.col("href"), F.col("url")).alias("is_external")
    )


def link_resolved(pages: DataFrame) -> DataFrame:
    return _page_links(pages).select("page_id", "pos", "href", U.resolve_url(F.col("url"), F.col("href")).alias("resolved"))
