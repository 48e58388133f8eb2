"""URL expressions: scheme, host, RFC 3986 resolution, admission."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.constants import (
    ALLOWED_PORTS,
    BLOCKED_HOST_SUFFIXES,
    BLOCKED_HOSTNAMES,
    MAX_URL_LENGTH,
    METADATA_ADDRESSES,
)
from sitegauge.functions.html import let

SCHEME_PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*):"
AUTHORITY_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
# Host inside an optional bracket pair, after optional credentials.
HOST_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?\[?((?<=\[)[^\]/?#]*|[^\[\]:/?#]*)"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME_PATTERN, 1))


def is_absolute(url: Column) -> Column:
    return F.coalesce(url.rlike(SCHEME_PATTERN), F.lit(False))


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY_PATTERN, 1)


def hostname(url: Column) -> Column:
    """Lower-cased host without credentials, port and brackets; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATTERN, 1))


def host_of(value: Column, base: Column | None = None) -> Column:
    """Host of ``value``, which is read relative to ``base`` if given; '' if there is none."""
    blank = F.coalesce(value == "", F.lit(True))
    if base is None:
        return F.when(blank, "").otherwise(hostname(value))
    own = is_absolute(value) | value.startswith("//") | base.isNull()
    return F.when(blank, "").otherwise(hostname(F.when(own, value).otherwise(base)))


def _normalise_path(path: Column) -> Column:
    """Drop empty inner segments and apply ``.`` and ``..``."""

    def fold(segments: Column) -> Column:
        n = F.size(segments)
        inner = F.filter(F.slice(segments, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda s: s != "")
        kept = F.concat(F.array(F.get(segments, F.lit(0))), inner, F.when(n > 1, F.slice(segments, n, F.lit(1))).otherwise(F.array().cast("array<string>")))
        walked = F.aggregate(
            kept,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        ends_in_dot = F.element_at(segments, -1).isin(".", "..")
        joined = F.array_join(F.concat(walked, F.when(ends_in_dot, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")
        return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))

    return F.when(
        path.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), let(F.split(path, "/"), fold)
    ).otherwise(path)


def resolve_url(base: Column, ref: Column) -> Column:
    """RFC 3986 reference resolution of ``ref`` against ``base``; ``ref`` itself without base."""
    scheme = F.regexp_extract(base, SCHEME_PATTERN, 0)
    origin = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", 0)
    base_path = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_rest = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    rooted = F.when(ref_path.startswith("/"), ref_path).otherwise(
        F.concat(F.when(base_path == "", "/").otherwise(F.regexp_replace(base_path, r"[^/]*$", "")), ref_path)
    )
    return (
        F.when(F.coalesce(base == "", F.lit(True)), ref)
        .when(F.coalesce(ref == "", F.lit(True)), base)
        .when(is_absolute(ref), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), ref))
        .when(ref_path == "", F.concat(origin, base_path, F.when(ref.startswith("?"), ref_rest).otherwise(F.concat(base_query, ref_rest))))
        .otherwise(F.concat(origin, _normalise_path(rooted), ref_rest))
    )


def is_external_link(href: Column, page_url: Column) -> Column:
    """Host inequality; fragments, javascript:, mailto: and tel: are never external."""
    ignored = (
        F.coalesce(href == "", F.lit(True))
        | href.startswith("#") | href.startswith("javascript:") | href.startswith("mailto:") | href.startswith("tel:")
    )
    page_host = hostname(page_url)
    return F.when(ignored | (page_host == ""), False).otherwise(host_of(href, page_url) != page_host)


# --- addresses ---------------------------------------------------------------------------

# --- fixed values: IPv4 networks that are private, loopback, link-local, multicast or reserved ---
NON_PUBLIC_NETWORKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
# Public islands inside the networks above.
PUBLIC_EXCEPTIONS = (("192.0.0.9", 32), ("192.0.0.10", 32))
IPV4_PATTERN = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"


def ipv4_number(address: Column) -> Column:
    """Dotted quad as an integer, null if it is none."""
    parts = F.transform(F.split(address, r"\."), lambda p: p.cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)
    return F.when(address.rlike(IPV4_PATTERN), number)


def network_bounds(network: tuple[str, int]) -> tuple[int, int]:
    a, b, c, d = (int(p) for p in network[0].split("."))
    low = ((a * 256 + b) * 256 + c) * 256 + d
    return low, low + 2 ** (32 - network[1]) - 1


def _public_ipv4(number: Column) -> Column:
    def inside(value: Column, networks) -> Column:
        bounds = F.array(*[
            F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in map(network_bounds, networks)
        ])
        return F.exists(bounds, lambda n: value.between(n["low"], n["high"]))

    return let(
        number, lambda v: F.when(v.isNotNull(), ~inside(v, NON_PUBLIC_NETWORKS) | inside(v, PUBLIC_EXCEPTIONS))
    )


def public_address(address: Column) -> Column:
    """True for a public IPv4 or IPv6 address. Anything unparsable is not public."""

    def judge(a: Column) -> Column:
        is_v6 = a["text"].rlike(r"^[0-9a-f:]*:[0-9a-f:]*[0-9a-f.]*$") & (a["text"].contains("::") | (F.size(F.split(a["text"], ":")) == 8))
        # Global unicast is 2000::/3; documentation, benchmarking and special blocks inside it are not public.
        special = (
            ((a["first"] == 0x2001) & (a["second"] < 0x0200))
            | ((a["first"] == 0x2001) & (a["second"] == 0x0DB8))
            | (a["first"] == 0x2002)
            | ((a["first"] == 0x3FFF) & (a["second"] < 0x1000))
        )
        public_v6 = is_v6 & a["first"].between(0x2000, 0x3FFF) & ~special
        v4 = F.coalesce(F.nullif(a["mapped"], F.lit("")), a["text"])
        public = F.coalesce(_public_ipv4(ipv4_number(v4)), public_v6, F.lit(False))
        return public & ~F.coalesce(a["text"].isin(*METADATA_ADDRESSES), F.lit(False))

    def group(text: Column, pattern: str) -> Column:
        return F.conv(F.concat(F.lit("0"), F.regexp_extract(text, pattern, 1)), 16, 10).cast("int")

    text = F.lower(address)
    parts = F.struct(
        text.alias("text"),
        F.regexp_extract(text, r"^(?:0{0,4}:){2,5}(?:0{0,4}:)?ffff:([0-9.]+)$", 1).alias("mapped"),
        group(text, r"^([0-9a-f]{0,4}):").alias("first"),
        group(text, r"^[0-9a-f]{1,4}:([0-9a-f]{0,4})").alias("second"),
    )
    return let(parts, judge)


# --- admission ---------------------------------------------------------------------------


def admission(url: Column, allowed_ports: tuple[int, ...] = ALLOWED_PORTS) -> Column:
    """Struct ``(ok, reason, host, port)``; ``reason`` is the first check that fails."""

    def judge(u: Column) -> Column:
        scheme, authority, host, port = u["scheme"], u["authority"], u["host"], u["port"]
        blocked = host.isin(*BLOCKED_HOSTNAMES)
        for suffix in BLOCKED_HOST_SUFFIXES:
            blocked = blocked | host.endswith(suffix)
        credentials = F.regexp_extract(authority, r"^(.*)@", 1)
        return (
            F.when(F.coalesce(u["url"] == "", F.lit(True)), "URL is required")
            .when(F.length(u["url"]) > MAX_URL_LENGTH, "URL exceeds maximum length")
            .when(authority.contains("[") != authority.contains("]"), "URL cannot be parsed")
            .when(~scheme.isin("http", "https"), F.concat(F.lit("Only http/https URLs are allowed, got: '"), scheme, F.lit("'")))
            .when(~credentials.isin("", ":"), "Credentials in the URL are not allowed")
            .when(host == "", "URL must include a valid hostname")
            .when(blocked, "URL hostname is blocked for security reasons")
            .when(port.isNull() | (port > 65535), "URL has an invalid port")
            .when(~port.isin(*allowed_ports), F.concat(F.lit("Port "), port.cast("string"), F.lit(" is not allowed")))
        )

    def verdict(u: Column) -> Column:
        return let(
            judge(u),
            lambda reason: F.struct(
                reason.isNull().alias("ok"), reason.alias("reason"),
                F.when(reason.isNull(), u["host"]).alias("host"), F.when(reason.isNull(), u["port"]).alias("port"),
            ),
        )

    authority, scheme = authority_of(url), scheme_of(url)
    port_text = F.regexp_extract(authority, r":([^:\]@]*)$", 1)
    default = F.when(scheme == "https", 443).otherwise(80)
    # An empty or zero port means the default one; null is an unreadable port.
    number = F.when(port_text.isin("", "0"), default).when(port_text.rlike(r"^[0-9]{1,9}$"), port_text.cast("int"))
    parts = F.struct(
        url.alias("url"), authority.alias("authority"), scheme.alias("scheme"),
        F.regexp_replace(hostname(url), r"\.+$", "").alias("host"), number.alias("port"),
    )
    return let(parts, verdict)
