"""IP addresses and networks as strings of bits, so that a network is a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.html import let
from sitegauge.functions.urls import IPV4_PATTERN

#: Bits of an address; an IPv4 address is the IPv6 address that maps it.
BITS = 128
_MAPPED = "0" * 80 + "1" * 16


def _bits(number: Column, width: int) -> Column:
    return F.lpad(F.conv(number.cast("string"), 10, 2), width, "0")


def ipv4_bits(address: Column) -> Column:
    """128 bits of a dotted quad, null if it is none."""
    bits = F.array_join(F.transform(F.split(address, r"\."), lambda p: _bits(p, 8)), "")
    return F.when(address.rlike(IPV4_PATTERN), F.concat(F.lit(_MAPPED), bits))


def ipv6_bits(address: Column) -> Column:
    """128 bits of an IPv6 address in any of its spellings, null if it is none."""
    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda g: g != "")

    def spelt(text: Column) -> Column:
        # A dotted quad at the end stands for two groups.
        quad = F.regexp_extract(text, r"(?:^|:)([0-9]+(?:\.[0-9]+){3})$", 1)
        bits = F.substring(ipv4_bits(quad), 97, 32)
        two = F.concat_ws(":", F.lower(F.conv(F.substring(bits, 1, 16), 2, 16)), F.lower(F.conv(F.substring(bits, 17, 16), 2, 16)))
        return F.when(quad == "", text).when(bits.isNotNull(), F.concat(text.substr(F.lit(1), F.length(text) - F.length(quad)), two))

    def read(text: Column) -> Column:
        sides = F.split(text, "::", -1)
        left, right = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        n = F.size(left) + F.size(right)
        short = F.size(sides) == 2
        zeros = F.when(short, F.array_repeat(F.lit("0"), F.lit(8) - n)).otherwise(F.array().cast("array<string>"))
        fits = F.when(short, n < 8).otherwise((F.size(sides) == 1) & (n == 8))
        # No group is empty but at the double colon.
        plain = ~text.rlike(":::|^:(?!:)|[^:]:$") & text.rlike("^[0-9a-f:]+$")
        whole = F.concat(left, zeros, right)
        good = F.forall(whole, lambda g: F.length(g) <= 4)
        bits = F.array_join(F.transform(whole, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
        return F.when(fits & plain & good, bits)

    return let(spelt(F.lower(address)), read)


def address_bits(address: Column) -> Column:
    """128 bits of an IPv4 or IPv6 address, null if it is neither."""
    return F.when(address.contains(":"), ipv6_bits(address)).otherwise(ipv4_bits(address))


def network_prefix(network: Column) -> Column:
    """Leading bits of ``address/length``, of an address alone all bits; null if it is no network.

    Bits of the address beyond the length are ignored.
    """
    address, given = F.substring_index(network, "/", 1), F.try_element_at(F.split(network, "/"), F.lit(2)).try_cast("int")
    v4 = ~address.contains(":")
    most = F.when(v4, 32).otherwise(BITS)
    length = F.when(network.contains("/"), given).otherwise(most)
    return F.when(length.between(0, most), F.substring(address_bits(address), F.lit(1), length + F.when(v4, BITS - 32).otherwise(0)))
