"""Addresses and networks against the standard library, and a large table of networks."""

import ipaddress
import random

from pyspark.sql import functions as F

from sitegauge.functions import networks as N
from sitegauge.operators import url_ops as U

ODD = (
    "1.2.3.4", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "01.2.3.4", "", "::", "::1", "1::", "2001:DB8::8a2e:370:7334", "::ffff:10.1.2.3", "64:ff9b::192.0.2.33",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3::5", ":::", "1:2", "12345::", "g::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "::ffff:1.2.3.400", "1.2.3.4::", "::1.2.3.4.5",
)


def bits(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    number = int(ip) + (0xFFFF << 32 if ip.version == 4 else 0)
    return f"{number:0128b}"


def test_address_bits(spark):
    draw = random.Random(3)
    texts = list(ODD)
    for _ in range(300):
        ip = ipaddress.IPv6Address(draw.getrandbits(128) & draw.getrandbits(128) & draw.getrandbits(128))
        texts += [ip.compressed, ip.exploded, ip.compressed.upper(), str(ipaddress.IPv4Address(draw.getrandbits(32)))]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select("a", N.address_bits(F.col("a")).alias("bits")).collect()
    assert {r["a"]: r["bits"] for r in rows} == {t: bits(t) for t in texts}


def test_network_prefixes(spark):
    want = {"10.0.0.0/8": 104, "10.1.2.3/8": 104, "10.1.2.3": 128, "::/0": 0, "0.0.0.0/0": 96, "2001:db8::/33": 33, "::1": 128, "1.2.3.4/33": None, "::/129": None, "x/8": None, "1.2.3.4/": None, "1.2.3.4/-1": None, "": None}
    rows = spark.createDataFrame([(n,) for n in want], "n string").select("n", F.length(N.network_prefix(F.col("n"))).alias("k")).collect()
    assert {r["n"]: r["k"] for r in rows} == want


def test_many_networks_without_a_loop(spark):
    """100,000 networks of both kinds; the most specific one wins, and the plan has equi-joins alone."""
    draw = random.Random(5)
    given, chosen = set(), []
    while len(given) < 100_000:
        if draw.random() < 0.5:
            given.add(str(ipaddress.ip_network((draw.getrandbits(32), draw.randint(8, 32)), strict=False)))
        else:
            given.add(str(ipaddress.ip_network((0x2A << 120 | draw.getrandbits(24) << 96, draw.randint(24, 64)), strict=False)))
    networks = spark.createDataFrame([(n, i) for i, n in enumerate(sorted(given))], "network string, tag long")
    for n in draw.sample(sorted(given), 150):
        net = ipaddress.ip_network(n)
        chosen.append(str(net[draw.randrange(min(net.num_addresses, 1 << 40))]))
    chosen += ["8.8.8.8", "::1", "no address", None]
    addresses = spark.createDataFrame([(a,) for a in chosen * 3], "address string")
    found = U.networks_of(addresses, networks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got = {r["address"]: r["network"] for r in found.collect()}
    by_length = {}
    for n in given:
        net = ipaddress.ip_network(n)
        by_length.setdefault((net.version, net.prefixlen), {})[int(net.network_address)] = n

    def best(text):
        try:
            ip = ipaddress.ip_address(text or "")
        except ValueError:
            return None
        for length in range(ip.max_prefixlen, -1, -1):
            hit = by_length.get((ip.version, length), {}).get(int(ip) >> (ip.max_prefixlen - length) << (ip.max_prefixlen - length))
            if hit:
                return hit
        return None

    assert got == {a: best(a) for a in chosen}


def test_listed_networks_decide_admission(spark):
    dns = spark.createDataFrame([("a.com", "93.184.216.34"), ("b.com", "10.1.2.3"), ("c.com", "10.9.9.9"), ("d.com", None)], "host string, address string")
    listed = spark.createDataFrame([("93.184.0.0/16", False), ("10.1.0.0/16", True)], "network string, public boolean")
    urls = spark.createDataFrame([(f"http://{h}.com/",) for h in "abcd"], "url string")
    assert {r["url"][7]: r["ok"] for r in U.address_admission(urls, dns, networks=listed).collect()} == {"a": False, "b": True, "c": False, "d": False}
    assert {r["url"][7]: r["ok"] for r in U.address_admission(urls, dns).collect()} == {"a": True, "b": False, "c": False, "d": False}
    none = U.networks_of(dns.where("address is not null"), listed.where("false")).collect()
    assert len(none) == 3 and all(r["network"] is None for r in none)
