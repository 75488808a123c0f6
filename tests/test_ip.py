import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from wirelight.functions.ip import (
    cidr_bounds, cidr_prefixes, in_prefixes, ip16, ip_canonical, ip_family, ip_key, key_text, with_cidr_keys, with_ip_keys,
)
from wirelight.operators.networks import (
    NetworkMatch, cidr_filter, cidr_join, in_networks, network_prefixes,
)
from wirelight.operators.special import SPECIAL_IPV4, SPECIAL_IPV6, is_special_ip

BAD = ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.-4", " 1.2.3.4", "1.2.3.4 ",
       "+1.2.3.4", "a.b.c.d", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9",
       "12345::", "g::1", "::1.2.3", "1:2:3:4:5:6:7::8:9", "fe80::1%eth0", "1:2:3:4:5:6:7:8::",
       "::ffff:1.2.3.400", "1:2:3:4:5:6:7:1.2.3.4", ":1:2:3:4:5:6:7", "1.2.3.4:80"]


def _random_ips(n, seed=7):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(str(ipaddress.IPv4Address(rnd.getrandbits(32))))
        groups = [rnd.choice([0, 0, rnd.getrandbits(16), rnd.getrandbits(4)]) for _ in range(8)]
        value = 0
        for g in groups:
            value = value << 16 | g
        ip = ipaddress.IPv6Address(value)
        out.append(rnd.choice([str(ip), ip.exploded, str(ip).upper()]))
    return out + ["::", "::1", "1::", "::ffff:10.1.2.3", "::FFFF:0a01:0203", "64:ff9b::1.2.3.4",
                  "0.0.0.0", "255.255.255.255", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]


def _key(text):
    ip = ipaddress.ip_address(text)
    if ip.version == 6 and ip.ipv4_mapped is not None:
        ip = ip.ipv4_mapped
    return f"{ip.version}{int(ip):0{ip.max_prefixlen // 4}X}", str(ip)


def test_keys_and_text(spark):
    ips = _random_ips(200)
    df = spark.createDataFrame([(x,) for x in ips + BAD + [None]], "ip string")
    df = with_ip_keys(df, {"k": "ip"})
    rows = df.select("ip", "k", key_text("k").alias("t"), ip_canonical("ip", "k").alias("c"),
                     ip_family("k").alias("fam"), ip16("k").alias("h")).collect()
    for r in rows:
        if r.ip is None or r.ip in BAD:
            assert r.k is None and r.c is None, r
            continue
        key, text = _key(r.ip)
        assert (r.k, r.t, r.c) == (key, text, text), r
        assert r.fam == int(key[0]) and len(r.h) == 32


def test_cidr_prefixes_agree_with_driver_side(spark):
    rnd = random.Random(3)
    cidrs = [f"{ip}/{rnd.randint(0, 128 if ':' in ip else 32)}" for ip in _random_ips(60)
             if "ffff" not in ip.lower()]
    df = spark.createDataFrame([(c,) for c in cidrs], "c string")
    df = with_cidr_keys(df, "c", "k")
    lo, hi = cidr_bounds("c", "k")
    for r in df.select("c", cidr_prefixes("c", "k").alias("p"), lo.alias("lo"), hi.alias("hi")).collect():
        assert r.p == network_prefixes(r.c), r
        net = ipaddress.ip_network(r.c, strict=False)
        assert r.lo == _full(net.network_address) and r.hi == _full(net[-1])


def _full(ip):
    return f"{ip.version}{int(ip):0{ip.max_prefixlen // 4}X}"


@pytest.mark.parametrize("bad", ["10.0.0.0/33", "10.0.0.0", "x/8", "10.0.0.0/a", "1.2.3/8", "::/129"])
def test_bad_cidr(spark, bad):
    with pytest.raises(ValueError):
        network_prefixes(bad)
    if "/" in bad:
        df = spark.createDataFrame([(bad,)], "c string")
        df = with_cidr_keys(df, "c", "k")
        assert df.select(cidr_prefixes("c", "k").alias("p")).first().p is None


def test_special(spark):
    ips = [x for x in _random_ips(200, seed=11) if "." not in x or ":" not in x]
    ips += ["172.16.0.1", "172.32.0.1", "198.19.255.255", "198.20.0.0", "fe80::1", "fec0::1",
            "fdff::", "2001:1f:ffff::", "2001:10::", "2001:20::", "ff02::1", "::1", "::2", "223.255.254.1"]
    nets = [ipaddress.ip_network(n) for n in SPECIAL_IPV4 + SPECIAL_IPV6]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    for r in df.select("ip", is_special_ip(ip_key("ip")).alias("s")).collect():
        ip = ipaddress.ip_address(r.ip)
        if ip.version == 6 and ip.ipv4_mapped:
            ip = ip.ipv4_mapped
        assert r.s == any(ip in n for n in nets if n.version == ip.version), r


def _flags(spark, match, pairs):
    df = spark.createDataFrame(pairs, "s string, d string")
    df = with_ip_keys(df, {"sk": "s", "dk": "d"})
    matched, excluded = match.pair_match("sk", "dk")
    return [(r.m, r.x) for r in df.select(matched.alias("m"), excluded.alias("x")).collect()]


def test_pair_match(spark):
    assert _flags(spark, NetworkMatch(), [("1.1.1.1", "2.2.2.2"), ("::1", "2.2.2.2"), (None, "2.2.2.2"),
                                          ("1.1.1.1", None)]) == [
        (True, False), (True, False), (False, False), (False, False)]
    m = NetworkMatch(("10.0.0.0/8",), ("10.1.0.0/16", "10.2.0.1", "10.3.0.1/32"), ("0.0.0.0/0",), ("8.8.8.8",))
    got = _flags(spark, m, [("10.0.0.1", "1.1.1.1"), ("10.1.0.1", "1.1.1.1"), ("10.2.0.1", "1.1.1.1"),
                            ("10.3.0.1", "1.1.1.1"), ("11.0.0.1", "1.1.1.1"), ("10.0.0.1", "8.8.8.8"),
                            ("10.0.0.1", "::1")])
    assert got == [(True, False), (True, True), (True, True), (True, True), (False, False), (True, True),
                   (False, False)]
    v6 = NetworkMatch(("::/0",))
    assert _flags(spark, v6, [("1.1.1.1", "1.1.1.1"), ("::2", "1.1.1.1"), ("::ffff:1.1.1.1", "::1")]) == [
        (False, False), (True, False), (False, False)]


def test_bad_network_lists():
    for kwargs in ({"src_includes": ("x",)}, {"src_excludes": ("x",)}, {"dst_includes": ("1.1.1.1",)},
                   {"dst_excludes": ("1.1.1.1/99",)}):
        with pytest.raises(ValueError):
            NetworkMatch(**kwargs)


def test_cidr_join_matches_brute_force(spark, monkeypatch):
    from wirelight.operators import lookup, networks

    rnd = random.Random(5)
    ips = [x for x in _random_ips(100, seed=2)] + ["10.0.0.1"] * 300 + ["not an ip", None]
    cidrs = [(f"10.{rnd.randint(0, 3)}.0.0/{rnd.randint(6, 30)}", f"n{i}") for i in range(40)]
    cidrs += [("0.0.0.0/0", "all4"), ("::/0", "all6"), ("fe80::/10", "ll"), ("bad/8", "bad")]
    ev = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "id int, ip string")
    nets = spark.createDataFrame(cidrs, "cidr string, tag string")

    def want(text):
        try:
            key, canonical = _key(text)
        except ValueError:
            return []
        ip = ipaddress.ip_address(canonical)
        return sorted(t for c, t in cidrs if c != "bad/8" and ip in ipaddress.ip_network(c, strict=False))

    expected = {i: want(x) if x else [] for i, x in enumerate(ips)}
    got = {r.id: r.tags for r in cidr_join(ev, "ip", nets, "cidr", "tag", "tags").collect()}
    assert got == expected
    monkeypatch.setattr("wirelight.operators.lookup.BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookup, "HOT_KEYS", 2)
    got = {r.id: r.tags for r in cidr_join(ev, "ip", nets, "cidr", "tag", "tags").collect()}
    assert got == expected
    some = nets.where("tag not in ('all4', 'all6')")
    keep = {i for i, tags in expected.items() if set(tags) - {"all4", "all6"}}
    assert {r.id for r in cidr_filter(ev, "ip", some, "cidr").collect()} == keep
    monkeypatch.setattr(networks, "LITERAL_LIMIT", 0)
    assert {r.id for r in cidr_filter(ev, "ip", some, "cidr").collect()} == keep


def test_no_networks(spark):
    df = spark.createDataFrame([("1.1.1.1",)], "ip string")
    assert df.select(in_networks(ip_key("ip"), []).alias("x")).first().x is False
    assert df.select(in_prefixes(ip_key("ip"), ["4"]).alias("x")).first().x is True
