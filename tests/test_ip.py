"""Address functions against the standard library."""

import ipaddress
import random

import pytest

from netlens.functions import ip as ipf

BAD = [
    "", "abc", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4 ", "-1.2.3.4", ":", ":::", "1::2::3",
    "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2:3:4:5:6:7:8", "12345::", "g::1", "::1.2.3", "::1.2.3.256",
    "1:2:3:4:5:6:7:1.2.3.4", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:",
]
FIXED = [
    "0.0.0.0", "255.255.255.255", "8.8.8.8", "10.0.0.1", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.1",
    "192.168.1.1", "192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.0.170", "192.0.2.1", "198.17.1.1", "198.18.0.1",
    "198.19.255.255", "198.51.100.1", "203.0.113.1", "100.63.0.1", "100.64.0.1", "100.127.1.1", "100.128.0.1",
    "127.0.0.1", "169.254.1.1", "223.255.255.255", "224.0.0.251", "239.1.1.1", "240.0.0.1", "::", "::1", "::2",
    "fe80::1", "febf::1", "fec0::1", "fc00::1", "fdff::1", "fe00::1", "ff02::1", "2001:4860:4860::8888", "2001::1",
    "2001:1::1", "2001:1::2", "2001:1::3", "2001:2::1", "2001:3::1", "2001:4:112::1", "2001:20::1", "2001:2f::1",
    "2001:30::1", "2001:1ff::1", "2001:200::1", "2001:db8::1", "2002::1", "64:ff9b:1::1", "64:ff9b::1", "100::1",
    "100::1:2:3:4", "100:0:0:5:1:2:3:4", "100:0:0:0:1:0:0:0", "3fff::1", "3fff:fff::1", "3fff:1000::1",
    "::ffff:10.0.0.1", "::ffff:8.8.8.8", "1:0:0:2:0:0:3:4", "1:0:0:0:2:0:0:0", "0:0:1::", "1:2:3:4:5:6:7::",
    "::2:3:4:5:6:7:8", "2001:DB8:0:0:1:0:0:1", "1:0:3:4:5:6:7:8", "a:b:c:d:e:f:1.2.3.4", "0001:0002::0003",
]


def _random_addresses():
    rng = random.Random(7)
    out = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(400)]
    for _ in range(600):
        groups = [rng.choice([0, 0, 0, rng.getrandbits(4), rng.getrandbits(16)]) for _ in range(8)]
        address = ipaddress.IPv6Address(b"".join(g.to_bytes(2, "big") for g in groups))
        out.append(rng.choice([str(address), address.exploded, address.exploded.upper()]))
    return out


def _parsed(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def _canonical(text):
    a = _parsed(text)
    if a is None:
        return None
    if a.version == 6:
        if a.ipv4_mapped:
            return f"::ffff:{a.ipv4_mapped}"
        if a.packed[:12] == b"\0" * 12 and a.packed[12:14] != b"\0\0":
            return f"::{ipaddress.IPv4Address(a.packed[12:])}"
    return str(a)


@pytest.fixture(scope="module")
def addresses(spark):
    texts = BAD + FIXED + _random_addresses()
    return spark.createDataFrame([(t,) for t in texts], "ip string")


def test_canonical_text(addresses):
    for row in addresses.select("ip", ipf.ip_text("ip").alias("text")).collect():
        assert row.text == _canonical(row.ip), row.ip


def test_key_orders_like_the_address(addresses):
    for row in addresses.select("ip", ipf.ip_key("ip").alias("key")).collect():
        want = None if _parsed(row.ip) is None else ipf.key_of(row.ip)
        assert (None if row.key is None else bytes(row.key)) == want, row.ip


def test_global_and_reserved(addresses):
    rows = addresses.withColumn("text", ipf.ip_text("ip")).select(
        "ip", "text", ipf.is_global_ip("text").alias("g"), ipf.is_reserved_ip("ip").alias("r")
    )
    for row in rows.collect():
        a = _parsed(row.ip)
        assert row.g == (a is not None and a.is_global and not a.is_multicast), row.ip
        assert row.r == (a is None or a.is_private), row.ip


def test_public_in_the_wide_sense(addresses):
    nets = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7", "fe80::/10")]
    rows = addresses.select(ipf.ip_text("ip").alias("ip")).select(
        "ip", ipf.is_public_ip_sql("ip").alias("p"), ipf.is_wan_candidate_ip("ip").alias("w"),
        ipf.is_bcast_or_mcast("ip").alias("m"),
    )
    for row in rows.collect():
        a = _parsed(row.ip or "")
        public = a is not None and not any(a in n for n in nets if n.version == a.version)
        assert row.p == public, row.ip
        if a is not None:
            assert row.w == (public and not a.is_loopback and row.ip != "255.255.255.255" or (public and a.version == 6 and a.ipv4_mapped is not None and a.is_loopback)), row.ip
            assert row.m == (row.ip == "255.255.255.255" or (a.is_multicast and not row.ip.startswith("::ffff:"))), row.ip


@pytest.mark.parametrize("prefix", [8, 16, 22, 24])
def test_cidr(addresses, prefix):
    for row in addresses.select("ip", ipf.cidr_of("ip", prefix).alias("net")).collect():
        a = _parsed(row.ip)
        if a is None:
            assert row.net is None
            continue
        net = ipaddress.ip_network(f"{a}/{prefix}", strict=False)
        assert row.net == f"{_canonical(str(net.network_address))}/{prefix}", row.ip


@pytest.mark.parametrize("cidr", ["10.0.0.0/8", "45.1.2.0/23", "fd00::/8", "2001:db8::/33"])
def test_in_cidr(addresses, cidr):
    net = ipaddress.ip_network(cidr)
    for row in addresses.select("ip", ipf.in_cidr("ip", cidr).alias("hit")).collect():
        a = _parsed(row.ip)
        assert row.hit == (a is not None and a.version == net.version and a in net), row.ip
