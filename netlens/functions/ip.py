"""Address functions as native column expressions (IPv4 and IPv6, no Python UDF).

Addresses travel as canonical host text. Range tests use ``ip_key``: 16 bytes,
IPv4 mapped into ``::ffff:0:0/96``, so that plain binary comparison orders both
families.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4_PATTERN = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
# Groups with at most one "::", which must stand for one group at least. That a
# text without "::" has eight groups shows once it is expanded.
_V6_SHAPE = (
    r"^(?=[^:]*(?::[^:]*){2,7}$|::[^:]+(?::[^:]+){6}$|(?:[^:]+:){6}[^:]+::$)"
    rf"(?:{_GROUPS})?(?:::(?:{_GROUPS})?)?$"
)
_V4_TAIL = r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"
_V4_KEY_PREFIX = "0" * 20 + "FFFF"


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once. Column expressions are trees:
    naming a long expression twice would copy it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_v4(ip: ColumnLike) -> Column:
    return F.coalesce(as_col(ip).rlike(V4_PATTERN), F.lit(False))


def v4_long(ip: ColumnLike) -> Column:
    """IPv4 text as a number, NULL for anything else."""
    ip = as_col(ip)
    octets = F.split(ip, r"\.")
    value = reduce(
        lambda acc, i: acc * 256 + F.get(octets, F.lit(i)).try_cast("bigint"),
        range(1, 4),
        F.get(octets, F.lit(0)).try_cast("bigint"),
    )
    return F.when(is_v4(ip), value)


def v4_text(number: ColumnLike) -> Column:
    n = as_col(number)
    return F.concat_ws(
        ".", *[(F.shiftright(n, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)]
    )


def _plain_v6_hex(text: Column) -> Column:
    """32 hex digits of an IPv6 text without an IPv4 tail."""

    def expanded(t: Column) -> Column:
        colons = F.length(t) - F.length(F.replace(t, F.lit(":"), F.lit("")))
        zeros = F.repeat(F.lit("0:"), F.lit(8) - colons)
        return F.replace(t, F.lit("::"), F.concat(F.lit(":"), zeros))

    with_ends = F.regexp_replace(F.regexp_replace(text, "^::", "0::"), "::$", "::0")
    groups = F.concat(let(with_ends, expanded), F.lit(":"))
    padded = F.regexp_replace(F.regexp_replace(groups, "([0-9a-f]+)", "000$1"), "[0-9a-f]*([0-9a-f]{4}):", "$1")
    return F.when(text.rlike(_V6_SHAPE), F.nullif(F.regexp_extract(padded, "^[0-9a-f]{32}$", 0), F.lit("")))


def _v6_hex(ip: Column) -> Column:
    """32 hex digits of an IPv6 text, NULL when it is not one."""
    head = let(F.regexp_replace(F.lower(ip), _V4_TAIL, ":0:0"), _plain_v6_hex)
    tail = F.lpad(F.hex(v4_long(F.regexp_extract(ip, _V4_TAIL, 1))), 8, "0")
    return F.when(ip.contains("."), F.concat(F.substring(head, 1, 24), F.lower(tail))).otherwise(head)


def _v6_text(digits: Column) -> Column:
    """Shortest text of 32 hex digits: the first longest run of zero groups
    becomes "::", and an embedded IPv4 address is written as such."""

    def written(d: Column) -> Column:
        groups = F.regexp_replace(d, r"(.{4})(?=.)", "$1:")
        text = F.regexp_replace(groups, r"\b0{1,3}(?=[0-9a-f])", "")
        for run in range(8, 1, -1):  # once a run is written as "::" no other is
            text = F.regexp_replace(text, rf"^(?!.*::)(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)(.*)$", "$1::$2")
        low = v4_text(F.conv(F.substring(d, 25, 8), 16, 10).try_cast("bigint"))
        return (
            F.when(d.startswith("0" * 20 + "ffff"), F.concat(F.lit("::ffff:"), low))
            .when(d.rlike("^0{24}(?!0000)"), F.concat(F.lit("::"), low))
            .otherwise(text)
        )

    return let(digits, written)


def ip_text(ip: ColumnLike) -> Column:
    """Canonical host text; NULL when the input is not an address."""
    ip = as_col(ip)
    v6 = let(ip, lambda t: _v6_text(_v6_hex(t)))
    return F.when(is_v4(ip), ip).when(ip.contains(":"), v6)


def valid_ip(ip: ColumnLike) -> Column:
    return ip_text(ip)


def ip_key(ip: ColumnLike) -> Column:
    """16-byte ordering key."""
    ip = as_col(ip)
    v4 = F.concat(F.lit(_V4_KEY_PREFIX), F.lpad(F.hex(v4_long(ip)), 8, "0"))
    return F.when(is_v4(ip), F.unhex(v4)).when(ip.contains(":"), F.unhex(let(ip, _v6_hex)))


def key_of(address: str) -> bytes:
    """The same key for a literal."""
    parsed = ipaddress.ip_address(address)
    return parsed.packed if parsed.version == 6 else b"\0" * 10 + b"\xff\xff" + parsed.packed


def key_range(cidr: str) -> tuple[bytes, bytes]:
    net = ipaddress.ip_network(cidr, strict=False)
    return key_of(str(net.network_address)), key_of(str(net.broadcast_address))


def _in_v4(number: Column, cidr: str) -> Column:
    net = ipaddress.IPv4Network(cidr)
    return number.between(int(net.network_address), int(net.broadcast_address))


def _in_key(key: Column, cidr: str) -> Column:
    low, high = key_range(cidr)
    return (key >= F.lit(low)) & (key <= F.lit(high))


def in_cidr(ip: ColumnLike, cidr: str) -> Column:
    """True when the address lies in the network (false for non-addresses)."""
    ip = as_col(ip)
    if ":" in cidr:
        test = F.when(ip.contains(":"), _in_key(ip_key(ip), cidr))
    else:
        test = _in_v4(v4_long(ip), str(ipaddress.ip_network(cidr, strict=False)))
    return F.coalesce(test, F.lit(False))


# ---- address classes: three definitions that differ on purpose -------------
#
# All of them expect canonical text, on which a prefix test is exact, cheap and
# part of the generated code.

# Private ranges 10/8, 172.16/12, 192.168/16, fc00::/7, fe80::/10.
PRIVATE = r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"
BROADCAST_OR_MULTICAST = r"^(?:255\.255\.255\.255$|22[4-9]\.|23[0-9]\.|ff[0-9a-f]{2}:)"
_PRIVATE_NETWORK = r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|f[cd][0-9a-f]{2}:)"


def is_public_ip_sql(ip: ColumnLike) -> Column:
    """Outside the private ranges. Loopback, 169.254/16 and multicast count as
    public here; NULL is not public."""
    return F.coalesce(~as_col(ip).rlike(PRIVATE), F.lit(False))


def is_private_network(ip: ColumnLike) -> Column:
    """In a private range other than link-local; NULL is not."""
    return F.coalesce(as_col(ip).rlike(_PRIVATE_NETWORK), F.lit(False))


def is_wan_candidate_ip(ip: ColumnLike) -> Column:
    """Public in the sense above and not loopback or broadcast."""
    ip = as_col(ip)
    return is_public_ip_sql(ip) & ~ip.startswith("127.") & ~ip.isin("::1", "255.255.255.255")


# Special-purpose address registries, as prefixes of the text.
# IPv4: 0/8 10/8 127/8 169.254/16 172.16/12 192.0.0/24 (but .9 and .10) 192.0.2/24
# 192.168/16 198.18/15 198.51.100/24 203.0.113/24 240/4, alone or IPv4-mapped.
_V4_RESERVED = (
    r"^(?:::ffff:)?(?:(?:0|10|127)\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.0\.0\.(?!(?:9|10)$)"
    r"|192\.0\.2\.|192\.168\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2(?:4[0-9]|5[0-5])\.)"
)
# 100.64/10 is shared, neither reserved nor global; 224/4 is multicast.
_V4_NOT_GLOBAL = (
    r"^(?:::ffff:)?(?:100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|2(?:2[4-9]|3[0-9])\.)"
)
# IPv6: ::/128 ::1/128 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16
# fc00::/7 fe80::/10, but for the global parts of 2001::/23.
_V6_RESERVED = (
    r"^(?:::1?$|64:ff9b:1:|100::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,3})?$|2001:(?::|[0-9a-f]{1,2}:|1[0-9a-f]{2}:)"
    r"|2001:db8:|2002:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"
)
_V6_RESERVED_BUT_GLOBAL = r"^2001:(?:1::[12]$|3:|4:112:|[23][0-9a-f]:)"
_V6_MULTICAST = "^ff[0-9a-f]{2}:"


def _reserved(ip: Column) -> Column:
    return ip.rlike(_V4_RESERVED) | (ip.rlike(_V6_RESERVED) & ~ip.rlike(_V6_RESERVED_BUT_GLOBAL))


def is_global_ip(ip: ColumnLike) -> Column:
    """Globally routable and not multicast."""
    ip = as_col(ip)
    special = _reserved(ip) | ip.rlike(_V4_NOT_GLOBAL) | ip.rlike(_V6_MULTICAST)
    return F.coalesce((ip.contains(":") | is_v4(ip)) & ~special, F.lit(False))


def is_reserved_ip(ip: ColumnLike) -> Column:
    """Reserved, or not an address at all (any spelling is accepted)."""
    return let(ip_text(ip), lambda text: F.coalesce(_reserved(text), F.lit(True)))


def is_bcast_or_mcast(ip: ColumnLike) -> Column:
    ip = as_col(ip)
    return F.coalesce(ip.rlike(BROADCAST_OR_MULTICAST), F.lit(False))


def one_of(value: ColumnLike, values) -> Column:
    """Membership that is false, not NULL, for a NULL value or an empty list."""
    values = list(values)
    if not values:
        return F.lit(False)
    return F.coalesce(as_col(value).isin(values), F.lit(False))


def is_remote(ip: ColumnLike, own_ips) -> Column:
    """Globally routable and not one of the site's own addresses."""
    return is_global_ip(ip) & ~one_of(ip, own_ips)


def not_own(ip: ColumnLike, own_ips) -> Column:
    ip = as_col(ip)
    return ~ip.isin(list(own_ips)) if own_ips else F.lit(True)


def cidr_of(ip: ColumnLike, prefix: int) -> Column:
    """Text of the network with this prefix length (a multiple of 8, or 22) that
    holds the address."""
    ip = as_col(ip)
    whole, bits = divmod(prefix, 8)
    parts = [F.substring_index(ip, ".", whole)] if whole else []
    if bits:
        octet = F.substring_index(F.substring_index(ip, ".", whole + 1), ".", -1).try_cast("int")
        parts.append(octet.bitwiseAND(F.lit((0xFF << (8 - bits)) & 0xFF)).cast("string"))
    rest = 4 - whole - (1 if bits else 0)
    v4 = F.concat_ws(".", *parts, *[F.lit("0")] * rest)

    def v6(text: Column) -> Column:
        digits = _v6_hex(text)
        kept, tail = divmod(prefix, 4)
        head = F.substring(digits, 1, kept)
        if tail:
            digit = F.conv(F.substring(digits, kept + 1, 1), 16, 10).try_cast("int")
            head = F.concat(head, F.lower(F.hex(digit.bitwiseAND(F.lit((0xF << (4 - tail)) & 0xF)))))
        return _v6_text(F.rpad(head, 32, "0"))

    network = F.when(is_v4(ip), v4).when(ip.contains(":"), let(ip, v6))
    return F.concat(network, F.lit(f"/{prefix}"))
