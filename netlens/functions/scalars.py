"""Scalar projections used across reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.config import (
    ABUSE_CATEGORIES,
    SENSITIVE_KEYS,
    THREAT_BANDS,
    TIME_BUCKETS,
    VPN_PREFIXES,
    NetConfig,
)
from netlens.functions.ip import ColumnLike, as_col, one_of
from netlens.functions.rules import has_vpn_prefix


def ts_lit(value: datetime | str) -> Column:
    return F.lit(value.isoformat(sep=" ") if isinstance(value, datetime) else value).cast("timestamp")


# The eight dimensions of the flow graph.
_FLOW_DIMS = {
    "src_ip": lambda: F.col("src_ip"),
    "dst_ip": lambda: F.col("dst_ip"),
    "dst_port": lambda: F.coalesce(F.col("dst_port").cast("string"), F.lit("Unknown")),
    "protocol": lambda: F.coalesce(F.lower("protocol"), F.lit("unknown")),
    "service_name": lambda: F.coalesce(F.col("service_name"), F.lit("Unknown")),
    "direction": lambda: F.coalesce(F.col("direction"), F.lit("unknown")),
    "interface_in": lambda: F.coalesce(F.col("interface_in"), F.lit("unknown")),
    "interface_out": lambda: F.coalesce(F.col("interface_out"), F.lit("unknown")),
}
FLOW_DIMENSIONS = tuple(_FLOW_DIMS)


def flow_dim(name: str) -> Column:
    if name not in _FLOW_DIMS:
        raise ValueError(f"unknown flow dimension {name!r}, use one of {sorted(_FLOW_DIMS)}")
    return _FLOW_DIMS[name]()


def name_coalesce(client: str | None = "c", device: str | None = None, existing: Column | None = None) -> Column:
    """First known name: the stored one, then client, then device columns."""
    parts = [] if existing is None else [existing]
    if client:
        parts += [F.col(f"{client}.{c}") for c in ("device_name", "hostname", "oui")]
    if device:
        parts += [F.col(f"{device}.{c}") for c in ("device_name", "model")]
    return F.coalesce(*parts)


def bucket_of(time_range: str | None) -> str:
    return TIME_BUCKETS.get(time_range or "", "day")


def time_bucket(ts: ColumnLike, time_range: str | None) -> Column:
    return F.date_trunc(bucket_of(time_range), as_col(ts))


def service_display(name: ColumnLike) -> Column:
    name = as_col(name)
    return F.when(name == "domain", "DNS").otherwise(name)


def csv_safe(text: ColumnLike) -> Column:
    """Quote a cell a spreadsheet would take for a formula; NULL becomes ''."""
    text = as_col(text).cast("string")
    risky = text.rlike(r"(?s)^[=+@;\t\r\n\x00]") | text.rlike(r"(?s)^-(?![0-9]|\.[0-9])")
    return F.coalesce(F.when(risky, F.concat(F.lit("'"), text)).otherwise(text), F.lit(""))


def _digits_after(name: Column, prefix: str) -> Column:
    rest = F.substring(name, len(prefix) + 1, 100)
    return F.when(rest.rlike("^[0-9]+$"), rest)


def iface_type(name: ColumnLike, cfg: NetConfig) -> Column:
    name = as_col(name)
    return (
        F.when(one_of(name, cfg.wan_interfaces), "wan")
        .when(has_vpn_prefix(name), "vpn")
        .when(name.startswith("br"), "vlan")
        .when(name.startswith("eth"), "eth")
    )


def iface_vlan_id(name: ColumnLike, cfg: NetConfig) -> Column:
    name = as_col(name)
    number = _digits_after(name, "br").try_cast("int")
    return F.when(
        iface_type(name, cfg) == "vlan", F.when(name == "br0", F.lit(1)).otherwise(number)
    )


def iface_label(name: ColumnLike, wan_list: list[str]) -> Column:
    """Suggested display label of an interface."""
    name = as_col(name)
    label = F.lit(None).cast("string")
    for position, wan in reversed(list(enumerate(wan_list, 1))):
        text = "WAN" if len(wan_list) == 1 else f"WAN{position}"
        label = F.when(name == wan, text).otherwise(label)

    def numbered(prefix: str, word: str) -> Column:
        number = _digits_after(name, prefix)
        return F.when(number.isNotNull(), F.concat(F.lit(word + " "), number)).otherwise(name)

    return F.coalesce(
        label,
        F.when(name == "br0", "Main LAN")
        .when(name.startswith("br"), numbered("br", "VLAN"))
        .when(name.startswith("vlan"), numbered("vlan", "VLAN"))
        .when(name.startswith("eth"), numbered("eth", "Ethernet"))
        .when(has_vpn_prefix(name), "VPN")
        .otherwise(""),
    )


def _by_vpn_prefix(name: ColumnLike, position: int) -> Column:
    name = as_col(name)
    found = F.lit(None).cast("string")
    for row in reversed(VPN_PREFIXES):
        found = F.when(name.startswith(row[0]), row[position]).otherwise(found)
    return found


def vpn_badge(name: ColumnLike) -> Column:
    return _by_vpn_prefix(name, 1)


def vpn_description(name: ColumnLike) -> Column:
    return _by_vpn_prefix(name, 2)


def threat_band(score: ColumnLike) -> Column:
    score = as_col(score)
    band = F.lit(THREAT_BANDS[-1][1])
    for minimum, label in reversed(THREAT_BANDS[:-1]):
        band = F.when(score >= minimum, label).otherwise(band)
    return F.when(score.isNotNull(), band)


def decode_categories(categories: ColumnLike) -> Column:
    categories = as_col(categories)
    labels = F.create_map(*[F.lit(x) for k, v in ABUSE_CATEGORIES.items() for x in (k, v)])

    def label(code: Column) -> Column:
        number = F.regexp_extract(code, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
        return F.when(code == "blacklist", "Blacklist").otherwise(
            F.coalesce(labels[number], F.concat(F.lit("Cat "), code))
        )

    return F.when(F.size(categories) > 0, F.array_join(F.transform(categories, label), ", "))


def rule_desc_norm(desc: ColumnLike) -> Column:
    desc = as_col(desc)
    return F.when(desc != "", F.regexp_replace(desc, r"\](?!\s)", "] "))


def _private_for_display(ip: Column) -> Column:
    v6 = F.lower(ip)
    private = F.when(
        ip.contains(":"), v6.isin("::1", "::") | v6.rlike("^(?:f[cd]|fe80|ff)")
    ).otherwise(
        ip.rlike(r"^(?:10\.|192\.168\.|127\.|169\.254\.)") | ip.rlike(r"^172\.(?:1[6-9]|2[0-9]|3[01])\.")
    )
    return F.coalesce(F.when(ip == "", F.lit(True)).otherwise(private), F.lit(True))


def asn_subline(direction, src, dst, asn, hosts) -> Column:
    """Text shown under the remote side: struct(src_subline, dst_subline)."""
    src, dst, direction = as_col(src), as_col(dst), as_col(direction)
    text = F.coalesce(F.nullif(as_col(asn), F.lit("")), F.nullif(as_col(hosts), F.lit("")))
    inbound = F.coalesce(direction == "inbound", F.lit(False))
    return F.struct(
        F.when(inbound & ~_private_for_display(src), text).alias("src_subline"),
        F.when(~inbound & ~_private_for_display(dst), text).alias("dst_subline"),
    )


def share_pct(part: ColumnLike, total: ColumnLike, digits: int = 0) -> Column:
    part, total = as_col(part), as_col(total)
    return F.when(total > 0, F.round(part * 100.0 / total, digits)).otherwise(F.lit(0.0))


def heat_tier(n: ColumnLike, maximum: ColumnLike) -> Column:
    """Colour tier 0..4 on a log scale; NULL where nothing is counted."""
    n, maximum = as_col(n), as_col(maximum)
    ratio = F.log10(n + 1) / F.log10(maximum + 1)
    tier = (
        F.when(ratio < 0.2, 0).when(ratio < 0.4, 1).when(ratio < 0.6, 2).when(ratio < 0.8, 3).otherwise(4)
    )
    return F.when((n > 0) & (maximum > 0), tier)


def with_share(df: DataFrame, part: str, out: str = "share", digits: int = 0) -> DataFrame:
    """Share of each row in the total. For report-sized inputs (after a top-k)."""
    total = F.sum(part).over(Window.partitionBy(F.lit(0)))
    return df.withColumn(out, share_pct(F.col(part), total, digits))


def redact(params: ColumnLike) -> Column:
    """Mask the values of sensitive keys in a ``map<string,string>``."""
    pattern = "(?i)" + "|".join(SENSITIVE_KEYS)
    masked = F.transform_values(
        as_col(params), lambda k, v: F.when(k.rlike(pattern), F.lit("***")).otherwise(v)
    )
    return F.coalesce(masked, F.create_map().cast("map<string,string>"))


def next_retry(now: ColumnLike, attempts: ColumnLike, base_delay: int = 300) -> Column:
    """Exponential back-off from the attempts made so far, one day at most."""
    # 2^9 * 300 s already exceeds a day: bounding the exponent keeps the power finite.
    doubled = F.pow(F.lit(2.0), F.least(as_col(attempts), F.lit(40)))
    delay = F.least(doubled * base_delay, F.lit(86_400.0))
    return as_col(now) + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))


def reinterpret_tz(ts: ColumnLike, tz: str) -> Column:
    """Take a timestamp stored as UTC for local time of ``tz``."""
    return F.to_utc_timestamp(as_col(ts), tz)


def lower_protocol(protocol: ColumnLike) -> Column:
    return F.lower(as_col(protocol))


def report_summary(reports: ColumnLike, hostnames: ColumnLike) -> Column:
    """struct(categories, hostnames) of a list of reports ``struct<categories:array<int>>``."""
    reports, hostnames = as_col(reports), as_col(hostnames)
    codes = F.flatten(F.transform(reports, lambda r: r["categories"]))
    texts = F.transform(codes, lambda c: c.cast("string"))
    return F.struct(
        F.array_sort(F.array_distinct(F.coalesce(texts, F.array().cast("array<string>")))).alias("categories"),
        F.nullif(F.array_join(hostnames, ", "), F.lit("")).alias("hostnames"),
    )


def audit_fields(detail: ColumnLike) -> Column:
    """Known fields of an audit entry's JSON; all NULL when it is no JSON."""
    detail = as_col(detail)
    return F.struct(
        *[
            F.get_json_object(detail, f"$.{name}").alias(name)
            for name in ("tool_name", "scope", "success", "error", "params")
        ]
    )


def threat_coalesce(log: Column, src: Column, dst: Column, direction: Column, src_known: Column) -> Column:
    """The log's own value, else that of the remote side's reputation row."""
    side = (
        F.when(direction.isin("inbound", "in"), src)
        .when(direction.isin("outbound", "out"), dst)
        .when(src_known, src)
        .otherwise(dst)
    )
    return F.coalesce(log, side)


def non_empty(array: ColumnLike) -> Column:
    array = as_col(array)
    return F.when(F.size(array) > 0, array)
