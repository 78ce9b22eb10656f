"""Raw gateway lines -> log rows, as one job of native column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.config import NetConfig
from netlens.functions.ip import ColumnLike, as_col, is_global_ip, let, one_of, valid_ip
from netlens.functions.rules import action_of, direction_of
from netlens.functions.scalars import service_display, ts_lit
from netlens.operators.dims import join_service
from netlens.plans.staging import computed, spread_null
from netlens.schema import MAX_LENGTHS

# The formats of the log lines. (?U) makes \w, \s and \d Unicode,
# (?d) makes "." stop at a line feed only.
HEADER = r"(?dU)^\w+\s+\d+\s+\d+:\d+:\d+\s+\S+\s+.+$"
# The same for a header in plain ASCII, which is many times faster to test.
ASCII_HEADER = r"(?d)^[A-Za-z0-9_]+[ \t]+[0-9]+[ \t]+[0-9]+:[0-9]+:[0-9]+[ \t]+[!-~]+[ \t]+[!-~].*$"
PRIORITY = r"^<[0-9]+>"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MAC = r"[0-9a-fA-F]{2}(?::[0-9a-fA-F]{2}){5}"
FIREWALL = {
    "rule_name": r"\[([^\]]+)\]",
    "interface_in": r"IN=(\S*)",
    "interface_out": r"OUT=(\S*)",
    "src_ip": r"SRC=([0-9a-fA-F:.]+)",
    "dst_ip": r"DST=([0-9a-fA-F:.]+)",
    "protocol": r"PROTO=([A-Z]+)",
    "src_port": r"SPT=([0-9]+)",
    "dst_port": r"DPT=([0-9]+)",
    "mac_address": r"MAC=([0-9a-f:]+)",
}
DESCRIPTION = r'DESCR="[^"]*"'
DNS_QUERY = r"query\[([A-Z]+)\]\s+(\S+)\s+from\s+([0-9a-fA-F:.]+)"
DNS_REPLY = r"(?d)reply\s+(\S+)\s+is\s+(.+)"
DNS_FORWARD = r"forwarded\s+(\S+)\s+to\s+([0-9a-fA-F:.]+)"
DNS_CACHED = r"(?d)cached\s+(\S+)\s+is\s+(.+)"
DHCP_ACK = rf"DHCPACK\((\S+)\)\s+([0-9a-fA-F:.]+)\s+({MAC})\s*(\S*)"
DHCP_REQUEST = rf"DHCPREQUEST\((\S+)\)\s+([0-9a-fA-F:.]+)\s+({MAC})"
DHCP_OFFER = rf"DHCPOFFER\((\S+)\)\s+([0-9a-fA-F:.]+)\s+({MAC})"
DHCP_DISCOVER = rf"DHCPDISCOVER\((\S+)\)\s+(?:([0-9a-fA-F:.]+)\s+)?({MAC})"
WIFI_STATION = r"(\w+):\s+STA\s+([0-9a-f:]+)"
WIFI_ASSOCIATION = r"STA\s+([0-9a-f:]+)\s+.*?(associated|disassociated|deauthenticated|authenticated)"


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """Matched group, NULL when empty or when nothing matched."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _fields(**columns: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in columns.items()])


def split_header(line: ColumnLike) -> Column:
    """struct(month, day, time, host, body), NULL for a line without a header.
    A line that does not match is tried again without its <priority>."""
    line = as_col(line)
    # A header starts with a word, so only a line starting with "<" needs the retry.
    text = F.when(line.startswith("<"), F.regexp_replace(line, PRIORITY, "")).otherwise(line)
    names = ("month", "day", "time", "host", "body")

    def fields(blanks: str) -> Column:
        # One split instead of five group extractions: the fields hold no blanks.
        return let(F.split(text, blanks, 5), lambda p: F.struct(*[p[i].alias(n) for i, n in enumerate(names)]))

    return F.when(text.rlike(ASCII_HEADER), fields(r"[ \t]+")).when(text.rlike(HEADER), fields(r"(?U)\s+"))


def syslog_ts(month: ColumnLike, day: ColumnLike, time: ColumnLike, tz: str, now: ColumnLike) -> Column:
    """Instant of a header time, which has no year: the year of ``now``, minus one
    when the month lies more than six ahead. An impossible date gives NULL."""
    month, parts = as_col(month), F.split(as_col(time), ":")
    number = F.lit(1)
    for i, name in enumerate(MONTHS, 1):
        number = F.when(month == name, i).otherwise(number)
    local_now = F.from_utc_timestamp(as_col(now), tz)
    year = F.year(local_now) - F.when(number - F.month(local_now) > 6, 1).otherwise(0)
    clock = [F.get(parts, F.lit(i)).try_cast("int") for i in range(3)]
    seconds = clock[2].cast("decimal(8,6)")
    # 60 seconds would be rolled over by the timestamp function.
    moment = F.try_make_timestamp(year, number, as_col(day).try_cast("int"), clock[0], clock[1], seconds, F.lit(tz))
    return F.when(clock[2] < 60, moment)


def log_type_of(body: ColumnLike) -> Column:
    """The first rule that fits decides."""
    body = as_col(body)

    def has(*words: str) -> Column:
        test = body.contains(words[0])
        for word in words[1:]:
            test = test | body.contains(word)
        return test

    return (
        F.when(has("SRC=") & has("DST=") & has("PROTO="), "firewall")
        .when(body.startswith("[") & has("DESCR="), "firewall")
        .when(has("dnsmasq-dhcp", "DHCPACK", "DHCPDISCOVER", "DHCPREQUEST", "DHCPOFFER"), "dhcp")
        .when(has("dnsmasq") & has("query[", "reply ", "forwarded ", "cached "), "dns")
        .when(has("stamgr", "hostapd", "stahtd"), "wifi")
        .when(has("STA ") & has("associated", "authenticated"), "wifi")
        .otherwise("system")
    )


def source_mac(mac_field: ColumnLike) -> Column:
    """Octets 7-12 of ``target:source:type``; a shorter field as it is."""
    field = as_col(mac_field)
    octets = F.split(field, ":")
    return F.when(F.size(octets) >= 12, F.array_join(F.slice(octets, 7, 6), ":")).otherwise(field)


def firewall_fields(body: ColumnLike) -> Column:
    body = as_col(body)
    # Each pattern runs once: the matches are taken first and cleaned afterwards.
    matches = {name: F.regexp_extract(body, pattern, 1) for name, pattern in FIREWALL.items()}
    matches["rule_desc"] = F.regexp_extract(body, DESCRIPTION, 0)

    def cleaned(m: Column) -> Column:
        found = {name: F.nullif(m[name], F.lit("")) for name in matches}
        found["protocol"] = F.lower(found["protocol"])
        found["mac_address"] = source_mac(found["mac_address"])
        for port in ("src_port", "dst_port"):
            found[port] = found[port].try_cast("bigint")
        # An empty description is a value, a missing one is NULL.
        text = found["rule_desc"]
        found["rule_desc"] = F.substr(text, F.lit(len('DESCR="') + 1), F.length(text) - len('DESCR=""'))
        return _fields(**found)

    return let(_fields(**matches), cleaned)


def dns_fields(body: ColumnLike) -> Column:
    """Query, reply, forwarded or cached: the first that matches."""
    body = as_col(body)
    kinds = (("query", DNS_QUERY), ("reply", DNS_REPLY), ("forward", DNS_FORWARD), ("cached", DNS_CACHED))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        kind = F.when(body.rlike(pattern), name).otherwise(kind)
    g = F.regexp_extract

    def fields(k: Column) -> Column:
        names = F.when(k == "query", g(body, DNS_QUERY, 2))
        for name, pattern in kinds[1:]:
            names = names.when(k == name, g(body, pattern, 1))
        return _fields(
            dns_type=F.when(k == "query", g(body, DNS_QUERY, 1)),
            dns_query=names,
            dns_answer=F.when(k == "reply", g(body, DNS_REPLY, 2)).when(k == "cached", g(body, DNS_CACHED, 2)),
            src_ip=F.when(k == "query", g(body, DNS_QUERY, 3)),
            dst_ip=F.when(k == "forward", g(body, DNS_FORWARD, 2)),
        )

    return let(kind, fields)


def dhcp_fields(body: ColumnLike) -> Column:
    """Acknowledge, request, offer or discover, in this order. The four share one
    form, so the matched text is taken first and split into its words."""
    body = as_col(body)
    matched = F.coalesce(*[_group(body, p, 0) for p in (DHCP_ACK, DHCP_REQUEST, DHCP_OFFER, DHCP_DISCOVER)])

    def fields(text: Column) -> Column:
        words = F.split(text, r"\s+")
        head = words[0]
        bare = F.size(words) == 2  # a discover without an address
        mac_word = F.when(bare, words[1]).otherwise(F.get(words, F.lit(2)))
        glued = F.nullif(F.substr(mac_word, F.lit(18)), F.lit(""))
        event = F.substring_index(head, "(", 1)
        host = F.coalesce(glued, F.nullif(F.get(words, F.lit(3)), F.lit("")))
        return _fields(
            interface_in=F.regexp_extract(head, r"\((\S+)\)$", 1),
            src_ip=F.when(~bare, words[1]),
            mac_address=F.substring(mac_word, 1, 17),
            hostname=F.when(event == "DHCPACK", host),
            dhcp_event=event,
        )

    return let(matched, lambda text: F.when(text.isNotNull(), fields(text)))


def wifi_fields(body: ColumnLike) -> Column:
    body = as_col(body)
    tracker = body.contains("stahtd") & body.contains("{")
    json = F.when(tracker, F.try_parse_json(F.substr(body, F.instr(body, "{"))))

    def member(name: str) -> Column:
        return F.try_variant_get(json, f"$.{name}", "string")

    association, station = body.rlike(WIFI_ASSOCIATION), body.rlike(WIFI_STATION)
    g = F.regexp_extract
    return _fields(
        mac_address=F.when(tracker, member("mac")).when(association, g(body, WIFI_ASSOCIATION, 1))
        .when(station, g(body, WIFI_STATION, 2)),
        wifi_event=F.when(tracker, F.coalesce(member("event_type"), member("message_type"), F.lit("stahtd")))
        .when(association, g(body, WIFI_ASSOCIATION, 2)).when(station, g(body, WIFI_STATION, 1)),
    )


def system_fields(body: ColumnLike) -> Column:
    """System lines keep their raw text only."""
    return F.lit("system")


def valid_mac(mac: ColumnLike) -> Column:
    mac = as_col(mac)
    return F.when(mac.rlike(f"^{MAC}$"), F.lower(mac))


PARTS = {
    "firewall": ("rule_name", "rule_desc", "interface_in", "interface_out", "src_ip", "src_port",
                 "dst_ip", "dst_port", "protocol", "mac_address"),
    "dns": ("dns_type", "dns_query", "dns_answer", "src_ip", "dst_ip"),
    "dhcp": ("interface_in", "src_ip", "mac_address", "hostname", "dhcp_event"),
    "wifi": ("mac_address", "wifi_event"),
}
PARSED = (
    "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "rule_name", "rule_desc", "interface_in",
    "interface_out", "mac_address", "hostname", "dns_query", "dns_type", "dns_answer", "dhcp_event", "wifi_event",
)


def _length_problem() -> Column:
    tests = [F.length(c) > n for c, n in MAX_LENGTHS.items() if c in (*PARSED, "log_type")]
    tests += [F.col(c) > 2_147_483_647 for c in ("src_port", "dst_port")]
    problem = F.lit(False)
    for test in tests:
        problem = problem | F.coalesce(test, F.lit(False))
    return problem


def parse_lines(df: DataFrame, cfg: NetConfig, now: str | datetime | Column, raw: str = "raw_log") -> DataFrame:
    """Parsed columns plus ``parse_error``: NULL, 'header', 'timestamp' or 'size'.

    Every field is computed under its line's type only, so a line pays for the
    patterns of one type.
    """
    now = now if isinstance(now, Column) else ts_lit(now)
    header = computed(df, {"_h": split_header(raw)})
    body = F.col("_h.body")
    typed = computed(header, {"log_type": log_type_of(body)})
    made = {
        "firewall": firewall_fields(body), "dns": dns_fields(body),
        "dhcp": dhcp_fields(body), "wifi": wifi_fields(body),
    }
    split = computed(typed, {f"_{k}": F.when(F.col("log_type") == k, fields) for k, fields in made.items()})
    columns = {
        name: F.coalesce(*[F.col(f"_{kind}.{name}") for kind, names in PARTS.items() if name in names])
        for name in PARSED
    }
    parsed = split.select(*df.columns, "_h", "log_type", *[value.alias(name) for name, value in columns.items()])
    checked = computed(
        parsed,
        {
            "timestamp": syslog_ts("_h.month", "_h.day", "_h.time", cfg.timezone, now),
            "src_ip": valid_ip("src_ip"),
            "dst_ip": valid_ip("dst_ip"),
            "mac_address": valid_mac("mac_address"),
        },
    )
    error = (
        F.when(F.col("_h").isNull(), "header")
        .when(F.col("timestamp").isNull(), "timestamp")
        .when(_length_problem(), "size")
    )
    return checked.withColumn("parse_error", error).drop("_h")


def derive(parsed: DataFrame, cfg: NetConfig, src_is_own_wan: Column | None = None) -> DataFrame:
    """Action and direction of the firewall rows."""
    is_firewall = F.col("log_type") == "firewall"
    direction = direction_of("interface_in", "interface_out", "rule_name", "src_ip", "dst_ip", cfg, src_is_own_wan)
    return parsed.withColumns(
        {
            "rule_action": F.when(is_firewall, action_of("rule_name", "rule_desc")),
            "direction": F.when(is_firewall, direction),
            "src_port": F.col("src_port").try_cast("int"),
            "dst_port": F.col("dst_port").try_cast("int"),
        }
    )


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("parse_error").isNull()).drop("parse_error")


def quarantine(parsed: DataFrame, raw: str = "raw_log") -> DataFrame:
    """Lines that could not be stored, with the reason."""
    return parsed.where(F.col("parse_error").isNotNull()).select(raw, F.col("parse_error").alias("reason"))


def with_service(parsed: DataFrame, services: DataFrame) -> DataFrame:
    named = join_service(parsed, services)
    name = F.when(F.col("log_type") == "firewall", service_display("iana_service"))
    return named.withColumn("service_name", name).drop("iana_service", "service_description")


def parse_syslog(
    df: DataFrame, cfg: NetConfig, now: str | datetime | Column, services: DataFrame | None = None, raw: str = "raw_log"
) -> DataFrame:
    """The complete job for rows that parse; see ``quarantine`` for the others."""
    rows = derive(good_rows(parse_lines(df, cfg, now, raw)), cfg)
    return with_service(rows, services) if services is not None else rows


def drop_disabled(df: DataFrame, types: Iterable[str]) -> DataFrame:
    """Leave out switched-off types, wifi and system only."""
    off = [t for t in types if t in ("wifi", "system")]
    return df.where(~F.col("log_type").isin(off)) if off else df


def learn_wan_ips(df: DataFrame, wan_interfaces: Iterable[str]) -> DataFrame:
    """Own addresses shown by rules that guard the gateway's WAN side."""
    seen = df.where(
        one_of("interface_in", wan_interfaces) & F.col("rule_name").contains("WAN_LOCAL") & is_global_ip("dst_ip")
    )
    return seen.select(F.col("dst_ip").alias("wan_ip")).distinct()


def derive_learning(parsed: DataFrame, cfg: NetConfig) -> DataFrame:
    """``derive`` with own addresses learned from the same data first.

    A line-by-line reader knows an address only from the line that shows it on;
    here it holds for the whole batch, which needs no order and is repeatable.
    """
    learned = learn_wan_ips(parsed, cfg.wan_interfaces).select(F.col("wan_ip").alias("_wan"))
    key = spread_null(F.col("src_ip"), F.col("raw_log"))
    joined = parsed.join(learned, key == F.col("_wan"), "left")
    own = F.col("_wan").isNotNull() | one_of("src_ip", cfg.wan_ips)
    return derive(joined, cfg, own).drop("_wan")
