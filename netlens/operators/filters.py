"""Log filters: one dataclass of search parameters -> one boolean column.

All set conditions are AND-ed. A leading ``!`` negates a text parameter, and a
negated condition keeps rows whose column is NULL.
"""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.config import DEFAULT_RANGE, TIME_RANGES
from netlens.functions.ip import ColumnLike, as_col, ip_text
from netlens.functions.rules import has_vpn_prefix
from netlens.functions.scalars import ts_lit


def _parse_iso(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text) if text else None
    except (TypeError, ValueError):
        return None


def _utc_text(moment: datetime) -> str:
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return moment.isoformat(sep=" ")


@dataclass(frozen=True)
class TimeWindow:
    """A preset range ending now, or explicit bounds (both inclusive)."""

    preset: str | None = None
    start: str | None = None
    end: str | None = None

    def normalise(self) -> TimeWindow:
        """Drop what does not parse; a valid start replaces the preset; with
        neither a preset nor a start the default range applies."""
        start = self.start if _parse_iso(self.start) else None
        end = self.end if _parse_iso(self.end) else None
        if start:
            return TimeWindow(None, start, end)
        preset = self.preset if self.preset in TIME_RANGES else DEFAULT_RANGE
        return TimeWindow(preset, None, end)

    def bounds(self, now: str | datetime) -> tuple[str | None, str | None]:
        window = self.normalise()
        moment = now if isinstance(now, datetime) else datetime.fromisoformat(now)
        if window.preset:
            low = _utc_text(moment - TIME_RANGES[window.preset])
        else:
            low = _utc_text(_parse_iso(window.start))
        high = _utc_text(_parse_iso(window.end)) if window.end else None
        return low, high

    def condition(self, now: str | datetime, ts: str = "timestamp", date: str | None = None) -> Column:
        """``date`` names the partition column, so that whole days are skipped."""
        low, high = self.bounds(now)
        test = F.col(ts) >= ts_lit(low)
        if high:
            test = test & (F.col(ts) <= ts_lit(high))
        if date:
            test = test & (F.col(date) >= F.lit(low[:10]).cast("date"))
            if high:
                test = test & (F.col(date) <= F.lit(high[:10]).cast("date"))
        return test


def in_window(df: DataFrame, window: TimeWindow, now: str | datetime) -> DataFrame:
    date = "log_date" if "log_date" in df.columns else None
    return df.where(window.condition(now, date=date))


def split_negation(value: str) -> tuple[bool, str]:
    return (True, value[1:]) if value.startswith("!") else (False, value)


def parse_port(value: str) -> tuple[bool, int | None]:
    negated, text = split_negation(value)
    try:
        port = int(text)
    except ValueError:
        return negated, None
    return negated, port if 1 <= port <= 65535 else None


def _csv(value: str) -> list[str]:
    return [part.strip() for part in value.split(",")]


def _or_null(test: Column, column: Column) -> Column:
    return test | column.isNull()


def literal_substring(column: ColumnLike, text: str, ignore_case: bool = False) -> Column:
    """Plain substring test: wildcards of LIKE have no meaning here."""
    column = as_col(column)
    if ignore_case:
        return F.lower(column).contains(F.lower(F.lit(text)))
    return column.contains(F.lit(text))


def _substring_filter(column: str, value: str, ignore_case: bool = False) -> Column:
    negated, text = split_negation(value)
    test = literal_substring(column, text, ignore_case)
    return _or_null(~test, F.col(column)) if negated else test


def _list_filter(column: Column, value: str, change=lambda s: s) -> Column:
    negated, text = split_negation(value)
    test = column.isin([change(v) for v in _csv(text)])
    return _or_null(~test, column) if negated else test


def by_type(value: str) -> Column:
    return F.col("log_type").isin(_csv(value))


def by_src(value: str) -> Column:
    return _substring_filter("src_ip", value)


def by_dst(value: str) -> Column:
    return _substring_filter("dst_ip", value)


def by_ip(value: str) -> Column:
    negated, _ = split_negation(value)
    src, dst = by_src(value), by_dst(value)
    return (src & dst) if negated else (src | dst)


def by_direction(value: str, vpn_only: bool = False) -> Column:
    wanted = _csv(value)
    if vpn_only and "vpn" not in wanted:
        wanted.append("vpn")
    return F.col("direction").isin(wanted)


def by_action(value: str) -> Column:
    """Action list in which ``unknown`` stands for NULL."""
    negated, text = split_negation(value)
    wanted = _csv(text)
    known = [a for a in wanted if a != "unknown"]
    unknown = "unknown" in wanted
    action = F.col("rule_action")
    if not negated:
        tests = ([action.isin(known)] if known else []) + ([action.isNull()] if unknown else [])
        return reduce(lambda a, b: a | b, tests)
    if unknown:
        return action.isNotNull() & ~action.isin(known) if known else action.isNotNull()
    return _or_null(~action.isin(known), action)


def by_rule(value: str) -> Column:
    """Rule name or description; the description also without the display blank."""
    negated, text = split_negation(value)
    stored = text.replace("] ", "]")
    tests = [
        (F.col("rule_name"), literal_substring("rule_name", text, True)),
        (F.col("rule_desc"), literal_substring("rule_desc", text, True)),
        (F.col("rule_desc"), literal_substring("rule_desc", stored, True)),
    ]
    if negated:
        return reduce(lambda a, b: a & b, [_or_null(~t, c) for c, t in tests])
    return reduce(lambda a, b: a | b, [t for _, t in tests])


def by_country(value: str) -> Column:
    return _list_filter(F.col("geo_country"), value, str.upper)


def min_score(score: int) -> Column:
    return F.col("threat_score") >= score


def by_text(value: str) -> Column:
    """Search in the raw line, which is never NULL."""
    negated, text = split_negation(value)
    test = literal_substring("raw_log", text, True)
    return ~test if negated else test


def by_service(value: str) -> Column:
    return _list_filter(F.col("service_name"), value)


def by_iface(value: str) -> Column:
    wanted = _csv(value)
    return F.col("interface_in").isin(wanted) | F.col("interface_out").isin(wanted)


def by_asn(value: str) -> Column:
    return _substring_filter("asn_name", value, True)


def by_port(column: str, value: str) -> Column | None:
    negated, port = parse_port(value)
    if port is None:
        return None
    column = F.col(column)
    return _or_null(column != port, column) if negated else column == port


def by_protocol(value: str) -> Column:
    return _list_filter(F.lower("protocol"), value, str.lower)


def vpn_only() -> Column:
    return has_vpn_prefix("interface_in") | has_vpn_prefix("interface_out")


@dataclass(frozen=True)
class LogFilter:
    time: TimeWindow = TimeWindow()
    log_type: str | None = None
    src_ip: str | None = None
    dst_ip: str | None = None
    ip: str | None = None
    direction: str | None = None
    rule_action: str | None = None
    rule_name: str | None = None
    country: str | None = None
    threat_min: int | None = None
    search: str | None = None
    service: str | None = None
    interface: str | None = None
    vpn_only: bool = False
    asn: str | None = None
    dst_port: str | None = None
    src_port: str | None = None
    protocol: str | None = None

    def conditions(self) -> list[Column]:
        tests = [
            self.log_type and by_type(self.log_type),
            self.src_ip and by_src(self.src_ip),
            self.dst_ip and by_dst(self.dst_ip),
            self.ip and by_ip(self.ip),
            self.direction and by_direction(self.direction, self.vpn_only),
            self.rule_action and by_action(self.rule_action),
            self.rule_name and by_rule(self.rule_name),
            self.country and by_country(self.country),
            None if self.threat_min is None else min_score(self.threat_min),
            self.search and by_text(self.search),
            self.service and by_service(self.service),
            self.interface and by_iface(self.interface),
            self.asn and by_asn(self.asn),
            by_port("dst_port", self.dst_port) if self.dst_port else None,
            by_port("src_port", self.src_port) if self.src_port else None,
            self.protocol and by_protocol(self.protocol),
            vpn_only() if self.vpn_only else None,
        ]
        return [t for t in tests if isinstance(t, Column)]

    def apply(self, logs: DataFrame, now: str | datetime) -> DataFrame:
        logs = in_window(logs, self.time, now)
        for test in self.conditions():
            logs = logs.where(test)
        return logs


def checked_ip(value: str) -> str:
    """Canonical text of an exact address parameter; raises on anything else."""
    return str(ipaddress.ip_address(value))


def exact(
    src: str | None = None,
    dst: str | None = None,
    interface_in: str | None = None,
    interface_out: str | None = None,
) -> Column:
    """Exact cross-filters of the pair and flow reports."""
    test = F.lit(True)
    if src:
        test = test & (F.col("src_ip") == checked_ip(src))
    if dst:
        test = test & (F.col("dst_ip") == checked_ip(dst))
    if interface_in:
        test = test & (F.col("interface_in") == interface_in)
    if interface_out:
        test = test & (F.col("interface_out") == interface_out)
    return test


def threat_filter(
    min_score: int = 0, max_score: int | None = None, ip: str | None = None, since: str | None = None
) -> Column:
    test = F.col("threat_score") >= min_score
    if max_score is not None:
        test = test & (F.col("threat_score") <= max_score)
    if ip:
        test = test & (F.col("ip") == checked_ip(ip))
    if since:
        test = test & (F.col("looked_up_at") >= ts_lit(_utc_text(datetime.fromisoformat(since))))
    return test


def client_search(text: str) -> Column:
    """Inventory search. Unlike the log search, ``%`` and ``_`` are wildcards."""
    pattern = f"%{text}%"
    return (
        F.col("device_name").ilike(pattern)
        | F.col("hostname").ilike(pattern)
        | F.col("ip").like(pattern)
        | F.col("mac").ilike(pattern)
    )


def normalised_exclusions(ips) -> list[str]:
    """Own addresses in canonical text; what does not parse is dropped."""
    out = []
    for ip in ips:
        try:
            out.append(checked_ip(ip))
        except ValueError:
            continue
    return out


def without_ips(df: DataFrame, column: str, ips) -> DataFrame:
    """Rows whose address, after normalisation, is none of the given ones."""
    excluded = normalised_exclusions(ips)
    if not excluded:
        return df
    return df.where(~F.coalesce(ip_text(column), F.col(column)).isin(excluded))
