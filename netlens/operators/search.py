"""Log search pages, details, value lists and health figures."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.config import ABUSE_DETAILS, NetConfig
from netlens.functions.ip import ip_key, not_own
from netlens.functions.scalars import non_empty, service_display, threat_coalesce, ts_lit
from netlens.operators.dims import join_name_by_mac, join_names_by_ip, join_service
from netlens.operators.filters import LogFilter
from netlens.operators.identity import annotate_identity
from netlens.operators.paging import FEW, page_ids
from netlens.operators.topk import newest, top_k

Now = str | datetime
SORT_COLUMNS = (
    "timestamp", "log_type", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "service_name",
    "direction", "rule_action", "rule_name", "geo_country", "threat_score", "hostname", "created_at",
)


def order_keys(column: str) -> list[Column]:
    """What a column is sorted by."""
    return [F.col(column).contains(":"), ip_key(column)] if column in ("src_ip", "dst_ip") else [F.col(column)]


def sort_order(sort: str, descending: bool, columns: Iterable[str]) -> list[Column]:
    """NULLs come first when descending and last when ascending; addresses sort
    by value (IPv4 before IPv6), and ``id`` makes the order total."""
    column = sort if sort in SORT_COLUMNS and sort in set(columns) else "timestamp"
    keys = order_keys(column)
    ordered = [k.desc_nulls_first() if descending else k.asc_nulls_last() for k in keys]
    return ordered + [F.desc("id") if descending else F.asc("id")]


def search_page(
    logs: DataFrame, flt: LogFilter, now: Now, sort: str = "timestamp", descending: bool = True,
    page: int = 1, size: int = 50, few: int = FEW,
) -> DataFrame:
    """The bare rows of one result page. ``few``: keys one task may sort."""
    if page < 1 or not 1 <= size <= 200:
        raise ValueError("page starts at 1 and size is between 1 and 200")
    rows = flt.apply(logs, now)
    order = sort_order(sort, descending, rows.columns)
    skip = (page - 1) * size
    if descending and (sort == "timestamp" or sort not in SORT_COLUMNS):
        return newest(rows, size, *order, skip=skip)
    # Other orders look for the page by key and id alone, and read whole rows for it only.
    key = sort if sort in SORT_COLUMNS and sort in rows.columns else "timestamp"
    ids = page_ids(rows, key, order_keys(key), skip, size, descending, few)
    return rows.join(F.broadcast(ids), "id", "left_semi").select(*rows.columns).orderBy(*order)


def with_names(page: DataFrame, clients: DataFrame, devices: DataFrame) -> DataFrame:
    """Live device names: source by MAC, target by address."""
    for side in ("src", "dst"):
        if f"{side}_device_name" not in page.columns:
            page = page.withColumn(f"{side}_device_name", F.lit(None).cast("string"))
    page = join_name_by_mac(page, clients, devices, "src_device_name", existing="src_device_name")
    return join_names_by_ip(page, clients, devices, "dst_ip", "dst_device_name", existing="dst_device_name")


def search_logs(
    logs: DataFrame, clients: DataFrame, devices: DataFrame, services: DataFrame, flt: LogFilter, now: Now,
    cfg: NetConfig = NetConfig(), sort: str = "timestamp", descending: bool = True, page: int = 1, size: int = 50,
) -> DataFrame:
    """One page: filter, sort, limit, and only then names, identity, service text."""
    rows = search_page(logs, flt, now, sort, descending, page, size)
    order = sort_order(sort, descending, rows.columns)
    rows = annotate_identity(with_names(rows, clients, devices), cfg)
    # The joins keep no order: the few rows of the page are sorted last.
    return join_service(rows, services).drop("iana_service").orderBy(*order)


def page_count(logs: DataFrame, flt: LogFilter, now: Now, size: int = 50) -> DataFrame:
    return flt.apply(logs, now).agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / size).cast("bigint")
    )


def join_threats_both(logs: DataFrame, threats: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """Reputation of both sides as structs ``_t1`` (source) and ``_t2`` (target);
    own addresses find none."""
    details = [c for c in threats.columns if c != "ip"]
    out = logs
    for alias, side in (("_t1", "src_ip"), ("_t2", "dst_ip")):
        dim = threats.where(not_own("ip", own)).select(
            F.col("ip").alias(f"{alias}_ip"), F.struct("ip", *details).alias(alias)
        )
        out = out.join(dim, F.col(side) == F.col(f"{alias}_ip"), "left").drop(f"{alias}_ip")
    return out


def fill_from_reputation(joined: DataFrame) -> DataFrame:
    """Abuse details and categories of the log, else of the remote side."""
    src_known = F.col("_t1").isNotNull()
    fills = {
        c: threat_coalesce(F.col(c), F.col(f"_t1.{c}"), F.col(f"_t2.{c}"), F.col("direction"), src_known)
        for c in ABUSE_DETAILS
    }
    fills["threat_categories"] = threat_coalesce(
        non_empty("threat_categories"), non_empty("_t1.threat_categories"),
        non_empty("_t2.threat_categories"), F.col("direction"), src_known,
    )
    return joined.withColumns(fills).drop("_t1", "_t2")


def log_detail(
    logs: DataFrame, clients: DataFrame, devices: DataFrame, threats: DataFrame, services: DataFrame,
    ids: list[int], cfg: NetConfig = NetConfig(),
) -> DataFrame:
    """Complete records of up to 50 ids."""
    if not 1 <= len(ids) <= 50:
        raise ValueError("between 1 and 50 ids")
    rows = logs.where(F.col("id").isin(ids))
    rows = fill_from_reputation(join_threats_both(rows, threats, cfg.wan_ips))
    rows = annotate_identity(with_names(rows, clients, devices), cfg)
    return join_service(rows, services).drop("iana_service").orderBy(F.desc("timestamp"), F.desc("id"))


def distinct_recent(logs: DataFrame, column: str, now: Now, hours: int = 36) -> DataFrame:
    """Values of one column in recent rows, as stored and in order."""
    recent = F.col("timestamp") > ts_lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return logs.where(recent & F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def counts_for_types(logs: DataFrame, types: Iterable[str] = ("wifi", "system")) -> DataFrame:
    """One column per log type, zero where there is no row."""
    types = list(types)
    return logs.where(F.col("log_type").isin(types)).agg(
        *[F.count_if(F.col("log_type") == t).alias(t) for t in types]
    )


def count_type(logs: DataFrame, log_type: str = "firewall") -> DataFrame:
    return logs.where(F.col("log_type") == log_type).agg(F.count(F.lit(1)).alias("count"))


def health(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count(F.lit(1)).alias("total"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("latest")
    )


def last_hour_by_type(logs: DataFrame, now: Now) -> DataFrame:
    recent = logs.where(F.col("timestamp") > ts_lit(now) - F.expr("INTERVAL 1 HOUR"))
    return recent.groupBy("log_type").agg(F.count(F.lit(1)).alias("count"))


EXPORT_COLUMNS = (
    "timestamp", "log_type", "direction", "src_ip", "src_port", "dst_ip", "dst_port", "protocol",
    "service_name", "rule_name", "rule_desc", "rule_action", "interface_in", "interface_out",
    "mac_address", "hostname", "dns_query", "dns_type", "dns_answer", "geo_country", "geo_city",
    "asn_name", "threat_score", "threat_categories", "rdns", "abuse_usage_type", "abuse_total_reports",
    "abuse_last_reported", "abuse_is_tor", "remote_ip",
)
EXPORT_NAMES = (
    "src_device_name", "dst_device_name", "src_device_vlan", "dst_device_vlan",
    "src_device_network", "dst_device_network",
)


def export_rows(
    logs: DataFrame, clients: DataFrame, devices: DataFrame, flt: LogFilter, now: Now,
    cfg: NetConfig = NetConfig(), limit: int = 10_000, raw: bool = False,
) -> DataFrame:
    """The newest filtered rows with names, VLANs and badges, typed."""
    if not 1 <= limit <= 100_000:
        raise ValueError("limit must be between 1 and 100000")
    rows = flt.apply(logs, now)
    columns = [*EXPORT_COLUMNS, *(["raw_log"] if raw else [])]
    for c in columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = newest(rows, limit, F.desc("timestamp"), F.desc("id"))
    rows = annotate_identity(with_names(rows, clients, devices), cfg)
    return rows.select("id", *columns, *EXPORT_NAMES).orderBy(F.desc("timestamp"), F.desc("id"))


def display_service(df: DataFrame) -> DataFrame:
    return df.withColumn("service_name", service_display("service_name"))
