"""What the logs tell about the site itself: interfaces, WAN and gateway addresses."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.config import NetConfig
from netlens.functions.ip import is_private_network, is_public_ip_sql, is_wan_candidate_ip
from netlens.functions.rules import has_vpn_prefix
from netlens.functions.scalars import iface_label, iface_type, iface_vlan_id, ts_lit, vpn_badge, vpn_description
from netlens.operators.topk import modal, pick_modal

Now = str | datetime

# Multicast and broadcast targets that are no gateway.
NOT_A_GATEWAY = ("224.0.0.251", "255.255.255.255")


def _firewall() -> Column:
    return F.col("log_type") == "firewall"


def wan_ip_by_iface(logs: DataFrame, ifaces: Iterable[str]) -> DataFrame:
    """Most frequent public target of each WAN interface."""
    rows = logs.where(_firewall() & F.col("interface_in").isin(list(ifaces)) & is_wan_candidate_ip("dst_ip"))
    return modal(rows.withColumnRenamed("interface_in", "iface"), ["iface"], "dst_ip", "wan_ip")


def wan_candidates(logs: DataFrame) -> DataFrame:
    """Interfaces that may face the internet, with their likely own address."""
    iface = F.col("interface_in")
    rows = logs.where(_firewall() & iface.isNotNull() & ~iface.startswith("br") & ~has_vpn_prefix(iface))
    target = F.when(is_wan_candidate_ip("dst_ip"), F.col("dst_ip"))
    counted = rows.groupBy(iface.alias("interface"), target.alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("interface").agg(
        F.sum("n").alias("event_count"), F.coalesce(pick_modal("target", "n"), F.lit("")).alias("wan_ip")
    )


def gateway_ips(logs: DataFrame) -> DataFrame:
    """Private targets of rules that guard the gateway itself."""
    rows = logs.where(
        _firewall() & F.col("rule_name").contains("_LOCAL") & is_private_network("dst_ip")
        & ~F.col("dst_ip").isin(list(NOT_A_GATEWAY))
    )
    return rows.select(F.col("dst_ip").alias("gateway_ip")).distinct()


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.join(b.select(on), on, "left_anti")


def _local_sides(logs: DataFrame) -> DataFrame:
    """(iface, ip) of both sides of a firewall row, local addresses only; one scan."""
    side = F.explode(
        F.array(
            F.struct(F.col("interface_in").alias("iface"), F.col("src_ip").alias("ip")),
            F.struct(F.col("interface_out").alias("iface"), F.col("dst_ip").alias("ip")),
        )
    )
    sides = logs.where(_firewall()).select(side.alias("_s")).select("_s.*")
    return sides.where(F.col("iface").isNotNull() & ~is_public_ip_sql("ip"))


def segment_ips(logs: DataFrame) -> DataFrame:
    """Local addresses seen behind each interface, one row each (iface, ip)."""
    return _local_sides(logs).where(F.col("ip").isNotNull()).distinct()


def segments(logs: DataFrame, wan_list: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Interfaces with a sample address, suggested label and VPN badge.

    The sample is the smallest local address as text. It is a minimum, so the
    addresses of an interface are never gathered. WAN interfaces show their
    public address instead. ``limit`` cuts the list to the first interfaces by name.
    """
    wan_list = wan_list or []
    found = _local_sides(logs).groupBy("iface").agg(F.min("ip").alias("_local"))
    if limit is not None:
        found = found.orderBy("iface").limit(limit)
    is_wan = F.col("iface").isin(wan_list) if wan_list else F.lit(False)
    if wan_list:
        found = found.join(wan_ip_by_iface(logs, wan_list), "iface", "left")
    else:
        found = found.withColumn("wan_ip", F.lit(None).cast("string"))
    is_vpn = has_vpn_prefix("iface") & ~is_wan
    return found.select(
        F.col("iface").alias("interface"),
        F.coalesce(F.when(is_wan, F.col("wan_ip")).otherwise(F.col("_local")), F.lit("")).alias("sample_local_ip"),
        iface_label("iface", wan_list).alias("suggested_label"),
        is_wan.alias("is_wan"),
        F.when(is_vpn, vpn_badge("iface")).alias("suggested_badge"),
        F.when(is_vpn, vpn_description("iface")).alias("prefix_description"),
    )


def recent_ifaces(logs: DataFrame, now: Now, hours: int = 36) -> DataFrame:
    recent = logs.where(_firewall() & (F.col("timestamp") > ts_lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS")))
    names = recent.select(F.explode(F.array("interface_in", "interface_out")).alias("iface"))
    return names.where(F.col("iface").isNotNull() & (F.col("iface") != "")).distinct()


def known_ifaces(logs: DataFrame, now: Now, cfg: NetConfig) -> DataFrame:
    """Configured and discovered interfaces."""
    configured = sorted({*cfg.wan_interfaces, *cfg.interface_labels, *cfg.vpn_networks})
    given = logs.sparkSession.createDataFrame([(i,) for i in configured], "iface string")
    return union_distinct(recent_ifaces(logs, now), given)


def interface_list(logs: DataFrame, now: Now, cfg: NetConfig) -> DataFrame:
    """Every known interface with label, type, VLAN id, badge and description."""
    name = F.col("iface")
    label, badge = name, F.lit(None).cast("string")
    for key, text in cfg.interface_labels.items():
        label = F.when(name == key, text).otherwise(label)
    for key, (_, text) in cfg.vpn_networks.items():
        badge = F.when(name == key, text or None).otherwise(badge)
    kind = iface_type(name, cfg)
    return known_ifaces(logs, now, cfg).select(
        name.alias("name"), label.alias("label"), kind.alias("iface_type"),
        iface_vlan_id(name, cfg).alias("vlan_id"),
        F.when(kind == "vpn", badge).alias("vpn_badge"),
        F.when(kind == "vpn", vpn_description(name)).alias("description"),
    )
