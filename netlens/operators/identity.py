"""Who an address is to the site: gateway, own WAN address or VPN peer.

The identity settings are a handful of entries from the site's configuration, so
they become literals of the expression; there is nothing to join.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.config import VPN_PREFIXES, NetConfig
from netlens.functions.ip import ColumnLike, as_col, in_cidr, let, one_of

NAMED = "struct<badge:string,name:string>"
IDENTITY = "struct<name:string,vlan:int,vpn_badge:string>"


def _type_name(interface: str, badge: str) -> str:
    return next((text for prefix, _, text in VPN_PREFIXES if interface.startswith(prefix)), badge)


def vpn_match(ip: ColumnLike, cfg: NetConfig, exclude: tuple[str, ...] = ()) -> Column:
    """struct(badge, name) of the first VPN network that holds the address; the
    network's first address is its gateway."""

    def first_network(address: Column) -> Column:
        found = F.lit(None).cast(NAMED)
        for interface, (cidr, badge) in reversed(list(cfg.vpn_networks.items())):
            try:
                network = ipaddress.ip_network(cidr, strict=False)
            except ValueError:
                continue
            gateway = address == str(network.network_address + 1)
            name = F.when(gateway, "Gateway").otherwise(_type_name(interface, badge))
            peer = F.struct(F.lit(badge).alias("badge"), name.alias("name"))
            if cidr and badge:
                found = F.when(in_cidr(address, str(network)), peer).otherwise(found)
        return found

    ip = as_col(ip)
    if not cfg.vpn_networks:
        return F.lit(None).cast(NAMED)
    return F.when(ip.isNotNull() & ~one_of(ip, exclude), let(ip, first_network)).cast(NAMED)


def _lookup(ip: Column, entries: dict) -> Column:
    pairs = [(k, v) for k, v in entries.items() if v is not None]
    if not pairs:
        return F.lit(None)
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])[ip]


def identity_of(ip: ColumnLike, existing: ColumnLike, cfg: NetConfig) -> Column:
    """struct(name, vlan, vpn_badge). Names: stored, gateway, WAN, VPN; the
    gateway's VLAN is set even where a name exists."""
    ip = as_col(ip)
    known = F.nullif(as_col(existing), F.lit(""))
    is_gateway = one_of(ip, cfg.gateway_vlans)
    wan_name = _lookup(ip, dict(cfg.wan_ip_names)).cast("string")
    name = F.coalesce(known, F.when(is_gateway, F.lit("Gateway")), wan_name)
    vpn = F.when(name.isNull(), vpn_match(ip, cfg, (*cfg.wan_ip_names, *cfg.gateway_vlans)))
    return F.struct(
        F.coalesce(name, vpn["name"]).alias("name"),
        _lookup(ip, dict(cfg.gateway_vlans)).cast("int").alias("vlan"),
        vpn["badge"].alias("vpn_badge"),
    ).cast(IDENTITY)


def annotate_identity(df: DataFrame, cfg: NetConfig) -> DataFrame:
    """Set name, VLAN and network badge of both sides of a record; a side that
    already has a VLAN or a network is left alone."""
    columns = set(df.columns)
    for side in ("src", "dst"):
        name, vlan, net = (f"{side}_device_{what}" for what in ("name", "vlan", "network"))
        for missing, kind in ((name, "string"), (vlan, "int"), (net, "string")):
            if missing not in columns:
                df = df.withColumn(missing, F.lit(None).cast(kind))
        who = identity_of(f"{side}_ip", name, cfg)
        settled = F.col(vlan).isNotNull() | (F.coalesce(F.col(net), F.lit("")) != "")
        df = df.withColumn("_who", F.when(~settled, who)).select(
            *[c for c in df.columns if c not in (name, vlan, net)],
            F.coalesce(F.nullif(F.col(name), F.lit("")), F.col("_who.name"), F.col(name)).alias(name),
            F.coalesce(F.col(vlan), F.col("_who.vlan")).alias(vlan),
            F.coalesce(
                F.nullif(F.col(net), F.lit("")), F.when(F.col("_who.name") == "Gateway", F.col("_who.vpn_badge"))
            ).alias(net),
        )
    return df
