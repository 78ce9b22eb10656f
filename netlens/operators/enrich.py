"""Enrichment of log rows with what is known of their remote address."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.config import ABUSE_DETAILS, NetConfig
from netlens.functions.ip import is_remote
from netlens.operators.dims import resolve_names
from netlens.operators.policy import resolve_action
from netlens.operators.rangejoin import attach_block
from netlens.operators.threats import fresh_rdns, fresh_threats
from netlens.plans.staging import computed, spread_null

Now = str | datetime
GEO = ("geo_country", "geo_city", "geo_lat", "geo_lon")
ASN = ("asn_number", "asn_name")


@dataclass(frozen=True)
class EnrichmentTables:
    """Dimensions of the enrichment; each may be missing. Block tables carry
    start_key, end_key and prefix_len next to their attributes."""

    city_blocks: DataFrame | None = None
    asn_blocks: DataFrame | None = None
    rdns_cache: DataFrame | None = None
    threats: DataFrame | None = None
    ip_names: DataFrame | None = None
    mac_names: DataFrame | None = None
    zone_map: DataFrame | None = None
    policies: DataFrame | None = None


def remote_side(cfg: NetConfig) -> Column:
    """The remote address of a row: the only remote side, the source if both are."""
    own = cfg.own_ips
    return F.when(is_remote("src_ip", own), F.col("src_ip")).when(is_remote("dst_ip", own), F.col("dst_ip"))


def remote_attributes(ips: DataFrame, tables: EnrichmentTables, now: Now) -> DataFrame:
    """One row per distinct remote address with everything the tables know of it:
    the lookups cost per address, not per log row."""
    attributes = ips.select("ip").where(F.col("ip").isNotNull()).distinct()
    for blocks, columns in ((tables.city_blocks, GEO), (tables.asn_blocks, ASN)):
        if blocks is not None:
            present = [c for c in columns if c in blocks.columns]
            attributes = attach_block(attributes, blocks.select("start_key", "end_key", "prefix_len", *present))
    if tables.rdns_cache is not None:
        attributes = attributes.join(fresh_rdns(tables.rdns_cache, now).select("ip", "rdns"), "ip", "left")
    if tables.threats is not None:
        details = ["threat_score", "threat_categories", *ABUSE_DETAILS]
        known = fresh_threats(tables.threats, now).select("ip", F.struct(*details).alias("reputation"))
        attributes = attributes.join(known, "ip", "left")
    return attributes


def enrich(logs: DataFrame, tables: EnrichmentTables, cfg: NetConfig, now: Now) -> DataFrame:
    """Set remote_ip and its geography, AS, reverse name and reputation.

    Reputation goes to blocked firewall rows and, if the site wants it, to rows of
    the DNS resolver (``source``), whose reverse name is never looked up. Adds
    ``reputation_missing``: a block whose address has no usable reputation yet.
    """
    own = cfg.own_ips
    columns = logs.columns
    sides = logs.select("src_ip", "dst_ip")
    for name, kind in (("source", "string"), ("src_device_name", "string"), ("dst_device_name", "string")):
        if name not in columns:
            logs = logs.withColumn(name, F.lit(None).cast(kind))
    if tables.ip_names is not None and tables.mac_names is not None:
        logs = resolve_names(
            logs, tables.ip_names, tables.mac_names, ~is_remote("src_ip", own), ~is_remote("dst_ip", own)
        )
    if tables.zone_map is not None and tables.policies is not None:
        logs = (
            resolve_action(logs, tables.zone_map, tables.policies)
            .withColumn(
                "rule_action",
                F.coalesce(F.when(F.col("log_type") == "firewall", F.col("resolved_action")), F.col("rule_action")),
            )
            .drop("resolved_action", "action_source")
        )
    rows = computed(logs, {"remote_ip": remote_side(cfg)})
    # The distinct addresses come from two columns, before the joins above.
    found = remote_attributes(computed(sides, {"ip": remote_side(cfg)}), tables, now)
    found = found.select(*[F.col(c).alias("_key" if c == "ip" else f"_{c}") for c in found.columns])
    joined = rows.withColumn("_join", spread_null(F.col("remote_ip"), F.col("raw_log"))).join(
        found, F.col("_join") == F.col("_key"), "left"
    )
    from_resolver = F.coalesce(F.col("source") == "dns_resolver", F.lit(False))
    wants_geo = ~from_resolver | F.lit(cfg.dns_enrichment in ("geoip", "both"))
    blocked = (F.col("log_type") == "firewall") & (F.col("rule_action") == "block")
    wants_reputation = F.when(from_resolver, F.lit(cfg.dns_enrichment in ("threat", "both"))).otherwise(
        F.coalesce(blocked, F.lit(False))
    )
    fills: dict[str, Column] = {}
    available = set(found.columns)

    def fill(name: str, value: Column, when: Column) -> None:
        # An attribute that is known replaces the row's value, an unknown one does not.
        stored = [F.col(name)] if name in columns else []
        fills[name] = F.coalesce(F.when(when, value), *stored)

    for name in (*GEO, *ASN):
        if f"_{name}" in available:
            fill(name, F.col(f"_{name}"), wants_geo)
    if "_rdns" in available and cfg.rdns_enabled:
        fill("rdns", F.col("_rdns"), ~from_resolver)
    missing = F.lit(False)
    if "_reputation" in available:
        for name in ("threat_score", "threat_categories", *ABUSE_DETAILS):
            fill(name, F.col(f"_reputation.{name}"), wants_reputation)
        missing = (
            F.col("remote_ip").isNotNull() & wants_reputation & ~from_resolver & F.col("_reputation").isNull()
        )
    fills["reputation_missing"] = missing
    return joined.withColumns(fills).drop("_join", *found.columns)
