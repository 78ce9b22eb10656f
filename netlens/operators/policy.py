"""Firewall zones and policies: which policy wrote a log line.

Logs repeat few (interface in, interface out, rule) combinations, so matching
works on the distinct combinations and its result is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.config import ZONE_CHAINS
from netlens.functions.rules import rule_parse

ZONE_SCHEMA = "id string, name string, networkIds array<string>, metadata struct<origin:string>"
NETWORK_SCHEMA = "id string, name string, interface string, vlan int"
WAN_SCHEMA = "name string, physical_interface string, wan_ip string, active boolean"
VPN_SCHEMA = "interface string, badge string, cidr string"
POLICY_SCHEMA = (
    "id string, name string, source struct<zoneId:string>, destination struct<zoneId:string>,"
    " action struct<type:string>, index bigint, loggingEnabled boolean, enabled boolean,"
    " metadata struct<origin:string>"
)
COMBO = ["interface_in", "interface_out", "rule_name"]


def with_position(spark, rows: list, schema: str) -> DataFrame:
    """Controller payload (a short list) as a DataFrame that keeps its order."""
    fields = spark.createDataFrame([], schema).schema
    typed = spark.createDataFrame([(rows,)], f"items array<struct<{_struct(fields)}>>")
    return typed.select(F.posexplode("items").alias("pos", "item")).select("pos", "item.*")


def _struct(schema) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema)


def zone_map(zones: DataFrame, networks: DataFrame, wans: DataFrame, vpns: DataFrame) -> DataFrame:
    """One row per (zone, interface); a zone without interfaces has one row with a
    NULL interface. Inputs carry ``pos``, their order in the payload.

    Unknown zones are numbered CUSTOM1, CUSTOM2, ... in order; the external zone
    falls back to the WAN interfaces; the VPN zone adds the VPN interfaces.
    """
    zones = zones.where(F.coalesce("id", F.lit("")) != "").withColumn("_name", F.lower(F.coalesce("name", F.lit(""))))
    chain = F.lit(None).cast("string")
    for zone, name in ZONE_CHAINS.items():
        chain = F.when(F.col("_name") == zone, name).otherwise(chain)
    # A site has tens of zones: numbering them in one window is fine.
    custom = F.count_if(chain.isNull()).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    zones = zones.select(
        F.col("id").alias("zone_id"), F.coalesce("name", F.lit("")).alias("zone_name"), "_name",
        F.coalesce(chain, F.concat(F.lit("CUSTOM"), custom)).alias("chain_name"),
        F.coalesce("metadata.origin", F.lit("UNKNOWN")).alias("origin"), "networkIds", F.col("pos").alias("zone_pos"),
    )
    nets = networks.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("interface", F.lit("")) != ""))
    zone_columns = ["zone_id", "zone_name", "_name", "chain_name", "origin", "zone_pos"]
    listed = zones.select(*zone_columns, F.posexplode("networkIds").alias("_i", "_net")).join(
        nets.select(F.col("id").alias("_net"), "interface", F.col("name").alias("network_name"), "vlan"), "_net"
    ).select(*zone_columns, "interface", "network_name", "vlan", F.lit(False).alias("vpn"), F.col("_i"))
    wan_rows = wans.where((F.coalesce("name", F.lit("")) != "") & (F.coalesce("physical_interface", F.lit("")) != ""))
    external = (
        zones.where(F.col("_name") == "external")
        .join(listed.select("zone_id").distinct(), "zone_id", "left_anti")
        .withColumn("_k", F.lit("external"))
        .join(
            wan_rows.select(
                F.lit("external").alias("_k"), F.col("physical_interface").alias("interface"),
                F.col("name").alias("network_name"), F.col("pos").alias("_i"),
            ),
            "_k",
        )
        .select(*zone_columns, "interface", "network_name", F.lit(None).cast("int").alias("vlan"), F.lit(False).alias("vpn"), "_i")
    )
    tunnels = (
        zones.where(F.col("_name") == "vpn")
        .join(
            vpns.select(
                F.lit("vpn").alias("_name"), "interface",
                F.coalesce(F.nullif("badge", F.lit("")), "interface").alias("network_name"),
                (F.col("pos") + 1_000_000).alias("_i"),
            ),
            "_name",
        )
        .select(*zone_columns, "interface", "network_name", F.lit(None).cast("int").alias("vlan"), F.lit(True).alias("vpn"), "_i")
    )
    interfaces = listed.unionByName(external).unionByName(tunnels).select(
        "zone_id", "interface", "network_name", "vlan", "vpn", F.col("_i").alias("iface_pos")
    )
    return zones.select("zone_id", "zone_name", "chain_name", "origin", "zone_pos").join(interfaces, "zone_id", "left")


def _with_zones(combos: DataFrame, zmap: DataFrame) -> DataFrame:
    """Source and target zone of each combination. An empty target interface means
    the gateway; an interface in several zones belongs to the last one."""
    order = F.struct("zone_pos", "iface_pos")
    by_iface = (
        zmap.where(F.col("interface").isNotNull())
        .groupBy("interface")
        .agg(F.max_by(F.struct("zone_id", "zone_name"), order).alias("z"))
    )
    gateway = zmap.where(F.lower("zone_name") == "gateway").agg(
        F.max_by(F.struct("zone_id", "zone_name"), "zone_pos").alias("z")
    )
    src = by_iface.select(F.col("interface").alias("_si"), F.col("z").alias("_src"))
    # The gateway zone answers to the empty interface name.
    dst = by_iface.select(F.col("interface").alias("_di"), F.col("z").alias("_dst")).unionByName(
        gateway.select(F.lit("").alias("_di"), F.col("z").alias("_dst"))
    )
    return (
        combos.join(src, F.col("interface_in") == F.col("_si"), "left")
        .join(dst, F.coalesce("interface_out", F.lit("")) == F.col("_di"), "left")
        .drop("_si", "_di")
    )


def _matches(combos: DataFrame, policies: DataFrame) -> DataFrame:
    dim = policies.select(
        F.col("source.zoneId").alias("_ps"), F.col("destination.zoneId").alias("_pd"), F.col("index").alias("_pi"),
        F.struct(
            "pos", "id", F.coalesce("name", F.lit("")).alias("name"), F.col("action.type").alias("type"),
            F.coalesce("loggingEnabled", F.lit(False)).alias("logging"),
            F.coalesce("metadata.origin", F.lit("")).alias("origin"),
            F.coalesce("enabled", F.lit(True)).alias("enabled"),
        ).alias("_p"),
    )
    on = (
        (F.col("_src.zone_id") == F.col("_ps")) & (F.col("_dst.zone_id") == F.col("_pd"))
        & (F.col("_rule.index") == F.col("_pi"))
    )
    return combos.join(dim, on, "left").drop("_ps", "_pd", "_pi")


def match_combos(combos: DataFrame, zmap: DataFrame, policies: DataFrame) -> DataFrame:
    """Match status and policy of each distinct (interfaces, rule) combination."""
    parsed = combos.withColumn("_rule", rule_parse("rule_name"))
    joined = _matches(_with_zones(parsed, zmap), policies)
    legacy = F.col("_rule.format") == "legacy"
    code = F.col("_rule.action_code")
    expected = F.when(legacy & (code == "A"), "ALLOW").when(legacy & code.isin("B", "D"), "BLOCK")
    hit = F.col("_p").isNotNull() & F.coalesce(F.col("_p.type") == expected, expected.isNull())
    controllable = hit & (F.col("_p.origin") != "DERIVED") & F.col("_p.enabled")

    def first(test: Column) -> Column:
        return F.min(F.when(test, F.col("_p")))

    grouped = joined.groupBy(*COMBO).agg(
        F.any_value("_rule").alias("_rule"), F.any_value("_src").alias("_src"), F.any_value("_dst").alias("_dst"),
        F.count_if(hit).alias("_hits"), F.count_if(controllable).alias("_free"),
        first(hit).alias("_first"), first(controllable).alias("_match"),
    )
    unsupported = (
        F.col("_rule").isNull() | (F.col("_rule.format") == "redirect")
        | F.coalesce(F.col("_rule.action_code") == "R", F.lit(False))
    )
    status = (
        F.when(unsupported, "unsupported")
        .when(F.col("_src.zone_id").isNull() | F.col("_dst.zone_id").isNull(), "unmatched")
        .when(F.col("_hits") == 0, "unmatched")
        .when(F.col("_free") == 0, "uncontrollable")
        .when(F.col("_free") > 1, "ambiguous")
        .otherwise("matched")
    )
    message = (
        F.when(F.col("_rule").isNull(), "rule name not understood")
        .when(F.col("_rule.format") == "redirect", "redirect rules have no policy")
        .when(unsupported, "reject rules are not matched")
        .when(F.col("_src.zone_id").isNull(), F.concat(F.lit("unknown source interface: "), F.coalesce("interface_in", F.lit(""))))
        .when(F.col("_dst.zone_id").isNull(), F.concat(F.lit("unknown destination interface: "), F.coalesce(F.nullif("interface_out", F.lit("")), F.lit("(empty)"))))
        .when(F.col("_hits") == 0, "no matching policy")
        .when((F.col("_free") == 0) & (F.col("_first.origin") == "DERIVED"), "generated rule, cannot be changed")
        .when(F.col("_free") == 0, "disabled rule, cannot be toggled")
        .when(F.col("_free") > 1, "several matching policies")
    )
    policy = F.when(F.col("status") == "matched", F.col("_match")).when(
        F.col("status") == "uncontrollable", F.col("_first")
    )
    matched = F.col("status") == "matched"
    return (
        grouped.withColumn("status", status).withColumn("message", message).withColumn("_policy", policy).select(
            *COMBO, "status", "message",
            F.col("_policy.id").alias("policy_id"), F.col("_policy.name").alias("policy_name"),
            F.when(matched, F.nullif(F.lower("_policy.type"), F.lit(""))).alias("policy_action"),
            F.when(matched, F.col("_policy.logging")).alias("policy_logging"),
            F.when(matched, F.col("_policy.origin")).alias("policy_origin"),
            F.when(matched, F.col("_src.zone_name")).alias("src_zone"),
            F.when(matched, F.col("_dst.zone_name")).alias("dst_zone"),
        )
    )


def _join_back(logs: DataFrame, combos: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe join of per-combination results to the logs."""
    renamed = combos.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in combos.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    test = on[0]
    for t in on[1:]:
        test = test & t
    return logs.join(renamed, test, "left").drop(*[f"_k_{c}" for c in keys])


def match_policy(logs: DataFrame, zmap: DataFrame, policies: DataFrame) -> DataFrame:
    """Logs with the policy that wrote them."""
    return _join_back(logs, match_combos(logs.select(*COMBO).distinct(), zmap, policies), COMBO)


def resolve_action(logs: DataFrame, zmap: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds ``resolved_action`` and ``action_source`` for rules of the zone-index
    form: the first policy of the zone pair and index that allows or blocks, else
    the word in the description. NULL for every other rule."""
    keys = [*COMBO, "rule_desc"]
    combos = (
        logs.select(*keys).distinct().withColumn("_rule", rule_parse("rule_name", "rule_desc"))
        .where(F.col("_rule.format") == "zone_index")
    )
    joined = _matches(_with_zones(combos, zmap), policies)
    decides = F.lower("_p.type").isin("allow", "block")
    resolved = (
        joined.groupBy(*keys)
        .agg(F.min(F.when(decides, F.col("_p"))).alias("_first"), F.any_value("_rule").alias("_rule"))
        .select(
            *keys,
            F.coalesce(F.lower("_first.type"), "_rule.desc_hint").alias("resolved_action"),
            F.when(F.col("_first").isNotNull(), "policy_lookup")
            .when(F.col("_rule.desc_hint").isNotNull(), "rule_desc").alias("action_source"),
        )
    )
    return _join_back(logs, resolved, keys)
