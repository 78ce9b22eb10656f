"""Zones, policies and the parser's checks.

Zones come from the regions, networks and tunnels from the nations and policies from
the customers, so their number grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.contract.registry import query
from netlens.functions.ip import is_bcast_or_mcast, valid_ip
from netlens.functions.scalars import redact, report_summary
from netlens.operators import policy as pol
from netlens.plans.maintenance import backfill_actions
from netlens.plans.parse import source_mac, valid_mac

_ZONES = """SELECT r_regionkey AS pos, 'z' || CAST(r_regionkey AS STRING) AS id,
 CASE r_regionkey WHEN 0 THEN 'Internal' WHEN 1 THEN 'External' WHEN 2 THEN 'Gateway' WHEN 3 THEN 'Vpn' ELSE 'IoT' END AS name,
 CASE WHEN r_regionkey < 4 THEN 'SYSTEM' END AS origin FROM {region}"""
_NETWORKS = """SELECT n_nationkey AS pos, 'n' || CAST(n_nationkey AS STRING) AS id, n_name AS name,
 CASE WHEN n_nationkey < 4 THEN 'br' || CAST(10 * (n_nationkey + 1) AS STRING) WHEN n_nationkey = 4 THEN 'br99' END AS interface,
 CAST(10 * (n_nationkey + 1) AS INT) AS vlan FROM {nation}"""
_POLICIES = """SELECT c_custkey AS pos, 'p' || CAST(c_custkey AS STRING) AS id, c_name AS name,
 CASE WHEN c_custkey % 5 = 0 THEN 'z1' ELSE 'z0' END AS src,
 CASE c_custkey % 5 WHEN 0 THEN 'z0' WHEN 1 THEN 'z1' WHEN 2 THEN 'z3' WHEN 3 THEN 'z4' ELSE 'z2' END AS dst,
 CASE c_custkey % 3 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'BLOCK' ELSE 'REJECT' END AS type,
 CASE WHEN c_custkey % 4 < 2 THEN 4000000000 ELSE 0 END + c_custkey % 280 AS idx,
 c_custkey % 7 <> 0 AS enabled, CASE WHEN c_custkey % 11 = 0 THEN 'DERIVED' ELSE 'USER' END AS origin FROM {customer}"""


def _table(t, text: str, name: str) -> DataFrame:
    return t.spark.sql(text, **{name: t.base(name)})


def _zone_map(t) -> DataFrame:
    zones = _table(t, _ZONES, "region").select(
        "pos", "id", "name", F.struct("origin").alias("metadata"),
        F.when(F.col("pos") == 0, F.array(*[F.lit(f"n{k}") for k in range(4)]))
        .when(F.col("pos") == 4, F.array(F.lit("n4"), F.lit("n9"))).alias("networkIds"),
    )
    networks = _table(t, _NETWORKS, "nation")
    wans = networks.where("pos = 6").select("pos", "name", F.lit("ppp0").alias("physical_interface"))
    vpns = networks.where("pos = 7").select("pos", F.lit("wgsrv1").alias("interface"), F.lit("WG").alias("badge"))
    return pol.zone_map(zones, networks, wans, vpns)


def _policies(t) -> DataFrame:
    return _table(t, _POLICIES, "customer").select(
        "pos", "id", "name", F.struct(F.col("src").alias("zoneId")).alias("source"),
        F.struct(F.col("dst").alias("zoneId")).alias("destination"), F.struct("type").alias("action"),
        F.col("idx").alias("index"), F.lit(True).alias("loggingEnabled"), "enabled", F.struct("origin").alias("metadata"),
    )


@query(
    "e11_zone_map", "",
    f"""WITH n AS ({_NETWORKS.format(nation='nation')}), z AS ({_ZONES.format(region='region')})
    SELECT z.id AS zone_id, CASE z.pos WHEN 0 THEN 'LAN' WHEN 1 THEN 'WAN' WHEN 2 THEN 'LOCAL' WHEN 3 THEN 'VPN' ELSE 'CUSTOM1' END AS chain_name,
     coalesce(z.origin, 'UNKNOWN') AS origin,
     CASE z.pos WHEN 1 THEN 'ppp0' WHEN 3 THEN 'wgsrv1' ELSE n.interface END AS interface,
     CASE z.pos WHEN 3 THEN 'WG' ELSE n.name END AS network_name, CASE WHEN z.pos IN (0, 4) THEN n.vlan END AS vlan
    FROM z LEFT JOIN n ON (z.pos = 0 AND n.pos < 4) OR (z.pos = 4 AND n.pos = 4) OR (z.pos = 1 AND n.pos = 6)""",
)
def zones(t):
    return _zone_map(t).select("zone_id", "chain_name", "origin", "interface", "network_name", "vlan")


def _zone(column: str) -> str:
    return (
        f"CASE WHEN {column} IN ('br10', 'br20', 'br30', 'br40') THEN 'z0' WHEN {column} = 'ppp0' THEN 'z1'"
        f" WHEN {column} = 'wgsrv1' THEN 'z3' WHEN {column} = 'br99' THEN 'z4' END"
    )


_RULES = f"""p AS ({_POLICIES.format(customer='customer')}),
 r AS (SELECT *, {_zone('interface_in')} AS sz, CASE WHEN coalesce(interface_out, '') = '' THEN 'z2' ELSE {_zone('interface_out')} END AS dz,
   CASE WHEN rule_name IS NULL OR rule_name LIKE 'PREROUTING%' THEN 'none' WHEN rule_name LIKE '%-A-%' THEN 'ALLOW'
     WHEN rule_name LIKE '%-B-%' THEN 'BLOCK' ELSE 'index' END AS form,
   CAST(regexp_extract(rule_name, '([0-9]+)$', 1) AS BIGINT) AS idx FROM logs)"""


@query(
    "e12_match_policy", "logs",
    f"""WITH {_RULES},
    h AS (SELECT r.id, r.form, r.sz, r.dz, p.pos, p.id AS policy, p.origin <> 'DERIVED' AND p.enabled AS free
      FROM r LEFT JOIN p ON r.sz = p.src AND r.dz = p.dst AND r.idx = p.idx AND (r.form = 'index' OR r.form = p.type)),
    g AS (SELECT id, form, sz, dz, count(pos) AS hits, count(*) FILTER (free) AS free_hits,
       arg_min(policy, pos) AS first_hit, arg_min(policy, pos) FILTER (free) AS first_free FROM h GROUP BY ALL),
    s AS (SELECT *, CASE WHEN form = 'none' THEN 'unsupported' WHEN sz IS NULL OR dz IS NULL OR hits = 0 THEN 'unmatched'
       WHEN free_hits = 0 THEN 'uncontrollable' WHEN free_hits > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM g)
    SELECT status, CASE status WHEN 'matched' THEN first_free WHEN 'uncontrollable' THEN first_hit END AS policy_id,
     count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM s GROUP BY 1, 2""",
)
def matches(t):
    found = pol.match_policy(t.logs, _zone_map(t), _policies(t))
    return found.groupBy("status", "policy_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


_RESOLVED = f"""{_RULES},
 d AS (SELECT r.id, arg_min(lower(p.type), p.pos) AS resolved FROM r JOIN p ON r.sz = p.src AND r.dz = p.dst AND r.idx = p.idx
   WHERE r.form = 'index' AND p.type IN ('ALLOW', 'BLOCK') GROUP BY r.id)"""


@query(
    "e13_resolve_action", "logs",
    f"""WITH {_RESOLVED}
    SELECT d.resolved AS resolved_action, CASE WHEN d.resolved IS NOT NULL THEN 'policy_lookup' END AS action_source,
     count(*) AS n, CAST(sum(logs.id) AS BIGINT) AS id_sum FROM logs LEFT JOIN d ON d.id = logs.id GROUP BY 1, 2""",
)
def resolved(t):
    found = pol.resolve_action(t.logs, _zone_map(t), _policies(t))
    return found.groupBy("resolved_action", "action_source").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query(
    "j13_backfill_actions", "logs",
    f"""WITH {_RESOLVED}
    SELECT logs.id, coalesce(d.resolved, logs.rule_action) AS rule_action FROM logs LEFT JOIN d ON d.id = logs.id""",
)
def backfilled(t):
    return backfill_actions(t.logs, _zone_map(t), _policies(t)).select("id", "rule_action")


_TEXTS = """SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN '10.0.' || CAST(c_custkey % 256 AS STRING) || '.7'
 WHEN 1 THEN '10.0.0.300' WHEN 2 THEN '2001:DB8:0:0::' || CAST(c_custkey % 10 AS STRING) WHEN 3 THEN 'host' WHEN 4 THEN '224.0.0.251'
 WHEN 5 THEN '255.255.255.255' END AS ip,
 CASE c_custkey % 3 WHEN 0 THEN 'AA:BB:CC:00:00:' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') WHEN 1 THEN 'aa-bb-cc-00-00-01'
  ELSE 'aa:bb:cc' END AS mac,
 CASE WHEN c_custkey % 4 = 0 THEN 'aa:bb' ELSE '11:22:33:44:55:66:aa:bb:cc:dd:ee:' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || ':08:00' END AS field,
 c_name AS name FROM {customer}"""
_TEXTS_SQL = _TEXTS.format(customer="customer")


@query(
    "b10_valid_ip", "",
    f"""SELECT k, CASE WHEN k % 7 IN (0, 4, 5) THEN ip WHEN k % 7 = 2 THEN CASE WHEN k % 10 = 0 THEN '2001:db8::' ELSE '2001:db8::' || CAST(k % 10 AS VARCHAR) END END AS ip
    FROM ({_TEXTS_SQL}) q""",
)
def valid_ips(t):
    return _table(t, _TEXTS, "customer").select("k", valid_ip("ip").alias("ip"))


@query("b11_valid_mac", "", f"SELECT k, CASE WHEN k % 3 = 0 THEN lower(mac) END AS mac FROM ({_TEXTS_SQL}) q")
def valid_macs(t):
    return _table(t, _TEXTS, "customer").select("k", valid_mac("mac").alias("mac"))


@query("b16_broadcast_or_multicast", "", f"SELECT k, k % 7 IN (4, 5) AS hit FROM ({_TEXTS_SQL}) q")
def broadcasts(t):
    return _table(t, _TEXTS, "customer").select("k", is_bcast_or_mcast("ip").alias("hit"))


@query("b5_source_mac", "", f"SELECT k, CASE WHEN k % 4 = 0 THEN field ELSE substr(field, 19, 17) END AS mac FROM ({_TEXTS_SQL}) q")
def source_macs(t):
    return _table(t, _TEXTS, "customer").select("k", source_mac("field").alias("mac"))


@query("d21_redact", "", f"SELECT k, '***' AS api_key, name AS label FROM ({_TEXTS_SQL}) q")
def redacted(t):
    params = F.create_map(F.lit("My_API_KEY"), F.col("field"), F.lit("label"), F.col("name"))
    masked = _table(t, _TEXTS, "customer").select("k", redact(params).alias("m"))
    return masked.select("k", F.col("m.My_API_KEY").alias("api_key"), F.col("m.label").alias("label"))


@query(
    "d26_report_summary", "",
    f"""SELECT k, CASE WHEN k % 2 = 0 THEN '14,18' ELSE '18,' || CAST(20 + k % 4 AS VARCHAR) END AS categories, name || ', x' AS hostnames
    FROM ({_TEXTS_SQL}) q""",
)
def reported(t):
    codes = F.when(F.col("k") % 2 == 0, F.array(F.lit(14), F.lit(18))).otherwise(F.array((F.lit(20) + F.col("k") % 4).cast("int")))
    reports = F.array(F.struct(F.array(F.lit(18)).alias("categories")), F.struct(codes.alias("categories")))
    found = _table(t, _TEXTS, "customer").select("k", report_summary(reports, F.array(F.col("name"), F.lit("x"))).alias("r"))
    return found.select("k", F.array_join("r.categories", ",").alias("categories"), "r.hostnames")
