"""Grouped reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.contract.common import ALL, CFG, FIREWALL, LATEST_DEVICE, LC, NOW, SINCE_MONTH, WEEK, number
from netlens.contract.registry import query
from netlens.functions.ip import cidr_of
from netlens.operators import aggregate as agg
from netlens.operators import flows, stats
from netlens.functions.scalars import with_share

PAIRS = """src_ip IS NOT NULL AND dst_ip IS NOT NULL AND dst_port IS NOT NULL AND protocol IS NOT NULL"""
# Identity of an address without a known name: gateway, WAN name, then VPN.
WHO = """CASE WHEN {ip} IN ('192.168.10.2', '192.168.99.2', '192.168.20.7') THEN 'Gateway'
 WHEN {ip} = '45.1.0.2' THEN 'WAN uplink' WHEN {ip} = '45.2.0.103' THEN 'WAN backup'
 WHEN {num} BETWEEN 3232260864 AND 3232260879 THEN CASE WHEN {ip} = '192.168.99.1' THEN 'Gateway' ELSE 'WireGuard Server' END
 WHEN {num} BETWEEN 3232260864 AND 3232261119 THEN 'OpenVPN / Tunnel 1' END"""
VLAN = "CASE {ip} WHEN '192.168.10.2' THEN 10 WHEN '192.168.99.2' THEN 99 END"


def who(ip: str) -> str:
    return WHO.format(ip=ip, num=number(ip))


@query(
    "f19_ip_pairs", "logs clients devices",
    f"""WITH lc AS ({LC}), ld AS ({LATEST_DEVICE}), p AS (
     SELECT src_ip, dst_ip, dst_port, lower(protocol) AS protocol, max(service_name) AS service_name, count(*) AS total_count,
      count(*) FILTER (WHERE rule_action = 'allow') AS allow_count, count(*) FILTER (WHERE rule_action = 'block') AS block_count,
      max(threat_score) AS max_threat_score, max(asn_name) AS asn_name, max(direction) AS direction
     FROM logs WHERE {SINCE_MONTH} AND log_type = 'firewall' AND {PAIRS} GROUP BY 1, 2, 3, 4
     ORDER BY total_count DESC, src_ip, dst_ip, dst_port, protocol LIMIT 100)
    SELECT p.*, coalesce(c1.name, d1.name, {who('p.src_ip')}) AS src_device_name,
     coalesce(c2.name, d2.name, {who('p.dst_ip')}) AS dst_device_name,
     {VLAN.format(ip='p.src_ip')} AS src_device_vlan, {VLAN.format(ip='p.dst_ip')} AS dst_device_vlan
    FROM p LEFT JOIN lc c1 ON c1.ip = p.src_ip LEFT JOIN ld d1 ON d1.ip = p.src_ip
     LEFT JOIN lc c2 ON c2.ip = p.dst_ip LEFT JOIN ld d2 ON d2.ip = p.dst_ip""",
)
def ip_pairs(t):
    return agg.ip_pairs(t.logs, t.clients, t.devices, FIREWALL, NOW, CFG, k=100).drop(
        "src_device_network", "dst_device_network"
    )


MODAL = f"""WITH s AS (SELECT src_ip, dst_ip, dst_port, lower(protocol) AS protocol, service_name, count(*) AS n,
  count(*) FILTER (WHERE rule_action = 'allow') AS a, count(*) FILTER (WHERE rule_action = 'block') AS b
  FROM logs WHERE {SINCE_MONTH} AND log_type = 'firewall' AND {PAIRS} GROUP BY 1, 2, 3, 4, 5),
 r AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol
   ORDER BY CASE WHEN service_name IS NULL THEN 1 ELSE 0 END, n DESC, service_name) AS rn FROM s),
 x AS (SELECT src_ip AS source_ip, dst_ip AS destination_ip, dst_port AS port, protocol,
   max(CASE WHEN rn = 1 THEN service_name END) AS service, CAST(sum(a) AS BIGINT) AS allow_count,
   CAST(sum(b) AS BIGINT) AS block_count, sum(n) AS total FROM r GROUP BY 1, 2, 3, 4
   ORDER BY total DESC, 1, 2, 3, 4 LIMIT 10000)"""


@query("f22_ip_pairs_modal", "logs", f"{MODAL} SELECT * EXCLUDE (total) FROM x")
def ip_pairs_modal(t):
    return agg.ip_pairs_modal(t.logs, FIREWALL, NOW)


@query(
    "a12_ip_pairs_csv", "logs",
    f"""{MODAL} SELECT source_ip, destination_ip, CAST(port AS VARCHAR) AS port, protocol, coalesce(service, '') AS service,
    CAST(allow_count AS VARCHAR) AS allow_count, CAST(block_count AS VARCHAR) AS block_count FROM x""",
)
def ip_pairs_csv(t):
    return agg.ip_pairs_csv(agg.ip_pairs_modal(t.logs, FIREWALL, NOW))


def _aggregate(name: str, key: str, alias: str, metrics: str, where: str = "", having: str = "", k: int = 100, **kw) -> None:
    sql = f"""SELECT {key} AS {alias}, count(*) AS total {metrics} FROM logs WHERE {SINCE_MONTH} {where} GROUP BY 1 {having}
    ORDER BY total DESC, {alias} NULLS LAST LIMIT {k}"""
    flt = kw.pop("flt", ALL)
    query(name, "logs", sql)(lambda t: agg.aggregate(t.logs, flt, NOW, k=k, **kw))


_SRC = ", count(DISTINCT src_ip) AS unique_src_ips"
_DST = ", count(DISTINCT dst_ip) AS unique_dst_ips"
_aggregate("f20_by_src_ip", "src_ip", "src_ip", _DST, by="src_ip", k=500)
_aggregate("f20_by_dst_ip", "dst_ip", "dst_ip", _SRC, by="dst_ip", k=500)
_aggregate("f20_by_country", "geo_country", "geo_country", _SRC + _DST, by="country")
_aggregate("f20_by_asn", "asn_name", "asn_name", _SRC + _DST, by="asn")
_aggregate("f20_by_rule", "rule_name", "rule_name", _SRC + _DST, by="rule_name")
_aggregate(
    "f20_by_service", "service_name", "service_name", _SRC + _DST, where="AND log_type = 'firewall'",
    by="service", flt=FIREWALL,
)
_aggregate(
    "f20_having", "asn_name", "asn_name", _SRC + _DST, by="asn", min_total=200, min_unique_ips=5,
    having="HAVING count(*) >= 200 AND count(DISTINCT src_ip) >= 5",
)


def _cidr_sql(column: str, prefix: int) -> str:
    size = 1 << (32 - prefix)
    n = f"(CAST(floor({number(column)} / {size}) AS BIGINT) * {size})"
    parts = " || '.' || ".join(f"CAST(CAST(floor({n} / {256 ** i}) AS BIGINT) % 256 AS VARCHAR)" for i in (3, 2, 1, 0))
    return f"CASE WHEN {column} IS NOT NULL THEN {parts} || '/{prefix}' END"


def _rollup(name: str, by: str, prefix: int, having: str = "", **kw) -> None:
    def top(col: str, out: str) -> str:
        return f"""(SELECT {out}_k AS k, v AS {out} FROM (SELECT k AS {out}_k, {col} AS v, row_number() OVER (PARTITION BY k
        ORDER BY count(*) DESC, {col}) AS rn FROM r WHERE {col} IS NOT NULL GROUP BY k, {col}) q WHERE rn = 1)"""

    sql = f"""WITH r AS (SELECT {_cidr_sql(by, prefix)} AS k, src_ip, dst_ip, geo_country, asn_name FROM logs WHERE {SINCE_MONTH}),
    g AS (SELECT k, count(*) AS total, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips
     FROM r GROUP BY k {having})
    SELECT g.k AS {by}_cidr, total, unique_src_ips, unique_dst_ips, top_country, top_asn
    FROM g LEFT JOIN {top('geo_country', 'top_country')} c ON c.k IS NOT DISTINCT FROM g.k
     LEFT JOIN {top('asn_name', 'top_asn')} a ON a.k IS NOT DISTINCT FROM g.k
    ORDER BY total DESC, g.k NULLS LAST LIMIT 500"""
    query(name, "logs", sql)(lambda t: agg.aggregate(t.logs, ALL, NOW, by=by, prefix=prefix, k=500, **kw))


_rollup("f21_cidr8", "src_ip", 8)
_rollup("f21_cidr16", "src_ip", 16)
_rollup("f21_cidr22_dst", "dst_ip", 22)
_rollup(
    "f21_cidr24_having", "src_ip", 24, "HAVING count(*) >= 20 AND count(DISTINCT src_ip) >= 2",
    min_total=20, min_unique_ips=2,
)


@query(
    "d2_cidr", "logs",
    f"SELECT {_cidr_sql('dst_ip', 22)} AS net22, {_cidr_sql('dst_ip', 16)} AS net16, count(*) AS n FROM logs WHERE dst_ip IS NOT NULL GROUP BY 1, 2",
)
def cidr(t):
    rows = t.logs.where(F.col("dst_ip").isNotNull()).select(cidr_of("dst_ip", 22).alias("net22"), cidr_of("dst_ip", 16).alias("net16"))
    return rows.groupBy("net22", "net16").agg(F.count(F.lit(1)).alias("n"))


_MATRIX = f"""SELECT interface_in, interface_out, count(*) AS total,
 count(*) FILTER (WHERE rule_action = 'allow') AS allow_count, count(*) FILTER (WHERE rule_action = 'block') AS block_count,
 count(DISTINCT src_ip || '-' || dst_ip) AS unique_pairs,
 CASE interface_in WHEN 'ppp0' THEN 'Internet' WHEN 'br10' THEN 'Home' WHEN 'wgsrv1' THEN 'Road warriors' ELSE interface_in END AS in_label,
 CASE interface_out WHEN 'ppp0' THEN 'Internet' WHEN 'br10' THEN 'Home' WHEN 'wgsrv1' THEN 'Road warriors' ELSE interface_out END AS out_label
 FROM logs WHERE {SINCE_MONTH} AND log_type = 'firewall' AND interface_in IS NOT NULL AND interface_out IS NOT NULL GROUP BY 1, 2"""


@query("f25_zone_matrix", "logs", _MATRIX)
def zone_matrix(t):
    return flows.zone_matrix(t.logs, FIREWALL, NOW, CFG)


@query(
    "d19_heat_tier", "logs",
    f"""WITH m AS ({_MATRIX}), r AS (SELECT interface_in, interface_out, total,
     log10(total + 1) / log10((max(total) OVER ()) + 1) AS x FROM m)
    SELECT interface_in, interface_out, total, CASE WHEN x < 0.2 THEN 0 WHEN x < 0.4 THEN 1 WHEN x < 0.6 THEN 2
     WHEN x < 0.8 THEN 3 ELSE 4 END AS tier FROM r""",
)
def heat(t):
    cells = flows.with_heat(flows.zone_matrix(t.logs, FIREWALL, NOW))
    return cells.select("interface_in", "interface_out", "total", "tier")


@query(
    "d18_share", "logs",
    """SELECT log_type, count, round(count * 100.0 / sum(count) OVER ()) AS share FROM
    (SELECT log_type, count(*) AS count FROM logs WHERE timestamp >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1) q""",
)
def share(t):
    return with_share(stats.by_type(t.logs, WEEK, NOW), "count")
