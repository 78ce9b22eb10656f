"""Flow graph and host profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.contract.aggregates import who
from netlens.contract.common import CFG, FIREWALL, LATEST_DEVICE, LC, MONTH, NOW, SINCE_MONTH, stamp, stamp_sql
from netlens.contract.registry import query
from netlens.functions.scalars import FLOW_DIMENSIONS, flow_dim
from netlens.operators import flows
from netlens.operators.filters import LogFilter

HOST = "192.168.10.22"
ROWS = f"{SINCE_MONTH} AND log_type = 'firewall' AND src_ip IS NOT NULL AND dst_ip IS NOT NULL"
GROUPS = f"""SELECT src_ip AS a, coalesce(CAST(dst_port AS VARCHAR), 'Unknown') AS b, dst_ip AS c, count(*) AS value
 FROM logs WHERE {ROWS} GROUP BY 1, 2, 3"""
DIMS2 = ("direction", "service_name", "interface_in")
GROUPS2 = f"""SELECT coalesce(direction, 'unknown') AS a, coalesce(service_name, 'Unknown') AS b,
 coalesce(interface_in, 'unknown') AS c, count(*) AS value FROM logs WHERE {ROWS} GROUP BY 1, 2, 3"""

_DIM_SQL = {
    "src_ip": "src_ip", "dst_ip": "dst_ip", "dst_port": "coalesce(CAST(dst_port AS VARCHAR), 'Unknown')",
    "protocol": "coalesce(lower(protocol), 'unknown')", "service_name": "coalesce(service_name, 'Unknown')",
    "direction": "coalesce(direction, 'unknown')", "interface_in": "coalesce(interface_in, 'unknown')",
    "interface_out": "coalesce(interface_out, 'unknown')",
}


@query(
    "d3_flow_dimensions", "logs",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dim, {_DIM_SQL[d]} AS key, count(*) AS n FROM logs GROUP BY 2" for d in FLOW_DIMENSIONS
    ),
)
def dimensions(t):
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), flow_dim(d).alias("key")) for d in FLOW_DIMENSIONS])
    rows = t.logs.select(F.explode(pairs).alias("d")).select("d.*")
    return rows.groupBy("dim", "key").agg(F.count(F.lit(1)).alias("n"))


@query("f23_flow_groups", "logs", GROUPS)
def groups(t):
    return flows.flow_groups(t.logs, FIREWALL, NOW)


@query("f23_flow_groups_host", "logs", GROUPS.replace("GROUP BY", f"AND (src_ip = '{HOST}' OR dst_ip = '{HOST}') GROUP BY"))
def host_groups(t):
    return flows.flow_groups(t.logs, FIREWALL, NOW, ip=HOST)


def _tops(n: str) -> str:
    return ", ".join(
        f"""r{d} AS (SELECT {d} AS k, row_number() OVER (ORDER BY sum(value) DESC, {d}) AS r FROM g GROUP BY {d})""" for d in "abc"
    )


def _remapped(n: str) -> str:
    return f"""SELECT {', '.join(f"CASE WHEN r{d}.r <= {n} THEN g.{d} ELSE 'Other' END AS {d}" for d in 'abc')},
    CAST(sum(value) AS BIGINT) AS value FROM g JOIN ra ON ra.k = g.a JOIN rb ON rb.k = g.b JOIN rc ON rc.k = g.c"""


def _top_sql(groups_sql: str, n: int) -> str:
    return f"WITH g AS ({groups_sql}), {_tops('')}, m AS ({_remapped(str(n))} GROUP BY 1, 2, 3)"


@query("g4_top_n_other", "logs", f"{_top_sql(GROUPS, 5)} SELECT * FROM m")
def top_n(t):
    return flows.top_n_other(flows.flow_groups(t.logs, FIREWALL, NOW), 5)


def _adaptive_sql(n: int) -> str:
    """Every N from 13 up, the links of each, and the largest that fits."""
    return f"""WITH g AS ({GROUPS}), {_tops('')}, ns AS (SELECT unnest(range(13, {n + 1})) AS n),
    m AS (SELECT ns.n, {', '.join(f"CASE WHEN r{d}.r <= ns.n THEN g.{d} ELSE 'Other' END AS {d}" for d in 'abc')},
     CAST(sum(value) AS BIGINT) AS value FROM g JOIN ra ON ra.k = g.a JOIN rb ON rb.k = g.b JOIN rc ON rc.k = g.c, ns
     GROUP BY 1, 2, 3, 4),
    l AS (SELECT n, count(*) AS links FROM (SELECT DISTINCT n, 1 AS layer, a AS s, b AS t FROM m
     UNION ALL SELECT DISTINCT n, 2, b, c FROM m) q GROUP BY n),
    best AS (SELECT max(n) AS n FROM l WHERE links <= 400 OR n = 13)
    SELECT a, b, c, value, CAST(m.n AS INT) AS applied_top_n, {n} AS requested_top_n, m.n <> {n} AS capped
    FROM m JOIN best ON best.n = m.n"""


@query("g5_adaptive_top_n", "logs", _adaptive_sql(50))
def adaptive(t):
    out = flows.adaptive_top_n(flows.flow_groups(t.logs, FIREWALL, NOW), 50)
    return out.withColumn("applied_top_n", F.col("applied_top_n").cast("int"))


@query(
    "f24_sankey_nodes", "logs",
    f"""{_top_sql(GROUPS, 10)}, n AS (SELECT 'src_ip' AS type, a AS label, value FROM m UNION ALL SELECT 'dst_port', b, value FROM m
    UNION ALL SELECT 'dst_ip', c, value FROM m)
    SELECT type, label, CAST(sum(value) AS BIGINT) AS value, type || ':' || label AS id FROM n GROUP BY 1, 2""",
)
def nodes(t):
    return flows.sankey_nodes(flows.top_n_other(flows.flow_groups(t.logs, FIREWALL, NOW), 10))


@query(
    "f24_sankey_links", "logs",
    f"""{_top_sql(GROUPS2, 6)}, l AS (SELECT 'direction:' || a AS source, 'service_name:' || b AS target, value FROM m
    UNION ALL SELECT 'service_name:' || b, 'interface_in:' || c, value FROM m)
    SELECT source, target, CAST(sum(value) AS BIGINT) AS value FROM l GROUP BY 1, 2""",
)
def links(t):
    return flows.sankey_links(flows.top_n_other(flows.flow_groups(t.logs, FIREWALL, NOW, DIMS2), 6), DIMS2)


@query(
    "g2_node_identity", "logs clients devices",
    f"""{_top_sql(GROUPS, 50)}, ips AS (SELECT DISTINCT ip FROM (SELECT a AS ip FROM m UNION ALL SELECT c FROM m) q WHERE ip <> 'Other'),
    lc AS ({LC}), ld AS ({LATEST_DEVICE})
    SELECT ips.ip, coalesce(lc.name, ld.name, {who('ips.ip')}) AS device_name,
     coalesce(CASE ips.ip WHEN '192.168.10.2' THEN 10 WHEN '192.168.99.2' THEN 99 END, lc.vlan) AS vlan
    FROM ips LEFT JOIN lc ON lc.ip = ips.ip LEFT JOIN ld ON ld.ip = ips.ip""",
)
def identity(t):
    shown = flows.top_n_other(flows.flow_groups(t.logs, FIREWALL, NOW), 50)
    return flows.node_identity(flows.sankey_nodes(shown), t.clients, t.devices, CFG).drop("vpn_badge")


HOST_FLT = LogFilter(time=MONTH)
_HOST = f"{SINCE_MONTH} AND (src_ip = '{HOST}' OR dst_ip = '{HOST}')"


@query(
    "f27_host_summary", "logs",
    f"""SELECT count(*) AS total_events, count(*) FILTER (WHERE rule_action = 'allow') AS allow_count,
    count(*) FILTER (WHERE rule_action = 'block') AS block_count,
    count(DISTINCT CASE WHEN src_ip = '{HOST}' THEN dst_ip ELSE src_ip END) AS unique_peers,
    {stamp_sql('min(timestamp)')} AS first_seen, {stamp_sql('max(timestamp)')} AS last_seen,
    max(asn_name) AS asn_name, max(rdns) AS rdns FROM logs WHERE {_HOST}""",
)
def summary(t):
    out = flows.host_summary(t.logs, HOST_FLT, NOW, HOST)
    return out.withColumn("first_seen", stamp("first_seen")).withColumn("last_seen", stamp("last_seen"))


@query(
    "f27_host_device", "clients",
    f"SELECT ip, name AS device_name, network, vlan, mac FROM ({LC}) lc WHERE ip = '{HOST}'",
)
def device(t):
    return flows.host_device(HOST, t.clients, t.devices)


def _peers(side: str) -> str:
    own, peer = ("src_ip", "dst_ip") if side == "src" else ("dst_ip", "src_ip")
    return f"""WITH lc AS ({LC}), ld AS ({LATEST_DEVICE}), top AS (SELECT {peer} AS peer_ip, count(*) AS count,
     count(*) FILTER (WHERE rule_action = 'allow') AS allow_count, count(*) FILTER (WHERE rule_action = 'block') AS block_count,
     max(asn_name) AS asn_name, max(rdns) AS rdns FROM logs WHERE {SINCE_MONTH} AND {own} = '{HOST}' AND {peer} IS NOT NULL
     GROUP BY 1 ORDER BY count DESC, peer_ip LIMIT 10)
    SELECT top.*, coalesce(lc.name, ld.name) AS device_name FROM top LEFT JOIN lc ON lc.ip = peer_ip LEFT JOIN ld ON ld.ip = peer_ip"""


for _side in ("src", "dst"):

    @query(f"f28_peers_as_{_side}", "logs clients devices", _peers(_side))
    def peers(t, side=_side):
        return flows.host_peers(t.logs, t.clients, t.devices, HOST_FLT, NOW, HOST, side)


@query(
    "e6_peer_names", "logs clients devices",
    f"""WITH lc AS ({LC}), ld AS ({LATEST_DEVICE}), ips AS (SELECT DISTINCT dst_ip AS ip FROM logs WHERE dst_ip IS NOT NULL)
    SELECT ips.ip, coalesce(lc.name, ld.name) AS device_name FROM ips LEFT JOIN lc ON lc.ip = ips.ip LEFT JOIN ld ON ld.ip = ips.ip""",
)
def names(t):
    peers_ = t.logs.where(F.col("dst_ip").isNotNull()).select(F.col("dst_ip").alias("peer_ip"))
    return flows.peer_names(peers_, t.clients, t.devices)


@query(
    "f29_host_ports", "logs",
    f"""SELECT dst_port, coalesce(service_name, 'Unknown') AS service_name, coalesce(lower(protocol), 'unknown') AS protocol, count FROM
    (SELECT dst_port, service_name, protocol, count(*) AS count FROM logs WHERE {_HOST} AND dst_port IS NOT NULL GROUP BY 1, 2, 3
     ORDER BY count DESC, dst_port, service_name NULLS LAST, protocol NULLS LAST LIMIT 15) q""",
)
def ports(t):
    return flows.host_ports(t.logs, HOST_FLT, NOW, HOST)
