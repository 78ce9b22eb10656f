"""Search, detail, export and discovery queries (H, F30-F38, A4, A11, A14, D10, D11, I2-I4, F40)."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.contract.common import (
    ALL,
    CFG,
    FIREWALL,
    LATEST_DEVICE,
    LC,
    NOW,
    SINCE_MONTH,

    number,
    public,
    stamp,
    stamp_sql,
)
from netlens.contract.registry import query
from netlens.functions.scalars import iface_label
from netlens.operators import discovery, inventory, search
from netlens.operators.audit import audit_page, audit_total, retain_audit
from netlens.plans.reconcile import reconcile_counts
from netlens.sources.sinks import csv_cells

_NAMES = """coalesce(p.src_device_name, c1.device_name, c1.hostname, c1.oui, d1.device_name, d1.model) AS src_device_name,
 coalesce(p.dst_device_name, lc.name, ld.name) AS dst_device_name"""
_NAME_JOINS = """LEFT JOIN clients c1 ON c1.mac = p.mac_address LEFT JOIN devices d1 ON d1.mac = p.mac_address
 LEFT JOIN lc ON lc.ip = p.dst_ip LEFT JOIN ld ON ld.ip = p.dst_ip"""
_DESC = "LEFT JOIN services s ON s.port = p.dst_port AND s.protocol = coalesce(lower(p.protocol), 'tcp')"
NO_IDENTITY = CFG.__class__()


def _page(order: str, limit: int, offset: int, where: str = "") -> str:
    return f"""WITH lc AS ({LC}), ld AS ({LATEST_DEVICE}), p AS (SELECT * FROM logs WHERE {SINCE_MONTH} {where} ORDER BY {order} LIMIT {limit} OFFSET {offset})
    SELECT p.id, p.src_ip, {stamp_sql('p.timestamp')} AS at, s.description AS service_description, {_NAMES} FROM p {_NAME_JOINS} {_DESC}"""


def _shown(df):
    return df.select("id", "src_ip", stamp("timestamp").alias("at"), "service_description", "src_device_name", "dst_device_name")


_VIEWS = "logs clients devices services"


@query("h1_search_newest", _VIEWS, _page("timestamp DESC, id DESC", 50, 0))
def newest(t):
    return _shown(search.search_logs(t.logs, t.clients, t.devices, t.services, ALL, NOW, NO_IDENTITY))


@query("h1_search_deep_page", _VIEWS, _page("timestamp DESC, id DESC", 100, 1500))
def deep(t):
    return _shown(search.search_logs(t.logs, t.clients, t.devices, t.services, ALL, NOW, NO_IDENTITY, page=16, size=100))


@query("h1_search_by_score", _VIEWS, _page("threat_score DESC NULLS FIRST, id DESC", 200, 200, "AND log_type = 'firewall'"))
def by_score(t):
    return _shown(
        search.search_logs(t.logs, t.clients, t.devices, t.services, FIREWALL, NOW, NO_IDENTITY, sort="threat_score", page=2, size=200)
    )


@query("h1_search_by_ip", _VIEWS, _page(f"{number('src_ip')} ASC NULLS LAST, id ASC", 120, 0))
def by_ip(t):
    return _shown(
        search.search_logs(t.logs, t.clients, t.devices, t.services, ALL, NOW, NO_IDENTITY, sort="src_ip", descending=False, size=120)
    )


@query(
    "h1_search_deep_by_rule", "logs",
    f"""SELECT id, rule_name, {stamp_sql('timestamp')} AS at FROM logs WHERE {SINCE_MONTH} ORDER BY rule_name ASC NULLS LAST, id ASC LIMIT 100 OFFSET 2000""",
)
def deep_by_rule(t):
    # Ranges far smaller than in production, so that they are cut on small tables, too.
    page = search.search_page(t.logs, ALL, NOW, "rule_name", False, page=21, size=100, few=500)
    return page.select("id", "rule_name", stamp("timestamp").alias("at"))


@query("h2_page_count", "logs", f"SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM logs WHERE {SINCE_MONTH}")
def pages(t):
    return search.page_count(t.logs, ALL, NOW)


IDS = [3, 4, 9, 24, 64, 129, 333, 514, 700, 999]
_OWN = "('45.1.0.2', '45.2.0.103', '45.3.1.11')"


@query(
    "h3_log_detail", f"{_VIEWS} threats",
    f"""WITH lc AS ({LC}), ld AS ({LATEST_DEVICE}), p AS (SELECT * FROM logs WHERE id IN ({', '.join(map(str, IDS))}))
    SELECT p.id, {_NAMES}, s.description AS service_description, coalesce(p.abuse_total_reports, CASE WHEN p.direction = 'inbound' THEN t1.abuse_total_reports
     WHEN p.direction = 'outbound' THEN t2.abuse_total_reports WHEN t1.ip IS NOT NULL THEN t1.abuse_total_reports ELSE t2.abuse_total_reports END) AS abuse_total_reports
    FROM p {_NAME_JOINS} {_DESC} LEFT JOIN threats t1 ON t1.ip = p.src_ip AND p.src_ip NOT IN {_OWN}
     LEFT JOIN threats t2 ON t2.ip = p.dst_ip AND p.dst_ip NOT IN {_OWN}""",
)
def detail(t):
    out = search.log_detail(t.logs, t.clients, t.devices, t.threats, t.services, IDS, CFG.__class__(wan_ips=CFG.wan_ips))
    return out.select("id", "src_device_name", "dst_device_name", "service_description", "abuse_total_reports")


@query(
    "h5_list_clients", "clients",
    f"SELECT mac, {stamp_sql('last_seen')} AS last_seen FROM clients ORDER BY clients.last_seen DESC NULLS LAST, mac LIMIT 200",
)
def clients(t):
    return inventory.list_clients(t.clients).select("mac", stamp("last_seen").alias("last_seen"))


@query("h5_list_devices", "devices", "SELECT mac, device_name, model FROM devices")
def devices(t):
    return inventory.list_devices(t.devices).select("mac", "device_name", "model")


_EXPORT = f"""WITH lc AS ({LC}), ld AS ({LATEST_DEVICE}), p AS (SELECT * FROM logs WHERE {SINCE_MONTH} AND log_type = 'firewall'
  ORDER BY timestamp DESC, id DESC LIMIT 2000)
 SELECT CAST(p.id AS VARCHAR) AS id, coalesce(rule_name, '') AS rule_name, coalesce(CAST(threat_score AS VARCHAR), '') AS threat_score,
  CASE WHEN threat_category_list IS NULL THEN '' ELSE '[''' || replace(threat_category_list, ',', ''', ''') || ''']' END AS threat_categories,
  CASE WHEN abuse_is_tor THEN 'True' WHEN NOT abuse_is_tor THEN 'False' ELSE '' END AS abuse_is_tor,
  coalesce(coalesce(p.src_device_name, c1.device_name, c1.hostname, c1.oui, d1.device_name, d1.model), '') AS src_device_name,
  coalesce(coalesce(p.dst_device_name, lc.name, ld.name), '') AS dst_device_name FROM p {_NAME_JOINS}"""


@query("a11_export_logs", "logs clients devices", _EXPORT)
def export(t):
    rows = search.export_rows(t.logs, t.clients, t.devices, FIREWALL, NOW, NO_IDENTITY, limit=2000)
    return csv_cells(rows).select(
        "id", "rule_name", "threat_score", "threat_categories", "abuse_is_tor", "src_device_name", "dst_device_name"
    )


_RECENT = "timestamp > TIMESTAMP '2024-01-29 12:00:00'"
for _column in ("service_name", "protocol"):

    @query(f"f34_recent_{_column}", "logs", f"SELECT DISTINCT {_column} FROM logs WHERE {_column} IS NOT NULL AND {_RECENT}")
    def recent(t, column=_column):
        return search.distinct_recent(t.logs, column, NOW)


@query(
    "f35_recent_interfaces", "logs",
    f"""SELECT DISTINCT iface FROM (SELECT interface_in AS iface FROM logs WHERE log_type = 'firewall' AND {_RECENT}
    UNION ALL SELECT interface_out FROM logs WHERE log_type = 'firewall' AND {_RECENT}) q WHERE iface IS NOT NULL""",
)
def recent_ifaces(t):
    return discovery.recent_ifaces(t.logs, NOW)


@query(
    "f36_counts_for_types", "logs",
    "SELECT count(*) FILTER (WHERE log_type = 'wifi') AS wifi, count(*) FILTER (WHERE log_type = 'system') AS system FROM logs",
)
def type_counts(t):
    return search.counts_for_types(t.logs)


@query("f36_count_firewall", "logs", "SELECT count(*) AS count FROM logs WHERE log_type = 'firewall'")
def firewall_count(t):
    return search.count_type(t.logs)


@query("f37_health", "logs", f"SELECT count(*) AS total, {stamp_sql('min(timestamp)')} AS oldest, {stamp_sql('max(timestamp)')} AS latest FROM logs")
def health(t):
    return search.health(t.logs).withColumn("oldest", stamp("oldest")).withColumn("latest", stamp("latest"))


@query("f37_last_hour", "logs", "SELECT log_type, count(*) AS count FROM logs WHERE timestamp > TIMESTAMP '2024-01-30 22:30:00' GROUP BY 1")
def last_hour(t):
    return search.last_hour_by_type(t.logs, "2024-01-30 23:30:00")


_WANTED = f"{public('dst_ip')} AND dst_ip NOT LIKE '127.%' AND dst_ip <> '255.255.255.255'"


@query(
    "f30_wan_ip_by_interface", "logs",
    f"""SELECT iface, wan_ip FROM (SELECT interface_in AS iface, dst_ip AS wan_ip, row_number() OVER (PARTITION BY interface_in
    ORDER BY count(*) DESC, dst_ip) AS rn FROM logs WHERE log_type = 'firewall' AND interface_in IN ('br10', 'br20', 'ppp0') AND {_WANTED}
    GROUP BY 1, 2) q WHERE rn = 1""",
)
def wan_ips(t):
    return discovery.wan_ip_by_iface(t.logs, ["br10", "br20", "ppp0"])


@query(
    "f31_wan_candidates", "logs",
    f"""WITH c AS (SELECT interface_in AS interface, CASE WHEN {_WANTED} THEN dst_ip END AS target, count(*) AS n FROM logs
     WHERE log_type = 'firewall' AND interface_in IS NOT NULL AND interface_in NOT LIKE 'br%' AND interface_in NOT LIKE 'wg%' AND interface_in NOT LIKE 'tun%'
     GROUP BY 1, 2), m AS (SELECT interface, target FROM (SELECT *, row_number() OVER (PARTITION BY interface ORDER BY n DESC, target) AS rn FROM c
     WHERE target IS NOT NULL) q WHERE rn = 1)
    SELECT c.interface, CAST(sum(n) AS BIGINT) AS event_count, coalesce(max(m.target), '') AS wan_ip FROM c LEFT JOIN m ON m.interface = c.interface GROUP BY 1""",
)
def wan_candidates(t):
    return discovery.wan_candidates(t.logs)


@query(
    "f32_gateway_ips", "logs",
    "SELECT DISTINCT dst_ip AS gateway_ip FROM logs WHERE log_type = 'firewall' AND contains(rule_name, '_LOCAL') AND dst_ip LIKE '192.168.%'",
)
def gateways(t):
    return discovery.gateway_ips(t.logs)


_SEG = f"""(SELECT interface_in AS iface, src_ip AS ip FROM logs WHERE log_type = 'firewall' AND interface_in IS NOT NULL AND NOT {public('src_ip')}
 UNION SELECT interface_out, dst_ip FROM logs WHERE log_type = 'firewall' AND interface_out IS NOT NULL AND NOT {public('dst_ip')})"""


@query("f33_segment_ips", "logs", f"SELECT iface, ip FROM {_SEG} q WHERE ip IS NOT NULL")
def segment_ips(t):
    return discovery.segment_ips(t.logs)


_LABEL = """CASE WHEN {0} = 'ppp0' THEN 'WAN' WHEN {0} = 'br0' THEN 'Main LAN' WHEN {0} LIKE 'br%' THEN 'VLAN ' || substr({0}, 3)
 WHEN {0} LIKE 'wgsrv%' THEN 'VPN' ELSE '' END"""


@query(
    "f33_segments", "logs",
    f"""WITH w AS (SELECT dst_ip FROM logs WHERE log_type = 'firewall' AND interface_in = 'ppp0' AND {_WANTED} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT iface AS interface, coalesce(CASE WHEN iface = 'ppp0' THEN (SELECT dst_ip FROM w) ELSE min(ip) END, '') AS sample_local_ip,
    {_LABEL.format('iface')} AS suggested_label, iface = 'ppp0' AS is_wan FROM {_SEG} q GROUP BY iface ORDER BY iface LIMIT 30""",
)
def segments(t):
    return discovery.segments(t.logs, ["ppp0"]).drop("suggested_badge", "prefix_description")


@query(
    "d11_interface_label", "logs",
    f"SELECT DISTINCT interface_out AS name, {_LABEL.format('interface_out')} AS label FROM logs WHERE interface_out IS NOT NULL",
)
def labels(t):
    return t.logs.where(F.col("interface_out").isNotNull()).select(
        F.col("interface_out").alias("name"), iface_label("interface_out", ["ppp0"]).alias("label")
    ).distinct()


_IFACES = f"""(SELECT interface_in AS iface FROM logs WHERE log_type = 'firewall' AND {_RECENT} AND interface_in IS NOT NULL
 UNION SELECT interface_out FROM logs WHERE log_type = 'firewall' AND {_RECENT} AND interface_out IS NOT NULL
 UNION SELECT unnest(['ppp0', 'br10', 'wgsrv1', 'tun7']))"""


@query("i4_known_interfaces", "logs", f"SELECT iface FROM {_IFACES} q")
def known(t):
    return discovery.known_ifaces(t.logs, NOW, CFG)


@query(
    "d10_interface_list", "logs",
    f"""SELECT iface AS name, CASE iface WHEN 'ppp0' THEN 'Internet' WHEN 'br10' THEN 'Home' WHEN 'wgsrv1' THEN 'Road warriors' ELSE iface END AS label,
    CASE WHEN iface = 'ppp0' THEN 'wan' WHEN iface LIKE 'wgsrv%' OR iface LIKE 'tun%' THEN 'vpn' WHEN iface LIKE 'br%' THEN 'vlan' END AS iface_type,
    CASE WHEN iface LIKE 'br%' THEN CAST(substr(iface, 3) AS INT) END AS vlan_id,
    CASE iface WHEN 'wgsrv1' THEN 'WGD SRV' WHEN 'tun7' THEN 'OVPN TUN' END AS vpn_badge,
    CASE iface WHEN 'wgsrv1' THEN 'WireGuard Server' WHEN 'tun7' THEN 'OpenVPN / Tunnel 1' END AS description FROM {_IFACES} q""",
)
def interface_list(t):
    return discovery.interface_list(t.logs, NOW, CFG)


@query("i2_union_distinct", "logs", "SELECT src_ip AS ip FROM logs UNION SELECT dst_ip FROM logs")
def union_distinct(t):
    return discovery.union_distinct(t.logs.select(F.col("src_ip").alias("ip")), t.logs.select(F.col("dst_ip").alias("ip")))


@query("i3_difference", "logs threats", "SELECT ip FROM threats WHERE ip NOT IN (SELECT remote_ip FROM logs WHERE remote_ip IS NOT NULL)")
def difference(t):
    return discovery.difference(t.threats.select("ip"), t.logs.select(F.col("remote_ip").alias("ip")), "ip")


@query(
    "f40_audit_page", "audit tokens",
    f"""SELECT p.id, p.token_id, t.name AS token_name, t.token_prefix, {stamp_sql('p.created_at')} AS created_at,
    CASE WHEN p.detail LIKE '{{%' THEN 't' || CAST(p.id % 5 AS VARCHAR) END AS tool_name,
    CASE WHEN p.detail LIKE '{{%' THEN CASE WHEN p.id % 2 = 0 THEN 'true' ELSE 'false' END END AS success
    FROM (SELECT * FROM audit WHERE action = 'api_call' ORDER BY created_at DESC, id DESC LIMIT 300 OFFSET 100) p
    LEFT JOIN tokens t ON t.id = p.token_id""",
)
def audit(t):
    out = audit_page(t.audit, t.tokens, 300, 100)
    return out.select("id", "token_id", "token_name", "token_prefix", stamp("created_at").alias("created_at"), "tool_name", "success")


@query("f40_audit_total", "audit", "SELECT count(*) AS total FROM audit WHERE action = 'api_call'")
def audit_count(t):
    return audit_total(t.audit)


@query("j26_retain_audit", "audit", "SELECT id FROM audit WHERE created_at >= TIMESTAMP '1998-04-02 00:00:00'")
def kept_audit(t):
    return retain_audit(t.audit, "1998-07-01 00:00:00").select("id")


@query(
    "a14_reconcile", "logs clients threats",
    """WITH s AS (SELECT 'logs' AS table_name, (SELECT count(*) FROM logs) AS source_rows UNION ALL SELECT 'clients', (SELECT count(*) FROM clients)
     UNION ALL SELECT 'threats', (SELECT count(*) FROM threats)), d AS (SELECT 'logs' AS table_name, (SELECT count(*) FROM logs WHERE log_type <> 'dns') AS target_rows
     UNION ALL SELECT 'clients', (SELECT count(*) FROM clients))
    SELECT s.table_name, source_rows, coalesce(target_rows, -1) AS target_rows, CASE WHEN source_rows > 0 AND coalesce(target_rows, -1) < source_rows
     THEN 'mismatch' ELSE 'ok' END AS status FROM s LEFT JOIN d ON d.table_name = s.table_name""",
)
def reconcile(t):
    source = {"logs": t.logs, "clients": t.clients, "threats": t.threats}
    return reconcile_counts(source, {"logs": t.logs.where("log_type <> 'dns'"), "clients": t.clients})


