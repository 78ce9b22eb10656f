"""Join queries (section 2.E and the name joins of H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.contract.aggregates import who
from netlens.contract.common import CFG, LATEST_CLIENT, LATEST_DEVICE, NOW, joined, number, stamp, stamp_sql
from netlens.contract.registry import query
from netlens.operators import dims
from netlens.operators.audit import merge_audit
from netlens.operators.enrich import EnrichmentTables, enrich, remote_side
from netlens.operators.identity import annotate_identity, identity_of, vpn_match
from netlens.operators.rangejoin import keyed_blocks, range_join
from netlens.operators.search import fill_from_reputation, join_threats_both
from netlens.operators.stats import join_threat
from netlens.plans import maintenance as mt
from netlens.sources.services import service_name


@query(
    "e1_name_by_mac", "logs clients devices",
    """SELECT logs.id, coalesce(logs.src_device_name, c.device_name, c.hostname, c.oui, d.device_name, d.model) AS src_device_name
    FROM logs LEFT JOIN clients c ON c.mac = logs.mac_address LEFT JOIN devices d ON d.mac = logs.mac_address
    WHERE logs.mac_address IS NOT NULL""",
)
def name_by_mac(t):
    rows = t.logs.where(F.col("mac_address").isNotNull()).select("id", "mac_address", "src_device_name")
    return dims.join_name_by_mac(rows, t.clients, t.devices, existing="src_device_name").drop("mac_address")


@query(
    "e2_latest_client", "logs clients",
    f"""WITH lc AS ({LATEST_CLIENT.format(where="WHERE last_seen >= TIMESTAMP '2024-01-23 00:00:00'")})
    SELECT logs.src_ip, lc.name AS client, count(*) AS n FROM logs LEFT JOIN lc ON lc.ip = logs.src_ip
    WHERE logs.src_ip IS NOT NULL GROUP BY 1, 2""",
)
def latest_client(t):
    rows = t.logs.where(F.col("src_ip").isNotNull())
    named = dims.join_latest_client(rows, t.clients, "src_ip", "client", since="2024-01-24 00:00:00")
    return named.groupBy("src_ip", "client").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e3_latest_device", "logs devices",
    f"""WITH ld AS ({LATEST_DEVICE}) SELECT logs.dst_ip, ld.name AS device, count(*) AS n
    FROM logs LEFT JOIN ld ON ld.ip = logs.dst_ip WHERE logs.dst_ip IS NOT NULL GROUP BY 1, 2""",
)
def latest_device(t):
    rows = t.logs.where(F.col("dst_ip").isNotNull())
    return dims.join_latest_device(rows, t.devices, "dst_ip", "device").groupBy("dst_ip", "device").agg(F.count(F.lit(1)).alias("n"))


_OWN = "('45.1.0.2', '45.2.0.103', '45.3.1.11')"


def _side(column: str, empty_is_null: bool = False) -> str:
    a, b = (f"nullif({s}.{column}, '')" if empty_is_null else f"{s}.{column}" for s in ("t1", "t2"))
    return f"""CASE WHEN l.direction = 'inbound' THEN {a} WHEN l.direction = 'outbound' THEN {b}
    WHEN t1.ip IS NOT NULL THEN {a} ELSE {b} END"""


_BOTH = f"""FROM logs l LEFT JOIN threats t1 ON t1.ip = l.src_ip AND l.src_ip NOT IN {_OWN}
 LEFT JOIN threats t2 ON t2.ip = l.dst_ip AND l.dst_ip NOT IN {_OWN}"""


@query(
    "e4_threats_both_sides", "logs threats",
    f"SELECT l.id, t1.threat_score AS src_score, t2.threat_score AS dst_score {_BOTH} WHERE l.log_type = 'firewall'",
)
def threats_both(t):
    out = join_threats_both(t.logs.where("log_type = 'firewall'").select("id", "src_ip", "dst_ip"), t.threats, CFG.wan_ips)
    return out.select("id", F.col("_t1.threat_score").alias("src_score"), F.col("_t2.threat_score").alias("dst_score"))


@query(
    "d5_threat_coalesce", "logs threats",
    f"""SELECT l.id, coalesce(l.abuse_usage_type, {_side('abuse_usage_type')}) AS abuse_usage_type,
    coalesce(l.abuse_total_reports, {_side('abuse_total_reports')}) AS abuse_total_reports,
    coalesce(l.abuse_is_tor, {_side('abuse_is_tor')}) AS abuse_is_tor,
    coalesce(nullif(l.threat_category_list, ''), {_side('threat_category_list', True)}) AS categories {_BOTH} WHERE l.log_type = 'firewall'""",
)
def threat_coalesce(t):
    out = fill_from_reputation(join_threats_both(t.logs.where("log_type = 'firewall'"), t.threats, CFG.wan_ips))
    return out.select("id", "abuse_usage_type", "abuse_total_reports", "abuse_is_tor", joined("threat_categories").alias("categories"))


@query(
    "e5_join_threat", "logs threats",
    "SELECT l.remote_ip AS ip, l.n, t.threat_score FROM (SELECT remote_ip, count(*) AS n FROM logs WHERE remote_ip IS NOT NULL GROUP BY 1) l LEFT JOIN threats t ON t.ip = l.remote_ip",
)
def threat(t):
    rows = t.logs.where(F.col("remote_ip").isNotNull()).groupBy(F.col("remote_ip").alias("ip")).agg(F.count(F.lit(1)).alias("n"))
    return join_threat(rows, t.threats.select("ip", "threat_score"))


@query(
    "e7_service", "logs services",
    """SELECT l.dst_port, l.protocol, CASE WHEN s.service_name = 'domain' THEN 'DNS' ELSE s.service_name END AS service,
    s.description, count(*) AS n FROM logs l LEFT JOIN services s ON s.port = l.dst_port AND s.protocol = coalesce(lower(l.protocol), 'tcp')
    GROUP BY 1, 2, 3, 4""",
)
def service(t):
    out = service_name(t.logs, t.services)
    return out.groupBy("dst_port", "protocol", F.col("iana_service").alias("service"), F.col("service_description").alias("description")).agg(
        F.count(F.lit(1)).alias("n")
    )


_RANGE = f"""b AS (SELECT ip, asn_name FROM (SELECT i.ip, a.asn_name, row_number() OVER (PARTITION BY i.ip ORDER BY a.prefix_len DESC) AS rn
 FROM i JOIN asn_blocks a ON {number('i.ip')} BETWEEN a.start_num AND a.end_num) q WHERE rn = 1)"""


@query(
    "e8_asn_block", "logs threats asn_blocks",
    f"""WITH i AS (SELECT DISTINCT remote_ip AS ip FROM logs WHERE remote_ip IS NOT NULL UNION SELECT ip FROM threats), {_RANGE}
    SELECT i.ip, b.asn_name FROM i LEFT JOIN b ON b.ip = i.ip""",
)
def asn_block(t):
    ips = t.logs.select(F.col("remote_ip").alias("ip")).unionByName(t.threats.select("ip"))
    return range_join(ips, keyed_blocks(t.asn_blocks))


@query(
    "e9_vpn_match", "logs",
    f"""SELECT dst_ip, CASE WHEN {number('dst_ip')} BETWEEN 3232260864 AND 3232260879 THEN 'WGD SRV' ELSE 'OVPN TUN' END AS badge,
    {who('dst_ip')} AS name, count(*) AS n FROM logs
    WHERE {number('dst_ip')} BETWEEN 3232260864 AND 3232261119 AND dst_ip <> '192.168.99.2' GROUP BY 1, 2, 3""",
)
def vpn(t):
    out = t.logs.select("dst_ip", vpn_match("dst_ip", CFG, ("192.168.99.2",)).alias("v")).where(F.col("v").isNotNull())
    return out.groupBy("dst_ip", F.col("v.badge").alias("badge"), F.col("v.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "e10_identity", "logs",
    f"""SELECT id, coalesce(src_device_name, {who('src_ip')}) AS src_device_name, coalesce(dst_device_name, {who('dst_ip')}) AS dst_device_name,
    CASE src_ip WHEN '192.168.10.2' THEN 10 WHEN '192.168.99.2' THEN 99 END AS src_device_vlan,
    CASE dst_ip WHEN '192.168.10.2' THEN 10 WHEN '192.168.99.2' THEN 99 END AS dst_device_vlan FROM logs""",
)
def identity(t):
    rows = t.logs.select("id", "src_ip", "dst_ip", "src_device_name", "dst_device_name")
    return annotate_identity(rows, CFG).drop("src_ip", "dst_ip", "src_device_network", "dst_device_network")


@query(
    "d4_name_coalesce", "clients",
    f"SELECT ip, coalesce(device_name, hostname, oui, {who('ip')}) AS name FROM clients",
)
def name_coalesce(t):
    known = F.coalesce("device_name", "hostname", "oui")
    return t.clients.withColumn("_n", known).select("ip", identity_of("ip", "_n", CFG)["name"].alias("name"))


@query(
    "e17_time_bound_name", "logs clients",
    """WITH lc AS (SELECT ip, name, last_seen FROM (SELECT ip, coalesce(device_name, hostname, oui) AS name, last_seen, row_number() OVER
     (PARTITION BY ip ORDER BY last_seen DESC NULLS LAST, mac DESC) AS rn FROM clients WHERE coalesce(device_name, hostname, oui) IS NOT NULL) q WHERE rn = 1)
    SELECT id, lc.name FROM logs LEFT JOIN lc ON lc.ip = dst_ip AND timestamp >= last_seen - INTERVAL 1 DAY WHERE dst_ip IS NOT NULL""",
)
def time_bound(t):
    out = mt.join_name_timebound(t.logs.where(F.col("dst_ip").isNotNull()), t.clients)
    return out.select("id", F.col("_dst_name").alias("name"))


@query(
    "e18_merge_audit", "audit",
    """WITH inc AS (SELECT created_at + CASE WHEN id % 3 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS created_at, token_id FROM audit)
    SELECT token_id, CAST(created_at AS VARCHAR) AS at, count(*) AS n FROM (SELECT token_id, created_at FROM audit
     UNION ALL SELECT token_id, created_at FROM inc WHERE NOT EXISTS (SELECT 1 FROM audit a WHERE a.created_at = inc.created_at
      AND a.token_id IS NOT DISTINCT FROM inc.token_id)) q GROUP BY 1, 2""",
)
def audit_merge(t):
    later = F.col("created_at") + F.when(F.col("id") % 3 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    incoming = t.audit.select(
        later.alias("created_at"), "token_id",
        *[F.lit(None).cast("string").alias(c) for c in ("tool_name", "scope", "success", "error", "params")],
    )
    out = merge_audit(t.audit, incoming)
    return out.groupBy("token_id", F.col("created_at").cast("string").alias("at")).agg(F.count(F.lit(1)).alias("n"))


_MAPS = """WITH e AS (SELECT mac, ip, coalesce(device_name, hostname, oui) AS name, 0 AS source, last_seen AS seen FROM clients
 UNION ALL SELECT mac, ip, coalesce(device_name, model), 1, updated_at FROM devices), k AS (SELECT * FROM e WHERE name IS NOT NULL)
 SELECT {key}, name FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY source DESC, seen DESC NULLS LAST, mac DESC) AS rn FROM k) q WHERE rn = 1"""


@query("e19_name_by_ip_map", "clients devices", _MAPS.format(key="ip"))
def ip_map(t):
    return dims.name_maps(t.clients, t.devices)[0]


@query("e19_name_by_mac_map", "clients devices", _MAPS.format(key="mac"))
def mac_map(t):
    return dims.name_maps(t.clients, t.devices)[1]


@query(
    "e16_merge_clients", "clients",
    f"""SELECT mac, hostname, {stamp_sql('last_seen')} AS last_seen FROM clients WHERE is_wired
    UNION ALL SELECT mac, 'old', NULL FROM clients WHERE NOT is_wired""",
)
def client_merge(t):
    historic = t.clients.select("mac", F.lit("old").alias("hostname"), F.lit(None).cast("timestamp").alias("last_seen"))
    active = t.clients.where("is_wired").select("mac", "hostname", "last_seen")
    return dims.merge_clients(active, historic).withColumn("last_seen", stamp("last_seen"))


_REMOTE = f"""CASE WHEN src_ip LIKE '45.%' AND src_ip NOT IN {_OWN} THEN src_ip
 WHEN dst_ip LIKE '45.%' AND dst_ip NOT IN {_OWN} THEN dst_ip END"""


@query("k2_remote_side", "logs", f"SELECT id, {_REMOTE} AS remote_ip FROM logs")
def remote(t):
    return t.logs.select("id", remote_side(CFG.__class__(wan_ips=CFG.wan_ips)).alias("remote_ip"))


@query(
    "k2_enrich", "logs threats asn_blocks rdns_cache",
    f"""WITH l AS (SELECT id, log_type, rule_action, {_REMOTE} AS remote_ip FROM logs), i AS (SELECT DISTINCT remote_ip AS ip FROM l WHERE remote_ip IS NOT NULL),
    {_RANGE}, r AS (SELECT ip, hostname FROM rdns_cache WHERE status = 'success' AND looked_up_at > TIMESTAMP '2024-01-30 00:00:00'),
    f AS (SELECT * FROM threats WHERE looked_up_at > TIMESTAMP '2024-01-27 00:00:00'), h AS (SELECT l.*, b.asn_name, r.hostname AS rdns,
     l.log_type = 'firewall' AND coalesce(l.rule_action = 'block', false) AS wants FROM l LEFT JOIN b ON b.ip = l.remote_ip LEFT JOIN r ON r.ip = l.remote_ip)
    SELECT h.id, h.remote_ip, h.asn_name, h.rdns, CASE WHEN wants THEN f.threat_score END AS threat_score,
     CASE WHEN wants THEN f.abuse_usage_type END AS abuse_usage_type, h.remote_ip IS NOT NULL AND wants AND f.ip IS NULL AS reputation_missing
    FROM h LEFT JOIN f ON f.ip = h.remote_ip""",
)
def enriched(t):
    bare = t.logs.select(
        "id", "log_type", "rule_action", "rule_name", "src_ip", "dst_ip", "interface_in", "interface_out", "mac_address", "raw_log"
    )
    tables = EnrichmentTables(asn_blocks=keyed_blocks(t.asn_blocks), rdns_cache=t.rdns_cache, threats=t.threats)
    out = enrich(bare, tables, CFG.__class__(wan_ips=CFG.wan_ips), NOW)
    return out.select("id", "remote_ip", "asn_name", "rdns", "threat_score", "abuse_usage_type", "reputation_missing")


@query(
    "e20_resolve_names", "logs clients devices",
    f"""WITH im AS (WITH {_MAPS.format(key='ip')[5:]}), mm AS (WITH {_MAPS.format(key='mac')[5:]})
    SELECT l.id, coalesce(CASE WHEN src_ip LIKE '192.168.%' THEN coalesce(mm.name, i1.name) END, src_device_name) AS src_device_name,
     coalesce(CASE WHEN dst_ip LIKE '192.168.%' THEN i2.name END, dst_device_name) AS dst_device_name
    FROM logs l LEFT JOIN mm ON mm.mac = l.mac_address LEFT JOIN im i1 ON i1.ip = l.src_ip LEFT JOIN im i2 ON i2.ip = l.dst_ip""",
)
def resolved(t):
    ips, macs = dims.name_maps(t.clients, t.devices)
    rows = t.logs.select("id", "src_ip", "dst_ip", "mac_address", "src_device_name", "dst_device_name")
    private = [F.coalesce(F.col(c).startswith("192.168."), F.lit(False)) for c in ("src_ip", "dst_ip")]
    return dims.resolve_names(rows, ips, macs, *private).select("id", "src_device_name", "dst_device_name")

