"""Upkeep jobs (section 2.J) and queue figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.config import NetConfig
from netlens.contract.common import NOW, joined, stamp, stamp_sql
from netlens.contract.registry import query
from netlens.operators.enrich import EnrichmentTables, remote_attributes
from netlens.operators.rangejoin import keyed_blocks
from netlens.plans import maintenance as mt
from netlens.plans import retention

OWN = ("45.1.0.2", "45.2.0.103", "45.3.1.11")
OWN_SQL = "('45.1.0.2', '45.2.0.103', '45.3.1.11')"
CFG = NetConfig(wan_ips=OWN, gateway_vlans={"192.168.10.2": 10})
TS_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
# Results of fresh lookups and a feed, from the supplier table.
_RESULTS = """(SELECT '45.' || CAST(m % 7 AS VARCHAR) || '.' || CAST(CAST(floor(m / 7) AS INT) AS VARCHAR) || '.' || CAST(1 + m % 50 + 50 * (m % 4) AS VARCHAR) AS ip,
 CAST(max(floor(abs(bal))) % 101 AS INT) AS threat_score, CASE WHEN max(nat) % 2 = 0 THEN 'Hosting' END AS abuse_usage_type,
 CASE WHEN max(nat) % 3 = 0 THEN CAST(max(nat) AS INT) END AS abuse_total_reports
 FROM (SELECT c_custkey % 150 AS m, c_acctbal AS bal, c_nationkey AS nat FROM {}) x GROUP BY 1)"""
RESULTS_SQL = _RESULTS.format("customer")


def results(t):
    text = _RESULTS.format("{customer}").replace("VARCHAR", "STRING").replace("GROUP BY 1", "GROUP BY m")
    inner = t.spark.sql(f"SELECT * FROM {text} r", customer=t.base("customer"))
    return inner.withColumn("threat_categories", F.array(F.lit("18"), F.lit("9")))


_SHOWN = ["ip", "threat_score", "abuse_usage_type", "abuse_total_reports"]


def _threats(df):
    return df.select(
        *_SHOWN, joined("threat_categories").alias("categories"), stamp("looked_up_at").alias("looked_up_at"),
        stamp("last_seen_at").alias("last_seen_at"),
    )


_NOW_TEXT = "'2024-01-31 00:00:00'"


@query(
    "j1_upsert_threats", "threats",
    f"""WITH r AS (SELECT * FROM {RESULTS_SQL} q WHERE ip NOT IN {OWN_SQL})
    SELECT coalesce(r.ip, t.ip) AS ip, CASE WHEN r.ip IS NULL THEN t.threat_score ELSE r.threat_score END AS threat_score,
    coalesce(r.abuse_usage_type, t.abuse_usage_type) AS abuse_usage_type, coalesce(r.abuse_total_reports, t.abuse_total_reports) AS abuse_total_reports,
    CASE WHEN r.ip IS NULL THEN t.threat_category_list ELSE '18,9' END AS categories,
    CASE WHEN r.ip IS NULL THEN {stamp_sql('t.looked_up_at')} ELSE {_NOW_TEXT} END AS looked_up_at,
    CASE WHEN r.ip IS NULL THEN {stamp_sql('t.last_seen_at')} ELSE {_NOW_TEXT} END AS last_seen_at
    FROM threats t FULL JOIN r ON r.ip = t.ip""",
)
def upsert_threats(t):
    return _threats(mt.upsert_threats(t.threats, results(t), NOW, OWN))


@query(
    "j2_upsert_feed", "threats",
    f"""SELECT coalesce(r.ip, t.ip) AS ip, greatest(t.threat_score, r.threat_score) AS threat_score, t.abuse_usage_type, t.abuse_total_reports,
    CASE WHEN r.ip IS NULL OR contains(coalesce(t.threat_category_list, ''), ',') THEN t.threat_category_list ELSE 'blacklist' END AS categories,
    CASE WHEN r.ip IS NULL THEN {stamp_sql('t.looked_up_at')} ELSE {_NOW_TEXT} END AS looked_up_at,
    CASE WHEN t.ip IS NULL THEN {_NOW_TEXT} ELSE {stamp_sql('t.last_seen_at')} END AS last_seen_at
    FROM threats t FULL JOIN {RESULTS_SQL} r ON r.ip = t.ip""",
)
def upsert_feed(t):
    feed = results(t).select("ip", "threat_score", F.array(F.lit("blacklist")).alias("threat_categories"))
    return _threats(mt.upsert_feed(t.threats, feed, NOW))


@query(
    "j3_touch_last_seen", "threats logs",
    f"""WITH s AS (SELECT remote_ip AS ip, max(timestamp) AS seen FROM logs WHERE remote_ip IS NOT NULL GROUP BY 1)
    SELECT t.ip, {stamp_sql('CASE WHEN s.seen IS NULL THEN t.last_seen_at WHEN t.last_seen_at IS NULL OR s.seen > t.last_seen_at THEN s.seen ELSE t.last_seen_at END')} AS last_seen_at
    FROM threats t LEFT JOIN s ON s.ip = t.ip""",
)
def touch(t):
    return mt.touch_last_seen(t.threats, t.logs).select("ip", stamp("last_seen_at").alias("last_seen_at"))


@query("j27_fill_last_seen", "threats", f"SELECT ip, {stamp_sql('coalesce(last_seen_at, looked_up_at)')} AS last_seen_at FROM threats")
def fill_seen(t):
    return mt.fill_last_seen(t.threats).select("ip", stamp("last_seen_at").alias("last_seen_at"))


def _queue(df):
    return df.select("ip", "source", "attempts", stamp("last_seen_at").alias("seen"), stamp("next_retry_at").alias("retry"))


_MISSES = "(SELECT DISTINCT remote_ip AS ip FROM logs WHERE remote_ip IS NOT NULL AND rule_action = 'block')"


@query(
    "j4_enqueue", "queue logs",
    f"""SELECT coalesce(q.ip, m.ip) AS ip, coalesce(source, 'live_miss') AS source, coalesce(attempts, 0) AS attempts,
    CASE WHEN m.ip IS NULL THEN {stamp_sql('last_seen_at')} ELSE {_NOW_TEXT} END AS seen,
    CASE WHEN m.ip IS NULL THEN {stamp_sql('next_retry_at')} WHEN q.ip IS NULL THEN {_NOW_TEXT} ELSE {stamp_sql(f'greatest(next_retry_at, {TS_NOW})')} END AS retry
    FROM queue q FULL JOIN {_MISSES} m ON m.ip = q.ip""",
)
def enqueue(t):
    misses = t.logs.where("remote_ip IS NOT NULL AND rule_action = 'block'").select(F.col("remote_ip").alias("ip"))
    return _queue(mt.enqueue(t.queue, misses, NOW))


_DUE = f"(SELECT * FROM queue WHERE next_retry_at <= {TS_NOW} ORDER BY next_retry_at, last_seen_at DESC, ip LIMIT 50)"


@query("j5_due", "queue", f"SELECT ip FROM {_DUE} d")
def due(t):
    return mt.due(t.queue, NOW).select("ip")


@query("j6_complete", "queue", f"SELECT ip, attempts FROM queue WHERE ip NOT IN (SELECT ip FROM {_DUE} d)")
def complete(t):
    return mt.complete(t.queue, mt.due(t.queue, NOW)).select("ip", "attempts")


@query(
    "j6_fail", "queue logs",
    f"""SELECT q.ip, source, CAST(attempts + CASE WHEN m.ip IS NULL THEN 0 ELSE 1 END AS INT) AS attempts, {stamp_sql('last_seen_at')} AS seen,
    {stamp_sql(f"CASE WHEN m.ip IS NULL THEN next_retry_at ELSE {TS_NOW} + INTERVAL 1 SECOND * CAST(least(300 * pow(2, attempts), 86400) AS BIGINT) END")} AS retry
    FROM queue q LEFT JOIN {_MISSES} m ON m.ip = q.ip""",
)
def fail(t):
    failed = t.logs.where("remote_ip IS NOT NULL AND rule_action = 'block'").select(F.col("remote_ip").alias("ip"))
    return _queue(mt.fail(t.queue, failed, "lookup_failed", NOW))


@query(
    "f38_queue_stats", "queue",
    f"SELECT count(*) AS total, count(*) FILTER (WHERE next_retry_at <= {TS_NOW}) AS due, count(*) FILTER (WHERE attempts > 0) AS retried FROM queue",
)
def queue_stats(t):
    return mt.queue_stats(t.queue, NOW)


_ALL_DUE = f"(SELECT ip FROM {_DUE} d)"


@query(
    "j7_queue_after_cycle", "queue",
    f"""WITH d AS {_ALL_DUE}, r AS {RESULTS_SQL}
    SELECT q.ip, CAST(attempts + CASE WHEN d.ip IS NULL THEN 0 ELSE 1 END AS INT) AS attempts FROM queue q LEFT JOIN d ON d.ip = q.ip
    WHERE d.ip IS NULL OR q.ip NOT IN (SELECT ip FROM r)""",
)
def cycle(t):
    return mt.queue_cycle(t.queue, results(t), t.threats, t.logs, NOW, OWN)["queue"].select("ip", "attempts")


_TARGETS = "log_type = 'firewall' AND rule_action = 'block'"
_T = f"(SELECT * FROM threats WHERE ip NOT IN {OWN_SQL})"


def _logs(df):
    return df.select(
        "id", "threat_score", "abuse_usage_type", "abuse_hostnames", "abuse_total_reports", "abuse_is_tor",
        joined("threat_categories").alias("categories"),
    )


def _patched(name: str) -> str:
    return f"CASE WHEN hit AND (t1.ip IS NOT NULL OR t2.ip IS NOT NULL) THEN coalesce(l.{name}, CASE WHEN t1.ip IS NOT NULL THEN t1.{name} ELSE t2.{name} END) ELSE l.{name} END AS {name}"


_JOINED = f"""FROM (SELECT *, coalesce({_TARGETS} AND {{cond}}, false) AS hit FROM logs) l
 LEFT JOIN {_T} t1 ON t1.ip = l.src_ip AND l.hit LEFT JOIN {_T} t2 ON t2.ip = l.dst_ip AND l.hit"""


@query(
    "j8_patch_scores", "logs threats",
    f"""SELECT l.id, CASE WHEN hit AND (t1.ip IS NOT NULL OR t2.ip IS NOT NULL) THEN CASE WHEN t1.ip IS NOT NULL THEN t1.threat_score ELSE t2.threat_score END ELSE l.threat_score END AS threat_score,
    {_patched('abuse_usage_type')}, {_patched('abuse_hostnames')}, {_patched('abuse_total_reports')}, {_patched('abuse_is_tor')},
    CASE WHEN hit AND (t1.ip IS NOT NULL OR t2.ip IS NOT NULL) THEN CASE WHEN t1.ip IS NOT NULL THEN t1.threat_category_list ELSE t2.threat_category_list END ELSE l.threat_category_list END AS categories
    {_JOINED.format(cond='threat_score IS NULL')}""",
)
def patch_scores(t):
    return _logs(mt.patch_scores(t.logs, t.threats, t.threats.select("ip"), OWN))


_ANY = "({0}.abuse_usage_type IS NOT NULL OR {0}.abuse_hostnames IS NOT NULL OR {0}.abuse_total_reports IS NOT NULL OR {0}.abuse_last_reported IS NOT NULL OR {0}.abuse_is_whitelisted IS NOT NULL OR {0}.abuse_is_tor IS NOT NULL)"


def _pass(side: str, before: str) -> str:
    names = ("abuse_usage_type", "abuse_hostnames", "abuse_total_reports", "abuse_is_tor")
    hit = f"(x.hit AND {side}.ip IS NOT NULL AND {_ANY.format(side)} AND x.abuse_usage_type IS NULL)"
    fields = ", ".join(f"CASE WHEN {hit} THEN {side}.{n} ELSE x.{n} END AS {n}" for n in names)
    cats = f"CASE WHEN {hit} AND nullif(x.categories, '') IS NULL AND nullif({side}.threat_category_list, '') IS NOT NULL THEN {side}.threat_category_list ELSE x.categories END AS categories"
    key = "src_ip" if side == "t1" else "dst_ip"
    return f"SELECT x.id, x.hit, x.src_ip, x.dst_ip, x.threat_score, {fields}, {cats} FROM {before} x LEFT JOIN {_T} {side} ON {side}.ip = x.{key}"


_DETAILS = f"""WITH p0 AS (SELECT id, src_ip, dst_ip, coalesce({_TARGETS} AND threat_score IS NOT NULL AND abuse_usage_type IS NULL, false) AS hit, threat_score,
 abuse_usage_type, abuse_hostnames, abuse_total_reports, abuse_is_tor, threat_category_list AS categories FROM logs),
 p1 AS ({_pass('t1', 'p0')}), p2 AS ({_pass('t2', 'p1')}) SELECT * EXCLUDE (hit, src_ip, dst_ip) FROM p2"""


@query("j9_patch_details", "logs threats", _DETAILS)
def patch_details(t):
    return _logs(mt.patch_details(t.logs, t.threats, t.threats.select("ip"), OWN))




@query(
    "j10_patch_refresh", "logs threats",
    f"""SELECT l.id, CASE WHEN t.ip IS NULL THEN l.threat_score ELSE coalesce(t.threat_score, l.threat_score) END AS threat_score,
    CASE WHEN t.ip IS NULL THEN l.abuse_usage_type ELSE t.abuse_usage_type END AS abuse_usage_type, CASE WHEN t.ip IS NULL THEN l.abuse_hostnames ELSE t.abuse_hostnames END AS abuse_hostnames,
    CASE WHEN t.ip IS NULL THEN l.abuse_total_reports ELSE t.abuse_total_reports END AS abuse_total_reports, CASE WHEN t.ip IS NULL THEN l.abuse_is_tor ELSE t.abuse_is_tor END AS abuse_is_tor,
    coalesce(nullif(t.threat_category_list, ''), l.threat_category_list) AS categories
    FROM logs l LEFT JOIN threats t ON t.ip = (SELECT min(ip) FROM threats WHERE ip LIKE '45.0.2%') AND {_TARGETS} AND (l.src_ip = t.ip OR l.dst_ip = t.ip)""",
)
def patch_refresh(t):
    one = t.threats.where("ip LIKE '45.0.2%'").agg(F.min("ip").alias("ip")).first()["ip"]
    return _logs(mt.patch_refresh(t.logs, t.threats, one, OWN))


@query(
    "j11_stale_candidates", "threats",
    f"""SELECT ip FROM threats WHERE threat_score > 0 AND NOT {_ANY.format('threats')} AND looked_up_at < TIMESTAMP '2024-01-24 00:00:00'
    ORDER BY last_seen_at DESC NULLS LAST, threat_score DESC, ip LIMIT 10""",
)
def stale(t):
    return mt.stale_candidates(t.threats, NOW).select("ip")


@query(
    "j12_backfill_services", "logs services",
    """SELECT id, coalesce(l.service_name, CASE WHEN log_type = 'firewall' THEN CASE WHEN s.service_name = 'domain' THEN 'DNS' ELSE s.service_name END END) AS service_name
    FROM logs l LEFT JOIN services s ON s.port = l.dst_port AND s.protocol = coalesce(lower(l.protocol), 'tcp')""",
)
def backfill_services(t):
    return mt.backfill_services(t.logs, t.services).select("id", "service_name")


@query(
    "j14_backfill_direction", "logs",
    f"""SELECT id, CASE WHEN log_type <> 'firewall' THEN direction WHEN src_ip IN {OWN_SQL} AND coalesce(interface_out, '') NOT IN ('br10', 'ppp0') THEN 'local'
    WHEN contains(rule_name, 'DNAT') THEN 'nat' WHEN interface_out IS NULL THEN CASE WHEN interface_in IN ('br10', 'ppp0') THEN 'inbound' ELSE 'local' END
    WHEN interface_in IN ('br10', 'ppp0') AND interface_out NOT IN ('br10', 'ppp0') THEN 'inbound'
    WHEN interface_in NOT IN ('br10', 'ppp0') AND interface_out IN ('br10', 'ppp0') THEN 'outbound'
    WHEN interface_in NOT IN ('br10', 'ppp0') AND interface_in <> interface_out THEN CASE WHEN interface_out LIKE 'wgsrv%' THEN 'vpn' ELSE 'inter_vlan' END
    ELSE 'local' END AS direction FROM logs""",
)
def backfill_direction(t):
    cfg = NetConfig(wan_interfaces=("br10", "ppp0"), wan_ips=OWN)
    return mt.backfill_direction(t.logs, cfg).select("id", "direction")


# A site with many own addresses, some of which appear as sources.
_UPLINKS = tuple(f"45.{m % 7}.{m // 7}.{1 + m + 100 * odd}" for m in range(40) for odd in (0, 1))


@query(
    "j15_repair_wan_enrichment", "logs threats asn_blocks",
    f"""WITH w AS (SELECT id, coalesce(log_type = 'firewall' AND src_ip IN {_UPLINKS} AND geo_country IS NOT NULL AND dst_ip IS NOT NULL, false) AS hit, * EXCLUDE (id) FROM logs),
    x AS (SELECT id, log_type, rule_action, src_ip, dst_ip, CASE WHEN hit THEN NULL ELSE geo_country END AS geo_country, CASE WHEN hit THEN NULL ELSE asn_name END AS asn_name,
     CASE WHEN hit THEN NULL ELSE threat_score END AS threat_score, CASE WHEN hit THEN NULL ELSE abuse_usage_type END AS abuse_usage_type FROM w)
    SELECT id, geo_country, asn_name, threat_score, abuse_usage_type FROM x""",
)
def repair_wan(t):
    cfg = NetConfig(wan_ips=_UPLINKS)
    found = remote_attributes(t.logs.select(F.col("dst_ip").alias("ip")), EnrichmentTables(asn_blocks=keyed_blocks(t.asn_blocks)), NOW)
    out = mt.repair_wan_enrichment(t.logs, found, t.threats, cfg)
    return out.select("id", "geo_country", "asn_name", "threat_score", "abuse_usage_type")


_HOME = ("192.168.20.3", "192.168.20.7", "192.168.30.4")


@query(
    "j16_repair_abuse", "logs threats",
    f"""WITH l AS (SELECT *, coalesce(dst_ip IN {_HOME} AND direction = 'inbound' AND src_ip NOT IN {_HOME} AND (abuse_hostnames IS NOT NULL OR abuse_usage_type IS NOT NULL), false) AS hit FROM logs)
    SELECT l.id, CASE WHEN hit THEN t.threat_score ELSE l.threat_score END AS threat_score, CASE WHEN hit THEN t.abuse_usage_type ELSE l.abuse_usage_type END AS abuse_usage_type,
    CASE WHEN hit THEN t.abuse_hostnames ELSE l.abuse_hostnames END AS abuse_hostnames, CASE WHEN hit THEN t.abuse_total_reports ELSE l.abuse_total_reports END AS abuse_total_reports,
    CASE WHEN hit THEN t.abuse_is_tor ELSE l.abuse_is_tor END AS abuse_is_tor, CASE WHEN hit THEN t.threat_category_list ELSE l.threat_category_list END AS categories
    FROM l LEFT JOIN threats t ON t.ip = l.src_ip AND hit""",
)
def repair_abuse(t):
    return _logs(mt.repair_abuse(t.logs, t.threats, NetConfig(wan_ips=_HOME))[1])


@query(
    "j17_seed_queue", "logs threats queue",
    f"""WITH c AS (SELECT src_ip AS ip FROM logs WHERE {_TARGETS} AND threat_score IS NULL AND src_ip LIKE '45.%' AND src_ip NOT IN {OWN_SQL}
     UNION SELECT dst_ip FROM logs WHERE {_TARGETS} AND threat_score IS NULL AND dst_ip LIKE '45.%' AND dst_ip NOT IN {OWN_SQL}),
    m AS (SELECT ip FROM c WHERE ip NOT IN (SELECT ip FROM threats))
    SELECT coalesce(q.ip, m.ip) AS ip, coalesce(source, 'seed') AS source, coalesce(attempts, 0) AS attempts,
    CASE WHEN m.ip IS NULL THEN {stamp_sql('last_seen_at')} ELSE {_NOW_TEXT} END AS seen,
    CASE WHEN m.ip IS NULL THEN {stamp_sql('next_retry_at')} WHEN q.ip IS NULL THEN {_NOW_TEXT} ELSE {stamp_sql(f'greatest(next_retry_at, {TS_NOW})')} END AS retry
    FROM queue q FULL JOIN m ON m.ip = q.ip""",
)
def seed_queue(t):
    return _queue(mt.seed_queue(t.logs, t.threats, t.queue, CFG, NOW))


_NAMED = """WITH lc AS (SELECT ip, name, last_seen FROM (SELECT ip, coalesce(device_name, hostname, oui) AS name, last_seen, row_number() OVER
  (PARTITION BY ip ORDER BY last_seen DESC NULLS LAST, mac DESC) AS rn FROM clients WHERE coalesce(device_name, hostname, oui) IS NOT NULL) q WHERE rn = 1),
 x AS (SELECT l.id, l.src_device_name AS s0, l.dst_device_name AS d0, timestamp >= TIMESTAMP '2024-01-15 00:00:00' AS recent,
  coalesce(c.device_name, c.hostname, c.oui) AS sn, lc.name AS dn FROM logs l LEFT JOIN clients c ON c.mac = l.mac_address
  LEFT JOIN lc ON lc.ip = l.dst_ip AND l.timestamp >= lc.last_seen - INTERVAL 1 DAY)"""


@query(
    "j18_backfill_names", "logs clients",
    f"""{_NAMED} SELECT id, CASE WHEN recent THEN coalesce(s0, sn) ELSE s0 END AS src_device_name, CASE WHEN recent THEN coalesce(d0, dn) ELSE d0 END AS dst_device_name FROM x""",
)
def backfill_names(t):
    return mt.backfill_names(t.logs, t.clients, "2024-01-15 00:00:00").select("id", "src_device_name", "dst_device_name")


@query(
    "j18_patch_counts", "logs clients",
    f"""{_NAMED} SELECT count(*) FILTER (WHERE recent AND s0 IS NULL AND sn IS NOT NULL) AS src_patched,
    count(*) FILTER (WHERE recent AND d0 IS NULL AND dn IS NOT NULL) AS dst_patched FROM x""",
)
def patch_counts(t):
    return mt.patch_counts(mt.backfill_names(t.logs, t.clients, "2024-01-15 00:00:00"))


@query(
    "j19_upsert_clients", "clients devices",
    f"""WITH b AS (SELECT mac, '10.0.0.9' AS ip, hostname AS device_name, CAST(NULL AS VARCHAR) AS hostname, TIMESTAMP '2024-01-15 00:00:00' AS last_seen FROM clients WHERE is_wired
     UNION ALL SELECT mac, ip, device_name, model, updated_at FROM devices)
    SELECT coalesce(b.mac, c.mac) AS mac, CASE WHEN b.mac IS NULL THEN c.ip ELSE b.ip END AS ip, coalesce(b.device_name, c.device_name) AS device_name,
    coalesce(b.hostname, c.hostname) AS hostname, {stamp_sql('CASE WHEN b.mac IS NULL OR b.last_seen IS NULL THEN c.last_seen WHEN c.last_seen IS NULL OR b.last_seen > c.last_seen THEN b.last_seen ELSE c.last_seen END')} AS last_seen
    FROM clients c FULL JOIN b ON b.mac = c.mac""",
)
def upsert_clients(t):
    wired = t.clients.where("is_wired").select(
        "mac", F.lit("10.0.0.9").alias("ip"), F.col("hostname").alias("device_name"), F.lit(None).cast("string").alias("hostname"),
        F.lit("2024-01-15 00:00:00").cast("timestamp").alias("last_seen"),
    )
    new = t.devices.select("mac", "ip", "device_name", F.col("model").alias("hostname"), F.col("updated_at").alias("last_seen"))
    out = mt.upsert_clients(t.clients, wired.unionByName(new), NOW)
    return out.select("mac", "ip", "device_name", "hostname", stamp("last_seen").alias("last_seen"))


@query(
    "j20_upsert_devices", "devices",
    f"""WITH b AS (SELECT mac, CAST(NULL AS VARCHAR) AS ip, CASE WHEN state % 2 = 0 THEN 'renamed' END AS device_name, CAST(state + 1 AS INT) AS state FROM devices WHERE state < 12)
    SELECT d.mac, CASE WHEN b.mac IS NULL THEN d.ip END AS ip, coalesce(b.device_name, d.device_name) AS device_name, CASE WHEN b.mac IS NULL THEN d.state ELSE b.state END AS state,
    CASE WHEN b.mac IS NULL THEN d.uptime END AS uptime, CASE WHEN b.mac IS NULL THEN {stamp_sql('d.updated_at')} ELSE {_NOW_TEXT} END AS updated_at
    FROM devices d LEFT JOIN b ON b.mac = d.mac""",
)
def upsert_devices(t):
    batch = t.devices.where("state < 12").select(
        "mac", F.lit(None).cast("string").alias("ip"), F.when(F.col("state") % 2 == 0, "renamed").alias("device_name"),
        (F.col("state") + 1).alias("state"), F.lit(None).cast("bigint").alias("uptime"),
    )
    return mt.upsert_devices(t.devices, batch, NOW).select(
        "mac", "ip", "device_name", "state", "uptime", stamp("updated_at").alias("updated_at")
    )


@query(
    "j21_upsert_rdns", "rdns_cache threats",
    f"""SELECT coalesce(t.ip, c.ip) AS ip, CASE WHEN t.ip IS NULL THEN c.hostname ELSE t.abuse_hostnames END AS hostname, CASE WHEN t.ip IS NULL THEN c.status ELSE 'success' END AS status,
    CASE WHEN t.ip IS NULL THEN {stamp_sql('c.looked_up_at')} ELSE {_NOW_TEXT} END AS looked_up_at FROM rdns_cache c FULL JOIN threats t ON t.ip = c.ip""",
)
def upsert_rdns(t):
    batch = t.threats.select("ip", F.col("abuse_hostnames").alias("hostname"), F.lit("success").alias("status"))
    return mt.upsert_rdns(t.rdns_cache, batch, NOW).withColumn("looked_up_at", stamp("looked_up_at"))


@query("j21_sweep_rdns", "rdns_cache", "SELECT ip FROM rdns_cache WHERE looked_up_at >= TIMESTAMP '2024-01-23 00:00:00'")
def sweep_rdns(t):
    return mt.sweep_rdns(t.rdns_cache, NOW).select("ip")


_EXPIRED = "((log_type = 'dns' AND timestamp < TIMESTAMP '2024-01-21 00:00:00') OR (log_type <> 'dns' AND timestamp < TIMESTAMP '2024-01-11 00:00:00'))"


@query("j22_retain", "logs", f"SELECT id, log_type FROM logs WHERE NOT {_EXPIRED}")
def retain(t):
    return retention.retain(t.logs, NOW, 20, 10).select("id", "log_type")


@query(
    "j22_retention_counts", "logs",
    f"""SELECT count(*) FILTER (WHERE log_type = 'dns' AND {_EXPIRED}) AS dns_deleted, count(*) FILTER (WHERE log_type <> 'dns' AND {_EXPIRED}) AS non_dns_deleted,
    count(*) FILTER (WHERE {_EXPIRED}) AS deleted_so_far FROM logs""",
)
def retention_counts(t):
    return retention.retention_counts(t.logs, NOW, 20, 10)


@query(
    "j22_droppable_partitions", "logs",
    """SELECT DISTINCT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS log_date, log_type FROM logs
    WHERE CAST(timestamp AS DATE) + INTERVAL 1 DAY <= CASE WHEN log_type = 'dns' THEN TIMESTAMP '2024-01-21 00:00:00' ELSE TIMESTAMP '2024-01-11 00:00:00' END""",
)
def droppable(t):
    parts = t.logs.select(F.to_date("timestamp").alias("log_date"), "log_type")
    return retention.droppable_partitions(parts, NOW, 20, 10).withColumn("log_date", F.col("log_date").cast("string"))


@query(
    "j23_purge", "logs",
    "SELECT id FROM logs WHERE NOT (log_type = 'wifi' AND id <= (SELECT max(id) FROM logs WHERE log_type = 'wifi' AND timestamp < TIMESTAMP '2024-01-20 00:00:00'))",
)
def purge(t):
    snapshot = retention.purge_snapshot(t.logs.where("timestamp < TIMESTAMP '2024-01-20 00:00:00'"), "wifi").first()
    return retention.purge(t.logs, "wifi", snapshot["max_id"]).select("id")


@query("j24_repair_tz", "logs", f"SELECT id, {stamp_sql('timestamp + INTERVAL 5 HOUR')} AS at FROM logs")
def repair_tz(t):
    return mt.repair_tz(t.logs.select("id", "timestamp"), "America/New_York").select("id", stamp("timestamp").alias("at"))


@query("j25_repair_protocol", "logs", "SELECT id, protocol FROM logs")
def repair_protocol(t):
    return mt.repair_protocol(t.logs.select("id", F.upper("protocol").alias("protocol")))
