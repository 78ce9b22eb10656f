"""Parsing queries (section 2.B) and the DNS source (A2-A4): raw lines made from the
log rows must parse back to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.config import NetConfig
from netlens.contract.common import NOW, stamp, stamp_sql
from netlens.contract.registry import query
from netlens.fixtures import Tables
from netlens.functions import rules
from netlens.plans import parse
from netlens.plans.staging import computed
from netlens.sources import dns_queries as dq

CFG = NetConfig()


def _parsed(t: Tables):
    return parse.parse_syslog(t.lines, CFG, NOW, t.services)


@query(
    "b1_header", "logs",
    f"""SELECT id, 'Jan' AS month, CAST(day(timestamp) AS VARCHAR) AS day, strftime(timestamp, '%H:%M:%S') AS time, 'GW' AS host,
    len(raw_log) - 19 AS body_length FROM logs WHERE raw_log IS NOT NULL""",
)
def header(t):
    h = computed(t.lines, {"h": parse.split_header("raw_log")})
    return h.select("id", "h.month", "h.day", "h.time", "h.host", F.length("h.body").cast("bigint").alias("body_length"))


@query("b2_timestamp", "logs", f"SELECT id, {stamp_sql('timestamp')} AS at FROM logs WHERE raw_log IS NOT NULL")
def timestamp(t):
    return _parsed(t).select("id", stamp("timestamp").alias("at"))


@query("b3_log_type", "logs", "SELECT id, log_type FROM logs WHERE raw_log IS NOT NULL")
def log_type(t):
    h = computed(t.lines, {"h": parse.split_header("raw_log")})
    return h.select("id", parse.log_type_of("h.body").alias("log_type"))


_FIREWALL = "log_type = 'firewall' AND raw_log IS NOT NULL"


@query(
    "b4_firewall_fields", "logs",
    f"""SELECT id, rule_name, rule_desc, interface_in, interface_out, src_ip, src_port, dst_ip, dst_port, protocol FROM logs WHERE {_FIREWALL}""",
)
def firewall(t):
    return _parsed(t).where("log_type = 'firewall'").select(
        "id", "rule_name", "rule_desc", "interface_in", "interface_out", "src_ip", "src_port", "dst_ip", "dst_port", "protocol"
    )


@query(
    "b6_dns_fields", "logs",
    "SELECT id, dns_type, dns_query, src_ip FROM logs WHERE log_type = 'dns'",
)
def dns(t):
    return _parsed(t).where("log_type = 'dns'").select("id", "dns_type", "dns_query", "src_ip")


@query(
    "b7_dhcp_fields", "logs",
    "SELECT id, interface_in, src_ip, mac_address, hostname, dhcp_event FROM logs WHERE log_type = 'dhcp'",
)
def dhcp(t):
    return _parsed(t).where("log_type = 'dhcp'").select("id", "interface_in", "src_ip", "mac_address", "hostname", "dhcp_event")


@query("b8_wifi_fields", "logs", "SELECT id, mac_address, wifi_event FROM logs WHERE log_type = 'wifi'")
def wifi(t):
    return _parsed(t).where("log_type = 'wifi'").select("id", "mac_address", "wifi_event")


_DIRECTION = """CASE WHEN contains(rule_name, 'DNAT') THEN 'nat' WHEN interface_out IS NULL THEN CASE WHEN interface_in = 'ppp0' THEN 'inbound' ELSE 'local' END
 WHEN interface_in = 'ppp0' AND interface_out <> 'ppp0' THEN 'inbound' WHEN interface_in <> 'ppp0' AND interface_out = 'ppp0' THEN 'outbound'
 WHEN interface_in <> interface_out THEN CASE WHEN interface_out LIKE 'wgsrv%' THEN 'vpn' ELSE 'inter_vlan' END ELSE 'local' END"""
# LAN_WAN-<n> is a zone-index name whose action only its description can tell.
_ACTION = """CASE WHEN contains(rule_name, 'DNAT') THEN 'redirect' WHEN rule_name LIKE '%-A-%' THEN 'allow' WHEN rule_name LIKE '%-B-%' THEN 'block' END"""


@query(
    "b12_b14_derived", "logs",
    f"""SELECT id, {_DIRECTION} AS direction, {_ACTION} AS rule_action,
    CASE WHEN dst_port = 22 AND protocol = 'tcp' THEN 'ssh' WHEN dst_port = 53 THEN 'DNS' WHEN dst_port = 80 THEN 'www' WHEN dst_port = 443 THEN 'https'
     WHEN dst_port = 8000 AND protocol = 'tcp' THEN 'irdmi' WHEN dst_port = 8008 AND protocol = 'tcp' THEN 'http-alt' END AS service_name
    FROM logs WHERE {_FIREWALL}""",
)
def derived(t):
    return _parsed(t).where("log_type = 'firewall'").select("id", "direction", "rule_action", "service_name")


@query(
    "b13_rule_parse", "logs",
    """SELECT rule_name, CASE WHEN contains(rule_name, 'DNAT') THEN 'redirect' WHEN regexp_matches(rule_name, '-[AB]-') THEN 'legacy' ELSE 'zone_index' END AS format,
    CASE WHEN contains(rule_name, 'DNAT') THEN rule_name ELSE split_part(rule_name, '-', 1) END AS chain,
    CASE WHEN NOT contains(rule_name, 'DNAT') THEN CAST(string_split(rule_name, '-')[-1] AS BIGINT) END AS index, count(*) AS n
    FROM logs WHERE rule_name IS NOT NULL GROUP BY 1""",
)
def rule(t):
    rows = t.logs.where(F.col("rule_name").isNotNull()).groupBy("rule_name").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("r", rules.rule_parse("rule_name")).select("rule_name", "r.format", "r.chain", "r.index", "n")


@query(
    "b15_action_word", "logs",
    """SELECT rule_desc, CASE WHEN rule_desc ILIKE '%block%' THEN 'block' WHEN rule_desc ILIKE '%allow%' THEN 'allow' END AS word, count(*) AS n
    FROM logs GROUP BY 1""",
)
def word(t):
    rows = t.logs.groupBy("rule_desc").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("word", rules.action_word("rule_desc"))


@query("b17_drop_disabled", "logs", "SELECT log_type, count(*) AS n FROM logs WHERE log_type NOT IN ('wifi', 'system') AND raw_log IS NOT NULL GROUP BY 1")
def disabled(t):
    return parse.drop_disabled(_parsed(t), ["wifi", "system", "dns"]).groupBy("log_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b18_learned_wan_ips", "logs",
    "SELECT DISTINCT dst_ip AS wan_ip FROM logs WHERE log_type = 'firewall' AND interface_in = 'br10' AND dst_ip LIKE '45.%'",
)
def learned(t):
    rows = t.logs.where("log_type = 'firewall'").withColumn("rule_name", F.concat(F.lit("WAN_LOCAL-"), F.coalesce("rule_name", F.lit(""))))
    return parse.learn_wan_ips(rows, ["br10"])


@query(
    "b1_quarantine", "logs",
    "SELECT 'header' AS reason, count(*) AS n FROM logs WHERE raw_log IS NOT NULL AND id % 2 = 1",
)
def quarantine(t):
    # Every other line loses its date, the rest gets a priority prefix.
    lines = t.lines.select(
        F.when(F.col("id") % 2 == 1, F.expr("substring(raw_log, 8)")).otherwise(F.concat(F.lit("<13>"), F.col("raw_log"))).alias("raw_log")
    )
    bad = parse.quarantine(parse.parse_lines(lines, CFG, NOW))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def dns_records(t: Tables):
    return t.dns_flat.select(
        "id", (F.lit(1_704_067_200.0) + F.col("epoch_us")).alias("time"), "type", "domain", "status",
        F.struct(F.col("client_ip").alias("ip"), F.col("client_name").alias("name")).alias("client"),
        F.struct(F.col("reply_type").alias("type")).alias("reply"),
    )


@query("a2_new_records", "dns_flat", "SELECT id FROM dns_flat WHERE id > 400")
def new_records(t):
    twice = dns_records(t).unionByName(dns_records(t))
    return dq.new_records(twice, 400, NOW).select("id")


@query("a2_first_run", "dns_flat", "SELECT CAST(max(id) AS BIGINT) AS cursor, count(*) AS n FROM dns_flat WHERE id > 0 AND id >= 600 - 300")
def first_run(t):
    new = dq.new_records(dns_records(t), 0, "2024-01-01 00:10:00")
    return new.agg(F.max("id").alias("cursor"), F.count(F.lit(1)).alias("n"))


_OK = """upper(status) NOT IN ('GRAVITY', 'DENYLIST') AND type IN ('A', 'AAAA') AND coalesce(reply_type, '') <> 'NXDOMAIN'"""


@query("a4_resolution_candidates", "dns_flat", f"SELECT DISTINCT domain, type AS qtype FROM dns_flat WHERE {_OK} AND domain <> ''")
def candidates(t):
    return dq.dns_resolution_candidates(dns_records(t))


@query(
    "a3_map_dns_query", "dns_flat dns_answers",
    f"""SELECT d.id, {stamp_sql("TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * d.epoch_us")} AS at, client_ip AS src_ip, client_name AS src_device_name,
    CASE WHEN {_OK} THEN answer END AS dns_answer, CASE WHEN {_OK} AND answer NOT LIKE '10.%' THEN answer END AS dst_ip, nullif(d.domain, '') AS dns_query,
    d.type AS dns_type, upper(status) AS rule_desc, CASE WHEN upper(status) IN ('GRAVITY', 'DENYLIST') THEN 'block' ELSE 'allow' END AS rule_action
    FROM dns_flat d LEFT JOIN dns_answers a ON a.domain = d.domain AND a.qtype = d.type""",
)
def mapped(t):
    out = dq.map_dns_query(dns_records(t), t.dns_answers, NOW)
    return out.select(
        "id", stamp("timestamp").alias("at"), "src_ip", "src_device_name", "dns_answer", "dst_ip", "dns_query", "dns_type", "rule_desc", "rule_action"
    )
