"""The log tables as views over the driver's test tables.

Each view is one SQL text that Spark and DuckDB both run and that gives the same
rows in both. ``{name}`` stands for another view or a base table. Every view
covers its whole base table, so the work grows with the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.plans.staging import computed
from netlens.schema import with_category_array

NOW = "2024-01-31 00:00:00"

_LOGS_BASE = """
SELECT event_id AS e, CAST(ts AS TIMESTAMP) AS ts, event_type AS et, value AS v,
 user_id % 100 AS p, (event_id * 7 + user_id) % 280 AS m FROM {events}
"""

_LOGS_KIND = """
SELECT b.*, CAST(floor(m / 7) AS INT) AS q,
 CASE WHEN et = 'purchase' THEN 'dns'
      WHEN et = 'signup' THEN CASE e % 3 WHEN 0 THEN 'dhcp' WHEN 1 THEN 'wifi' ELSE 'system' END
      ELSE 'firewall' END AS lt,
 CASE WHEN et = 'error' THEN 'block' WHEN et = 'click' AND e % 10 = 0 THEN NULL
      WHEN et = 'click' AND e % 10 = 1 THEN 'redirect' ELSE 'allow' END AS act,
 CASE WHEN e % 3 = 0 THEN 'in' WHEN e % 3 = 1 THEN 'out'
      WHEN m % 9 = 0 THEN 'vpn' WHEN m % 10 = 1 THEN 'loc' ELSE 'lan' END AS k,
 '45.' || CAST(m % 7 AS STRING) || '.' || CAST(CAST(floor(m / 7) AS INT) AS STRING) || '.'
   || CAST(1 + m % 50 + 100 * (e % 2) AS STRING) AS pub,
 '192.168.' || CAST(10 * (1 + p % 4) AS STRING) || '.' || CAST(2 + p AS STRING) AS prv,
 'br' || CAST(10 * (1 + p % 4) AS STRING) AS br,
 'aa:bb:cc:00:00:' || lpad(CAST(p AS STRING), 2, '0') AS mac
FROM {logs_base} b
"""

_LOGS_ROW = """
SELECT e AS id, ts AS timestamp, lt AS log_type, e, m, p, v, k, et, q, br,
 CASE WHEN lt <> 'firewall' THEN NULL WHEN act = 'redirect' THEN 'nat' WHEN k = 'in' THEN 'inbound'
      WHEN k = 'out' THEN 'outbound' WHEN k = 'vpn' THEN 'vpn' WHEN k = 'loc' THEN 'local'
      ELSE 'inter_vlan' END AS direction,
 CASE WHEN lt IN ('system', 'wifi') THEN NULL WHEN lt = 'firewall' AND k = 'in' THEN pub ELSE prv END AS src_ip,
 CASE WHEN lt = 'firewall' AND m % 20 <> 0 THEN CAST(20000 + m AS INT) END AS src_port,
 CASE WHEN lt <> 'firewall' THEN NULL WHEN k = 'in' THEN prv WHEN k = 'out' THEN pub
      ELSE '192.168.99.' || CAST(2 + m % 40 AS STRING) END AS dst_ip,
 CASE WHEN lt = 'firewall' AND m % 20 <> 0 THEN CASE m % 5 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80
      WHEN 3 THEN 443 ELSE 8000 + CAST(m % 9 AS INT) END END AS dst_port,
 CASE WHEN lt = 'firewall' THEN CASE WHEN m % 20 = 0 THEN 'icmp' WHEN m % 5 = 1 THEN 'udp' ELSE 'tcp' END END AS protocol,
 CASE WHEN lt = 'firewall' AND m % 20 <> 0 THEN CASE m % 5 WHEN 0 THEN 'ssh' WHEN 1 THEN 'DNS' WHEN 2 THEN 'www'
      WHEN 3 THEN 'https' END END AS service_name,
 CASE WHEN lt <> 'firewall' THEN NULL WHEN act = 'block' THEN 'WAN_LAN-B-' || CAST(4000000000 + m AS STRING)
      WHEN act = 'redirect' THEN 'PREROUTING-DNAT-' || CAST(m AS STRING)
      WHEN act = 'allow' THEN CASE WHEN k = 'loc' THEN 'LAN_LOCAL-A-' ELSE 'LAN_WAN-A-' END || CAST(m AS STRING)
      ELSE 'LAN_WAN-' || CAST(m AS STRING) END AS rule_name,
 CASE WHEN lt <> 'firewall' THEN NULL WHEN act = 'block' THEN '[WAN_LAN]Block scan ' || CAST(m % 4 AS STRING)
      WHEN act = 'allow' THEN '[LAN_WAN]Allow All Traffic' WHEN act = 'redirect' THEN NULL ELSE 'Review' END AS rule_desc,
 CASE WHEN lt = 'firewall' THEN act END AS rule_action,
 CASE WHEN lt = 'dhcp' THEN br WHEN lt <> 'firewall' THEN NULL WHEN k = 'in' THEN 'ppp0' ELSE br END AS interface_in,
 CASE WHEN lt <> 'firewall' OR k = 'loc' THEN NULL WHEN k = 'in' THEN br WHEN k = 'out' THEN 'ppp0'
      WHEN k = 'vpn' THEN 'wgsrv1' ELSE 'br99' END AS interface_out,
 CASE WHEN lt IN ('dhcp', 'wifi') THEN mac END AS mac_address,
 CASE WHEN lt = 'dhcp' THEN 'host' || CAST(p AS STRING) END AS hostname,
 CASE WHEN lt = 'dns' THEN 'host' || CAST(m % 37 AS STRING) || '.example.com' END AS dns_query,
 CASE WHEN lt = 'dns' THEN 'A' END AS dns_type,
 CASE WHEN lt = 'dhcp' THEN 'DHCPACK' END AS dhcp_event,
 CASE WHEN lt = 'wifi' THEN 'associated' END AS wifi_event,
 CASE WHEN lt = 'firewall' AND k IN ('in', 'out') THEN pub END AS remote_ip,
 lt = 'firewall' AND k IN ('in', 'out') AS remote,
 et = 'error' AND k IN ('in', 'out') AND e % 5 <> 0 AS scored
FROM {logs_kind}
"""

_LOGS = """
SELECT id, timestamp, log_type, direction, src_ip, src_port, dst_ip, dst_port, protocol, service_name,
 rule_name, rule_desc, rule_action, interface_in, interface_out, mac_address, hostname,
 dns_query, dns_type, dhcp_event, wifi_event, remote_ip,
 CASE WHEN remote THEN substr('USCNRUDEFRBRNLGB', CAST(1 + 2 * (q % 8) AS INT), 2) END AS geo_country,
 CASE WHEN remote AND q % 3 <> 0 THEN 'City ' || CAST(q % 8 AS STRING) END AS geo_city,
 CASE WHEN remote THEN CAST(q % 8 * 10.5 - 30 AS DECIMAL(9,6)) END AS geo_lat,
 CASE WHEN remote THEN CAST(q % 8 * 20.25 - 80 AS DECIMAL(9,6)) END AS geo_lon,
 CASE WHEN remote THEN CAST(64500 + m % 7 AS INT) END AS asn_number,
 CASE WHEN remote THEN 'ASN-' || CAST(m % 7 AS STRING) END AS asn_name,
 CASE WHEN remote AND m % 3 = 0 THEN 'h' || CAST(m AS STRING) || '.example.net' END AS rdns,
 CASE WHEN scored THEN CAST(floor(v) AS INT) % 101 END AS threat_score,
 CASE WHEN scored AND m % 4 = 1 THEN '14,18' WHEN scored AND m % 4 = 2 THEN '22' END AS threat_category_list,
 CASE WHEN scored AND m % 6 = 1 THEN 'Data Center' END AS abuse_usage_type,
 CASE WHEN scored AND m % 6 = 1 THEN 'mail.example.org' END AS abuse_hostnames,
 CASE WHEN scored AND m % 6 = 1 THEN CAST(m AS INT) END AS abuse_total_reports,
 CASE WHEN scored AND m % 6 = 1 THEN TIMESTAMP '2024-01-02 03:04:05' END AS abuse_last_reported,
 CASE WHEN scored AND m % 6 = 1 THEN m % 12 = 1 END AS abuse_is_whitelisted,
 CASE WHEN scored AND m % 6 = 1 THEN m % 18 = 1 END AS abuse_is_tor,
 CASE WHEN e % 50 = 7 AND log_type = 'dhcp' THEN 'named-' || CAST(p AS STRING) END AS src_device_name,
 CASE WHEN e % 50 = 9 AND log_type = 'firewall' THEN 'target-' || CAST(p AS STRING) END AS dst_device_name,
 'Jan ' || lpad(CAST(day(timestamp) AS STRING), 2, ' ') || ' ' || lpad(CAST(hour(timestamp) AS STRING), 2, '0') || ':' ||
 lpad(CAST(minute(timestamp) AS STRING), 2, '0') || ':' || lpad(CAST(second(timestamp) AS STRING), 2, '0') || ' GW ' ||
 CASE log_type
  WHEN 'firewall' THEN 'kernel: [' || rule_name || ']' || coalesce(' DESCR="' || rule_desc || '" ', '') ||
   'IN=' || interface_in || ' OUT=' || coalesce(interface_out, '') ||
   ' SRC=' || src_ip || ' DST=' || dst_ip || ' PROTO=' || upper(protocol) ||
   coalesce(' SPT=' || CAST(src_port AS STRING) || ' DPT=' || CAST(dst_port AS STRING), '')
  WHEN 'dns' THEN 'dnsmasq[77]: query[A] ' || dns_query || ' from ' || src_ip
  WHEN 'dhcp' THEN 'dnsmasq-dhcp[77]: DHCPACK(' || interface_in || ') ' || src_ip || ' ' || mac_address || ' host' || CAST(p AS STRING)
  WHEN 'wifi' THEN 'hostapd: ath0: STA ' || mac_address || ' IEEE 802.11: associated'
  ELSE 'systemd[1]: unit ' || CAST(e AS STRING) || ' started' END AS raw_log
FROM {logs_row}
"""

# Customers stand for client devices: 100 addresses shared by all of them.
_CLIENTS = """
SELECT 'aa:bb:cc:' || lpad(CAST(CAST(floor(c_custkey / 10000) AS INT) AS STRING), 2, '0') || ':'
   || lpad(CAST(CAST(floor(c_custkey / 100) AS INT) % 100 AS STRING), 2, '0') || ':'
   || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') AS mac,
 '192.168.' || CAST(10 * (1 + c_custkey % 100 % 4) AS STRING) || '.' || CAST(2 + c_custkey % 100 AS STRING) AS ip,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS device_name,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'host-' || CAST(c_custkey AS STRING) END AS hostname,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS oui,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'net-' || CAST(c_nationkey AS STRING) END AS network,
 CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE CAST(10 * (1 + c_custkey % 4) AS INT) END AS vlan,
 c_custkey % 2 = 0 AS is_wired,
 CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST('2024-01-' || lpad(CAST(1 + c_custkey % 30 AS STRING), 2, '0')
   || ' 0' || CAST(c_custkey % 10 AS STRING) || ':00:00' AS TIMESTAMP) END AS last_seen
FROM {customer}
"""

_DEVICES = """
SELECT 'cc:dd:ee:' || lpad(CAST(CAST(floor(s_suppkey / 10000) AS INT) AS STRING), 2, '0') || ':'
   || lpad(CAST(CAST(floor(s_suppkey / 100) AS INT) % 100 AS STRING), 2, '0') || ':'
   || lpad(CAST(s_suppkey % 100 AS STRING), 2, '0') AS mac,
 '192.168.99.' || CAST(2 + s_suppkey % 40 AS STRING) AS ip,
 CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS device_name,
 'M' || CAST(s_nationkey AS STRING) AS model,
 CAST(s_nationkey AS INT) AS state, CAST(floor(abs(s_acctbal)) AS BIGINT) AS uptime,
 CAST('2024-01-' || lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0') || ' 00:00:00' AS TIMESTAMP) AS updated_at
FROM {supplier}
"""

# One reputation row per address; several customers may fall on one address.
_THREATS = """
SELECT ip, max(s) AS threat_score,
 CASE WHEN max(s) % 4 = 0 THEN NULL WHEN max(s) % 4 = 1 THEN '' WHEN max(s) % 4 = 2 THEN '18'
      ELSE '4,14' END AS threat_category_list,
 CASE WHEN max(s) % 3 = 0 THEN NULL ELSE max(seg) END AS abuse_usage_type,
 CASE WHEN max(s) % 3 = 1 THEN 'rep.example.org' END AS abuse_hostnames,
 CASE WHEN max(s) % 3 = 0 THEN NULL ELSE CAST(max(s) * 3 AS INT) END AS abuse_total_reports,
 CASE WHEN max(s) % 3 = 1 THEN TIMESTAMP '2024-01-05 06:07:08' END AS abuse_last_reported,
 CASE WHEN max(s) % 3 = 1 THEN max(s) % 2 = 0 END AS abuse_is_whitelisted,
 CASE WHEN max(s) % 3 = 1 THEN max(s) % 5 = 0 END AS abuse_is_tor,
 max(looked) AS looked_up_at,
 CASE WHEN max(s) % 5 = 0 THEN NULL ELSE max(looked) END AS last_seen_at
FROM (
 SELECT '45.' || CAST(m % 7 AS STRING) || '.' || CAST(CAST(floor(m / 7) AS INT) AS STRING) || '.'
   || CAST(1 + m % 50 + 50 * (a % 4) AS STRING) AS ip, CAST(a % 101 AS INT) AS s, seg,
   CAST('2024-01-' || lpad(CAST(1 + c % 30 AS STRING), 2, '0') || ' 00:00:00' AS TIMESTAMP) AS looked
 FROM (SELECT c_custkey AS c, c_custkey % 280 AS m, CAST(floor(abs(c_acctbal)) AS INT) AS a,
        c_mktsegment AS seg FROM {customer}) x
) y GROUP BY ip
"""

# /24 blocks with gaps, inside a few /16 blocks: the longest prefix must win.
_ASN_BLOCKS = """
SELECT DISTINCT CAST(45 AS BIGINT) * 16777216 + m % 7 * 65536 + CAST(floor(m / 7) AS INT) * 256 AS start_num,
 CAST(45 AS BIGINT) * 16777216 + m % 7 * 65536 + CAST(floor(m / 7) AS INT) * 256 + 255 AS end_num,
 24 AS prefix_len, 'ASN-' || CAST(m % 7 AS STRING) AS asn_name
FROM (SELECT s_suppkey % 280 AS m FROM {supplier}) s
UNION ALL
SELECT CAST(45 AS BIGINT) * 16777216 + r_regionkey * 65536 AS start_num,
 CAST(45 AS BIGINT) * 16777216 + r_regionkey * 65536 + 65535 AS end_num,
 16 AS prefix_len, 'NET-' || r_name AS asn_name
FROM {region}
"""

_RDNS_CACHE = """
SELECT ip, max(host) AS hostname, CASE max(st) WHEN 0 THEN 'success' WHEN 1 THEN 'failure' ELSE 'transient' END AS status,
 max(looked) AS looked_up_at
FROM (
 SELECT '45.' || CAST(m % 7 AS STRING) || '.' || CAST(CAST(floor(m / 7) AS INT) AS STRING) || '.'
   || CAST(1 + m % 50 + 100 * (p_size % 2) AS STRING) AS ip,
   'ptr' || CAST(p_partkey AS STRING) || '.example.net' AS host, m % 3 AS st,
   CAST('2024-01-' || lpad(CAST(20 + p_size % 11 AS STRING), 2, '0') || ' ' || lpad(CAST(p_size % 24 AS STRING), 2, '0')
     || ':30:00' AS TIMESTAMP) AS looked
 FROM (SELECT p_partkey, p_size, p_partkey % 280 AS m FROM {part}) x
) y GROUP BY ip
"""

_QUEUE = """
SELECT ip, CASE WHEN count(*) % 2 = 0 THEN 'live_miss' ELSE 'seed' END AS source,
 min(ts) AS first_seen_at, max(ts) AS last_seen_at,
 CASE WHEN count(*) % 3 = 0 THEN TIMESTAMP '2024-01-31 06:00:00' ELSE max(ts) END AS next_retry_at,
 CAST(count(*) % 9 AS INT) AS attempts
FROM (
 SELECT '45.' || CAST(m % 7 AS STRING) || '.' || CAST(CAST(floor(m / 7) AS INT) AS STRING) || '.'
   || CAST(1 + m % 50 + 50 * (k % 4) AS STRING) AS ip,
   CAST('2024-01-' || lpad(CAST(1 + k % 30 AS STRING), 2, '0') || ' 12:00:00' AS TIMESTAMP) AS ts
 FROM (SELECT o_custkey % 280 AS m, o_orderkey AS k FROM {orders}) x
) y GROUP BY ip
"""

_AUDIT = """
SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE 'tok-' || CAST(o_custkey % 25 AS STRING) END AS token_id,
 CASE o_orderstatus WHEN 'F' THEN 'login' ELSE 'api_call' END AS action,
 CASE WHEN o_orderkey % 13 = 0 THEN 'not json' ELSE '{{"tool_name":"t' || CAST(o_orderkey % 5 AS STRING)
  || '","scope":"logs.read","success":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '}}' END AS detail,
 CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM {orders}
"""

_TOKENS = """
SELECT 'tok-' || CAST(n_nationkey AS STRING) AS id, n_name AS name, substr(n_name, 1, 4) AS token_prefix FROM {nation}
"""

# Records a DNS resolver reports, flat; ``Tables.dns_records`` nests them.
_DNS_FLAT = """
SELECT event_id AS id, epoch_us, upper(qt) AS type, domain, status, client_ip, client_name, reply_type FROM (
 SELECT event_id, event_id AS epoch_us,
  CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'A' ELSE 'PTR' END AS qt,
  CASE WHEN event_id % 23 = 0 THEN '' ELSE 'host' || CAST(user_id AS STRING) || '.example.com' END AS domain,
  CASE WHEN event_type = 'error' THEN 'GRAVITY' WHEN event_type = 'click' THEN 'CACHE'
       WHEN event_type = 'view' THEN 'forwarded' WHEN event_type = 'signup' THEN 'DENYLIST' ELSE 'OTHER' END AS status,
  '192.168.10.' || CAST(1 + user_id % 200 AS STRING) AS client_ip,
  CASE WHEN user_id % 2 = 0 THEN 'pc' || CAST(user_id AS STRING) END AS client_name,
  CASE event_id % 6 WHEN 0 THEN 'NXDOMAIN' WHEN 1 THEN NULL ELSE 'IP' END AS reply_type
 FROM {events}
) x
"""

_DNS_ANSWERS = """
SELECT 'host' || CAST(c_custkey AS STRING) || '.example.com' AS domain,
 CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'AAAA' END AS qtype,
 CASE WHEN c_custkey % 5 = 0 THEN '10.0.0.' ELSE '45.0.0.' END || CAST(1 + c_custkey % 200 AS STRING) AS answer
FROM {customer}
"""

_SERVICES = """
SELECT 22 AS port, 'tcp' AS protocol, 'ssh' AS service_name, 'The Secure Shell Protocol' AS description
UNION ALL SELECT 53, 'udp', 'domain', 'Domain Name Server'
UNION ALL SELECT 53, 'tcp', 'domain', 'Domain Name Server'
UNION ALL SELECT 80, 'tcp', 'www', 'World Wide Web HTTP'
UNION ALL SELECT 443, 'tcp', 'https', 'http protocol over TLS/SSL'
UNION ALL SELECT 8000, 'tcp', 'irdmi', CAST(NULL AS STRING)
UNION ALL SELECT 8008, 'tcp', 'http-alt', 'HTTP Alternate'
"""

VIEWS = {
    "logs_base": _LOGS_BASE, "logs_kind": _LOGS_KIND, "logs_row": _LOGS_ROW, "logs": _LOGS,
    "clients": _CLIENTS, "devices": _DEVICES, "threats": _THREATS, "asn_blocks": _ASN_BLOCKS,
    "rdns_cache": _RDNS_CACHE, "queue": _QUEUE, "audit": _AUDIT, "tokens": _TOKENS,
    "dns_flat": _DNS_FLAT, "dns_answers": _DNS_ANSWERS, "services": _SERVICES,
}
_KIND_COLUMNS = ("q", "lt", "act", "k", "pub", "prv", "br", "mac")
BASE_TABLES = ("events", "customer", "supplier", "region", "nation", "orders", "part")

_NEEDS = {
    name: [other for other in (*VIEWS, *BASE_TABLES) if "{" + other + "}" in text]
    for name, text in VIEWS.items()
}


def _same_names(text: str) -> str:
    names = {n: n for n in (*VIEWS, *BASE_TABLES)}
    return text.format(**names)


def with_views(views: list[str], query: str) -> str:
    """``query`` prefixed with the views it reads, for the SQL oracle."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for need in _NEEDS[name]:
                visit(need)
            ordered.append(name)

    for view in views:
        visit(view)
    if not ordered:
        return query
    clauses = ",\n".join(f"{name} AS ({_same_names(VIEWS[name]).strip()})" for name in ordered)
    query = query.strip()
    if query.upper().startswith("WITH "):
        return f"WITH {clauses},\n{query[5:]}"
    return f"WITH {clauses}\n{query}"


class Tables:
    """The views as DataFrames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        needs = {n: self._view(n) if n in VIEWS else self.base(n) for n in _NEEDS[name]}
        df = self.spark.sql(VIEWS[name], **needs)
        # The building blocks of a log row are used many times: compute them once.
        return computed(df, {c: F.col(c) for c in _KIND_COLUMNS}) if name == "logs_kind" else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self._view(name)
        raise AttributeError(name)

    @cached_property
    def logs(self) -> DataFrame:
        return with_category_array(self._view("logs"))

    @cached_property
    def lines(self) -> DataFrame:
        """Raw lines as a source delivers them: plain values, not expressions."""
        rows = self._view("logs").select("id", "raw_log").where(F.col("raw_log").isNotNull())
        return computed(rows, {"raw_log": F.col("raw_log")})

    @cached_property
    def threats(self) -> DataFrame:
        return with_category_array(self._view("threats"))
