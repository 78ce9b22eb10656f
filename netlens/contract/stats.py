"""Dashboard queries (section 2.F, F1-F18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.contract.common import LC_WEEK, MONTH, NOW, OWN, OWN_SQL, SINCE_MONTH, SINCE_WEEK, WEEK, joined, public, stamp, stamp_sql
from netlens.contract.registry import query
from netlens.operators import stats
from netlens.operators.filters import TimeWindow

COUNT = "count(*) AS count"
TOP = "ORDER BY count DESC, {} LIMIT 10"


@query(
    "f1_overview", "logs",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE log_type = 'firewall' AND rule_action = 'allow') AS allowed,
    count(*) FILTER (WHERE rule_action = 'block') AS blocked, count(*) FILTER (WHERE threat_score > 50) AS threats
    FROM logs WHERE {SINCE_WEEK}""",
)
def overview(t):
    return stats.overview(t.logs, WEEK, NOW)


@query("f2_by_type", "logs", f"SELECT log_type, {COUNT} FROM logs WHERE {SINCE_WEEK} GROUP BY 1")
def by_type(t):
    return stats.by_type(t.logs, WEEK, NOW)


@query("f3_by_direction", "logs", f"SELECT direction, {COUNT} FROM logs WHERE {SINCE_WEEK} AND direction IS NOT NULL GROUP BY 1")
def by_direction(t):
    return stats.by_direction(t.logs, WEEK, NOW)


_COUNTRY = "SELECT geo_country AS country, count(*) AS count FROM logs WHERE {} AND geo_country IS NOT NULL AND {} GROUP BY 1 " + TOP.format("country")


@query("f4_top_blocked_countries", "logs", _COUNTRY.format(SINCE_MONTH, "rule_action = 'block'"))
def blocked_countries(t):
    return stats.top_countries(t.logs, MONTH, NOW, "block")


@query("f5_top_allowed_countries", "logs", _COUNTRY.format(SINCE_MONTH, "rule_action = 'allow' AND direction = 'outbound'"))
def allowed_countries(t):
    return stats.top_countries(t.logs, MONTH, NOW, "allow")


@query(
    "f6_top_countries_both", "logs",
    f"""WITH c AS (SELECT rule_action, geo_country AS country, count(*) AS count FROM logs
    WHERE {SINCE_MONTH} AND geo_country IS NOT NULL
     AND (rule_action = 'block' OR (rule_action = 'allow' AND direction = 'outbound')) GROUP BY 1, 2)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rule_action ORDER BY count DESC, country) AS INT) AS rank FROM c) q
    WHERE rank <= 10""",
)
def countries_both(t):
    return stats.top_countries_both(t.logs, MONTH, NOW)


_SERVICE = "SELECT service_name, count(*) AS count FROM logs WHERE {} AND service_name IS NOT NULL AND rule_action = '{}' GROUP BY 1 " + TOP.format("service_name")


@query("f7_top_blocked_services", "logs", _SERVICE.format(SINCE_MONTH, "block"))
def blocked_services(t):
    return stats.top_services(t.logs, MONTH, NOW, "block")


@query("f8_top_allowed_services", "logs", _SERVICE.format(SINCE_MONTH, "allow"))
def allowed_services(t):
    return stats.top_services(t.logs, MONTH, NOW, "allow")


@query(
    "f9_top_services_both", "logs",
    f"""WITH c AS (SELECT rule_action, service_name, count(*) AS count FROM logs
    WHERE {SINCE_MONTH} AND service_name IS NOT NULL AND rule_action IN ('block', 'allow') GROUP BY 1, 2)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rule_action ORDER BY count DESC, service_name) AS INT) AS rank FROM c) q
    WHERE rank <= 10""",
)
def services_both(t):
    return stats.top_services_both(t.logs, MONTH, NOW)


@query(
    "f10_top_blocked_external", "logs",
    f"""SELECT src_ip AS ip, {COUNT}, max(geo_country) AS country, max(asn_name) AS asn, max(threat_score) AS threat_score
    FROM logs WHERE {SINCE_MONTH} AND rule_action = 'block' AND src_ip NOT IN {OWN_SQL} AND {public('src_ip')}
    GROUP BY 1 {TOP.format('ip')}""",
)
def blocked_external(t):
    return stats.top_blocked_external(t.logs, MONTH, NOW, OWN)


def _internal(action: str, extra: str = "") -> str:
    return f"""WITH lc AS ({LC_WEEK}), top AS (SELECT src_ip AS ip, {COUNT} FROM logs
    WHERE {SINCE_WEEK} AND rule_action = '{action}' AND src_ip IS NOT NULL AND NOT {public('src_ip')} {extra}
    GROUP BY 1 {TOP.format('ip')})
    SELECT top.ip, top.count, lc.name AS device_name FROM top LEFT JOIN lc ON lc.ip = top.ip"""


@query("f11_top_blocked_internal", "logs clients", _internal("block"))
def blocked_internal(t):
    return stats.top_blocked_internal(t.logs, t.clients, WEEK, NOW)


@query(
    "f12_top_threats", "logs threats",
    f"""WITH top AS (SELECT src_ip AS ip, {COUNT}, max(geo_country) AS country, max(asn_name) AS asn, max(geo_city) AS city,
     max(rdns) AS rdns, max(threat_score) AS threat_score, max(threat_category_list) AS cats, max(timestamp) AS seen
    FROM logs WHERE {SINCE_MONTH} AND threat_score > 50 AND src_ip IS NOT NULL AND src_ip NOT IN {OWN_SQL} GROUP BY 1
    ORDER BY threat_score DESC, count DESC, ip LIMIT 10)
    SELECT top.ip, count, country, asn, city, rdns, top.threat_score, {stamp_sql('seen')} AS last_seen,
     coalesce(cats, threats.threat_category_list) AS categories
    FROM top LEFT JOIN threats ON threats.ip = top.ip""",
)
def threats(t):
    top = stats.top_threats(t.logs, t.threats, MONTH, NOW, OWN)
    return top.withColumn("categories", joined("threat_categories")).withColumn("last_seen", stamp("last_seen")).drop("threat_categories")


@query(
    "f13_top_allowed_destinations", "logs",
    f"""SELECT dst_ip AS ip, {COUNT}, max(geo_country) AS country, max(asn_name) AS asn FROM logs
    WHERE {SINCE_MONTH} AND rule_action = 'allow' AND dst_ip NOT IN {OWN_SQL} AND {public('dst_ip')} GROUP BY 1 {TOP.format('ip')}""",
)
def allowed_dst(t):
    return stats.top_allowed_dst(t.logs, MONTH, NOW, OWN)


GATEWAYS = ("192.168.10.2", "192.168.20.3")


@query("f14_top_active_internal", "logs clients", _internal("allow", f"AND src_ip NOT IN {GATEWAYS}"))
def active_internal(t):
    return stats.top_active_internal(t.logs, t.clients, WEEK, NOW, GATEWAYS)


@query(
    "f15_top_dns", "logs",
    f"SELECT dns_query, {COUNT} FROM logs WHERE {SINCE_MONTH} AND log_type = 'dns' AND dns_query IS NOT NULL GROUP BY 1 {TOP.format('dns_query')}",
)
def dns(t):
    return stats.top_dns(t.logs, MONTH, NOW)


for _preset, _unit, _since in (
    ("24h", "hour", "2024-01-30 00:00:00"), ("7d", "day", "2024-01-24 00:00:00"),
    ("90d", "week", "2023-11-02 00:00:00"), ("365d", "month", "2023-01-31 00:00:00"),
):

    @query(
        f"f16_over_time_{_unit}", "logs",
        f"SELECT {stamp_sql(f'''date_trunc('{_unit}', timestamp)''')} AS period, {COUNT} FROM logs"
        f" WHERE timestamp >= TIMESTAMP '{_since}' GROUP BY 1",
    )
    def over_time(t, preset=_preset):
        return stats.over_time(t.logs, TimeWindow(preset), NOW).withColumn("period", stamp("period"))


@query(
    "f17_action_over_time", "logs",
    f"""SELECT {stamp_sql("date_trunc('day', timestamp)")} AS period, count(*) FILTER (WHERE rule_action = 'allow') AS "allow",
    count(*) FILTER (WHERE rule_action = 'block') AS block, count(*) FILTER (WHERE rule_action = 'redirect') AS redirect
    FROM logs WHERE {SINCE_MONTH} AND log_type = 'firewall' AND rule_action IS NOT NULL GROUP BY 1""",
)
def action_over_time(t):
    return stats.action_over_time(t.logs, MONTH, NOW).withColumn("period", stamp("period"))


_IP_METRICS = "max(geo_country) AS country, max(asn_name) AS asn, max(threat_score) AS threat_score"
_NO_METRICS = "CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS asn, CAST(NULL AS INT) AS threat_score"


def _section(name: str, key: str, where: str, metrics: str = _NO_METRICS, first: str = "") -> str:
    return f"""SELECT '{name}' AS section, CAST(row_number() OVER (ORDER BY {first} count DESC, key) AS INT) AS rank, key, count,
    country, asn, threat_score FROM (SELECT {key} AS key, count(*) AS count, {metrics} FROM logs
    WHERE {SINCE_WEEK} AND {key} IS NOT NULL AND {where} GROUP BY 1) {name}_q"""


_SECTIONS = [
    _section("top_blocked_countries", "geo_country", "rule_action = 'block'"),
    _section("top_allowed_countries", "geo_country", "rule_action = 'allow' AND direction = 'outbound'"),
    _section("top_blocked_services", "service_name", "rule_action = 'block'"),
    _section("top_allowed_services", "service_name", "rule_action = 'allow'"),
    _section("top_blocked_ips", "src_ip", f"rule_action = 'block' AND src_ip NOT IN {OWN_SQL} AND {public('src_ip')}", _IP_METRICS),
    _section("top_blocked_internal_ips", "src_ip", f"rule_action = 'block' AND NOT {public('src_ip')}"),
    _section("top_threat_ips", "src_ip", f"threat_score > 50 AND src_ip NOT IN {OWN_SQL}", _IP_METRICS, "threat_score DESC,"),
    _section("top_allowed_destinations", "dst_ip", f"rule_action = 'allow' AND dst_ip NOT IN {OWN_SQL} AND {public('dst_ip')}", _IP_METRICS),
    _section("top_active_internal_ips", "src_ip", f"rule_action = 'allow' AND NOT {public('src_ip')} AND src_ip NOT IN {GATEWAYS}"),
    _section("top_dns", "dns_query", "log_type = 'dns'"),
]


@query(
    "f18_tables_bundle", "logs clients",
    f"""WITH lc AS ({LC_WEEK}), s AS ({' UNION ALL '.join(_SECTIONS)})
    SELECT s.*, CASE WHEN section IN ('top_blocked_internal_ips', 'top_active_internal_ips') THEN lc.name END AS device_name
    FROM s LEFT JOIN lc ON lc.ip = s.key WHERE rank <= 10""",
)
def tables_bundle(t):
    return stats.dashboard(t.logs, t.clients, WEEK, NOW, OWN, GATEWAYS, stats.TABLE_SECTIONS)


@query(
    "f18_charts_bundle", "logs",
    f"""SELECT 'logs_over_time' AS section, {stamp_sql("date_trunc('day', timestamp)")} AS key, count(*) AS count FROM logs
    WHERE {SINCE_WEEK} GROUP BY 2
    UNION ALL SELECT 'traffic_by_action', {stamp_sql("date_trunc('day', timestamp)")} || '|' || rule_action, count(*) FROM logs
    WHERE {SINCE_WEEK} AND log_type = 'firewall' AND rule_action IS NOT NULL GROUP BY 2""",
)
def charts_bundle(t):
    return stats.dashboard(t.logs, t.clients, WEEK, NOW, sections=stats.CHART_SECTIONS).select("section", "key", "count")


@query(
    "f18_overview_bundle", "logs",
    f"""SELECT 'total' AS section, 'all' AS key, count(*) AS count FROM logs WHERE {SINCE_WEEK}
    UNION ALL SELECT 'allowed', 'all', count(*) FROM logs WHERE {SINCE_WEEK} AND log_type = 'firewall' AND rule_action = 'allow'
    UNION ALL SELECT 'blocked', 'all', count(*) FROM logs WHERE {SINCE_WEEK} AND rule_action = 'block'
    UNION ALL SELECT 'threats', 'all', count(*) FROM logs WHERE {SINCE_WEEK} AND threat_score > 50
    UNION ALL SELECT 'by_type', log_type, count(*) FROM logs WHERE {SINCE_WEEK} GROUP BY 2
    UNION ALL SELECT 'by_direction', direction, count(*) FROM logs WHERE {SINCE_WEEK} AND direction IS NOT NULL GROUP BY 2""",
)
def overview_bundle(t):
    bundle = stats.dashboard(t.logs, t.clients, WEEK, NOW, sections=stats.OVERVIEW_SECTIONS)
    return bundle.where(F.col("rank") == 0).select("section", "key", "count")
