"""Filter queries (section 2.C of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.contract.common import (
    ALL,
    CFG,
    DIGEST_SQL,
    MONTH,
    NOW,
    OWN,
    OWN_SQL,
    SINCE_MONTH,
    digest,
    number,
    public,
)
from netlens.contract.registry import query
from netlens.functions.ip import is_global_ip, is_public_ip_sql, is_remote, is_reserved_ip, is_wan_candidate_ip, not_own
from netlens.operators.filters import LogFilter, TimeWindow, client_search, exact, threat_filter


def _log_filter(name: str, sql: str, time: TimeWindow = MONTH, since: str = SINCE_MONTH, **parameters) -> None:
    flt = LogFilter(time=time, **parameters)
    where = f"{since} AND {sql}" if sql else since
    query(name, "logs", f"{DIGEST_SQL} WHERE {where} GROUP BY log_type")(lambda t: digest(flt.apply(t.logs, NOW)))


VPN = "wgsrv wgclt wgsts tlprt vti tunovpnc tun vtun l2tp".split()
VPN_SQL = "(" + " OR ".join(f"interface_in LIKE '{p}%' OR interface_out LIKE '{p}%'" for p in VPN) + ")"
# NULLs stay on a negated condition: (NOT test OR column IS NULL).
_log_filter("c2_window_preset", "", TimeWindow("7d"), "timestamp >= TIMESTAMP '2024-01-24 00:00:00'")
_log_filter("c2_window_bad_preset", "", TimeWindow("13d"), "timestamp >= TIMESTAMP '2024-01-30 00:00:00'")
_log_filter(
    "c2_window_bounds", "", TimeWindow("7d", "2024-01-10T06:00:00Z", "2024-01-20 18:00:00+02:00"),
    "timestamp >= TIMESTAMP '2024-01-10 06:00:00' AND timestamp <= TIMESTAMP '2024-01-20 16:00:00'",
)
_log_filter("c3_log_type", "log_type IN ('dns', 'wifi')", log_type="dns, wifi")
_log_filter("c4_src_substring", "contains(src_ip, '168.10')", src_ip="168.10")
_log_filter("c4_src_negated", "(NOT contains(src_ip, '168.10') OR src_ip IS NULL)", src_ip="!168.10")
_log_filter("c4_dst_substring", "contains(dst_ip, '45.1')", dst_ip="45.1")
_log_filter("c4_dst_negated", "(NOT contains(dst_ip, '45.1') OR dst_ip IS NULL)", dst_ip="!45.1")
_log_filter("c5_either_ip", "(contains(src_ip, '45.3.') OR contains(dst_ip, '45.3.'))", ip="45.3.")
_log_filter(
    "c5_neither_ip",
    "(NOT contains(src_ip, '45.3.') OR src_ip IS NULL) AND (NOT contains(dst_ip, '45.3.') OR dst_ip IS NULL)",
    ip="!45.3.",
)
_log_filter("c6_direction", "direction IN ('inbound', 'nat')", direction="inbound,nat")
_log_filter("c6_direction_with_vpn", f"direction IN ('inbound', 'vpn') AND {VPN_SQL}", direction="inbound", vpn_only=True)
_log_filter("c7_action", "rule_action IN ('allow', 'redirect')", rule_action="allow,redirect")
_log_filter("c7_action_or_unknown", "(rule_action IN ('block') OR rule_action IS NULL)", rule_action="block,unknown")
_log_filter("c7_action_unknown", "rule_action IS NULL", rule_action="unknown")
_log_filter("c7_action_negated", "(rule_action NOT IN ('block') OR rule_action IS NULL)", rule_action="!block")
_log_filter("c7_action_negated_unknown", "rule_action IS NOT NULL", rule_action="!unknown")
_log_filter(
    "c7_action_negated_both", "rule_action NOT IN ('block') AND rule_action IS NOT NULL", rule_action="!block,unknown"
)
_log_filter("c8_rule", "(rule_name ILIKE '%wan_lan%' ESCAPE '$' OR rule_desc ILIKE '%wan_lan%' ESCAPE '$')".replace("_", "$_").replace("rule$_", "rule_"), rule_name="wan_lan")
_log_filter(
    "c8_rule_display_form", "(contains(lower(rule_name), '[lan_wan] allow') OR contains(lower(rule_desc), '[lan_wan]allow'))",
    rule_name="[LAN_WAN] Allow",
)
_log_filter(
    "c8_rule_negated",
    "(NOT contains(lower(rule_name), 'block') OR rule_name IS NULL)"
    " AND (NOT contains(lower(rule_desc), 'block') OR rule_desc IS NULL)",
    rule_name="!Block",
)
_log_filter("c9_country", "geo_country IN ('DE', 'FR')", country="de, fr")
_log_filter("c9_country_negated", "(geo_country NOT IN ('US') OR geo_country IS NULL)", country="!us")
_log_filter("c10_min_score", "threat_score >= 40", threat_min=40)
_log_filter("c11_asn", "contains(lower(asn_name), 'asn-3')", asn="aSn-3")
_log_filter("c11_asn_negated", "(NOT contains(lower(asn_name), 'asn-3') OR asn_name IS NULL)", asn="!asn-3")
_log_filter("c12_service", "service_name IN ('ssh', 'DNS')", service="ssh,DNS")
_log_filter("c12_service_negated", "(service_name NOT IN ('ssh') OR service_name IS NULL)", service="!ssh")
_log_filter("c13_text", "contains(lower(raw_log), 'proto=udp')", search="proto=udp")
_log_filter("c13_text_negated", "NOT contains(lower(raw_log), 'kernel')", search="!KERNEL")
_log_filter("c14_interface", "(interface_in IN ('br10', 'ppp0') OR interface_out IN ('br10', 'ppp0'))", interface="br10, ppp0")
_log_filter("c15_dst_port", "dst_port = 443", dst_port="443")
_log_filter("c15_dst_port_negated", "(dst_port <> 443 OR dst_port IS NULL)", dst_port="!443")
_log_filter("c15_src_port", "src_port = 20017", src_port="20017")
_log_filter("c15_port_ignored", "", dst_port="70000", src_port="http")
_log_filter("c16_protocol", "lower(protocol) IN ('udp', 'icmp')", protocol="UDP, icmp")
_log_filter("c16_protocol_negated", "(lower(protocol) NOT IN ('tcp') OR protocol IS NULL)", protocol="!TCP")
_log_filter("c17_vpn_only", VPN_SQL, vpn_only=True)
_log_filter("c18_literal_wildcards", "contains(lower(raw_log), 'n_w')", search="N_W")


@query(
    "c19_exact", "logs",
    f"{DIGEST_SQL} WHERE {SINCE_MONTH} AND dst_ip = '192.168.99.11' AND interface_in = 'br20' GROUP BY log_type",
)
def _c19(t):
    return digest(ALL.apply(t.logs, NOW).where(exact(dst="192.168.99.11", interface_in="br20")))


@query("c20_public_ip", "logs", f"{DIGEST_SQL} WHERE {public('src_ip')} OR {public('dst_ip')} GROUP BY log_type")
def _c20(t):
    return digest(t.logs.where(is_public_ip_sql("src_ip") | is_public_ip_sql("dst_ip")))


@query("c20_not_public_keeps_null", "logs", f"{DIGEST_SQL} WHERE NOT {public('src_ip')} GROUP BY log_type")
def _c20n(t):
    return digest(t.logs.where(~is_public_ip_sql("src_ip")))


RESERVED = (
    "({n} < 16777216 OR {n} BETWEEN 167772160 AND 184549375 OR {n} BETWEEN 2130706432 AND 2147483647"
    " OR {n} BETWEEN 2851995648 AND 2852061183 OR {n} BETWEEN 2886729728 AND 2887778303"
    " OR {n} BETWEEN 3221225472 AND 3221225727 OR {n} BETWEEN 3221225984 AND 3221226239"
    " OR {n} BETWEEN 3232235520 AND 3232301055 OR {n} BETWEEN 3323068416 AND 3323199487"
    " OR {n} BETWEEN 3325256704 AND 3325256959 OR {n} BETWEEN 3405803776 AND 3405804031 OR {n} >= 4026531840)"
)


def _reserved(column: str) -> str:
    return RESERVED.format(n=number(column))


@query(
    "c21_global_ip", "logs",
    f"SELECT dst_ip, count(*) AS n FROM logs WHERE dst_ip IS NOT NULL AND NOT {_reserved('dst_ip')} GROUP BY dst_ip",
)
def _c21(t):
    return t.logs.where(is_global_ip("dst_ip")).groupBy("dst_ip").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c22_wan_candidate", "logs",
    f"{DIGEST_SQL} WHERE {public('dst_ip')} AND dst_ip NOT LIKE '127.%' AND dst_ip <> '255.255.255.255' GROUP BY log_type",
)
def _c22(t):
    return digest(t.logs.where(is_wan_candidate_ip("dst_ip")))


@query(
    "c23_remote_party", "logs",
    f"{DIGEST_SQL} WHERE src_ip IS NOT NULL AND NOT {_reserved('src_ip')}"
    " AND src_ip NOT IN ('45.1.0.2', '45.2.0.103', '45.3.1.11') GROUP BY log_type",
)
def _c23(t):
    return digest(t.logs.where(is_remote("src_ip", CFG.own_ips)))


@query("c24_not_own", "logs", f"{DIGEST_SQL} WHERE src_ip NOT IN {OWN_SQL} GROUP BY log_type")
def _c24(t):
    return digest(t.logs.where(not_own("src_ip", OWN)))


@query(
    "c25_reserved_answer", "dns_answers",
    f"SELECT {_reserved('answer')} AS reserved, count(*) AS n FROM dns_answers GROUP BY 1",
)
def _c25(t):
    return t.dns_answers.groupBy(is_reserved_ip("answer").alias("reserved")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "c26_threat_filter", "threats",
    "SELECT ip, threat_score FROM threats WHERE threat_score >= 20 AND threat_score <= 80"
    " AND looked_up_at >= TIMESTAMP '2024-01-10 00:00:00'",
)
def _c26(t):
    return t.threats.where(threat_filter(20, 80, since="2024-01-10")).select("ip", "threat_score")


@query(
    "c27_client_search", "clients",
    "SELECT mac FROM clients WHERE device_name ILIKE '%r#0000000_2%' OR hostname ILIKE '%r#0000000_2%'"
    " OR ip LIKE '%r#0000000_2%' OR mac ILIKE '%r#0000000_2%'",
)
def _c27(t):
    return t.clients.where(client_search("R#0000000_2")).select("mac")
