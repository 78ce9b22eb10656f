"""Scalar-function queries (section 2.D) that no other group covers."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.contract.common import NOW, stamp, stamp_sql
from netlens.contract.registry import query
from netlens.functions import scalars as sc
from netlens.functions.ip import ip_text


@query(
    "d1_ip_text", "logs",
    "SELECT src_ip, count(*) AS n FROM logs WHERE src_ip IS NOT NULL GROUP BY 1",
)
def host_text(t):
    rows = t.logs.select("src_ip").where(F.col("src_ip").isNotNull()).groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("src_ip", ip_text("src_ip"))


for _range, _unit in (("6h", "hour"), ("60d", "day"), ("90d", "week"), ("180d", "month")):

    @query(f"d6_time_bucket_{_unit}", "logs", f"SELECT id, {stamp_sql(f'''date_trunc('{_unit}', timestamp)''')} AS bucket FROM logs")
    def bucket(t, preset=_range):
        return t.logs.select("id", stamp(sc.time_bucket("timestamp", preset)).alias("bucket"))


# Text with every kind of first character, derived from the customers.
_CELLS = """SELECT c_custkey AS k, CASE c_custkey % 9 WHEN 0 THEN '=' || c_name WHEN 1 THEN '+1' WHEN 2 THEN '@' || c_name
 WHEN 3 THEN ';x' WHEN 4 THEN CAST(c_acctbal AS STRING) WHEN 5 THEN '-' || c_name WHEN 6 THEN '-.5' WHEN 7 THEN '-.' ELSE c_name END AS cell
 FROM {} """


@query(
    "d9_csv_safe", "",
    f"""SELECT k, CASE WHEN regexp_matches(cell, '^[=+@;]') OR (cell LIKE '-%' AND NOT regexp_matches(cell, '^-([0-9]|[.][0-9])'))
    THEN '''' || cell ELSE cell END AS cell FROM ({_CELLS.format('customer')}) q""",
)
def csv(t):
    cells = t.spark.sql(_CELLS.format("{customer}"), customer=t.base("customer"))
    return cells.select("k", sc.csv_safe("cell").alias("cell"))


@query(
    "d16_rule_description", "logs",
    "SELECT CASE WHEN rule_desc <> '' THEN regexp_replace(rule_desc, '\\]([^ ])', '] \\1', 'g') END AS shown, count(*) AS n FROM logs GROUP BY 1",
)
def description(t):
    return t.logs.groupBy(sc.rule_desc_norm("rule_desc").alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "d15_category_labels", "threats",
    """SELECT ip, CASE threat_category_list WHEN '18' THEN 'Brute-Force' WHEN '4,14' THEN 'DDoS Attack, Port Scan' END AS labels FROM threats""",
)
def categories(t):
    return t.threats.select("ip", sc.decode_categories("threat_categories").alias("labels"))


@query(
    "d17_asn_subline", "logs",
    """SELECT id, CASE WHEN direction = 'inbound' AND src_ip NOT LIKE '192.168.%' THEN asn_name END AS src_subline,
    CASE WHEN (direction <> 'inbound' OR direction IS NULL) AND dst_ip NOT LIKE '192.168.%' THEN asn_name END AS dst_subline FROM logs""",
)
def subline(t):
    return t.logs.select("id", sc.asn_subline("direction", "src_ip", "dst_ip", "asn_name", "abuse_hostnames").alias("s")).select("id", "s.*")


@query(
    "d20_audit_fields", "audit",
    """SELECT id, CASE WHEN detail <> 'not json' THEN 't' || CAST(id % 5 AS VARCHAR) END AS tool_name,
    CASE WHEN detail <> 'not json' THEN 'logs.read' END AS scope FROM audit""",
)
def audit(t):
    return t.audit.select("id", sc.audit_fields("detail").alias("f")).select("id", "f.tool_name", "f.scope")


@query(
    "d22_next_retry", "queue",
    f"""SELECT ip, {stamp_sql("TIMESTAMP '2024-01-31 00:00:00' + INTERVAL 1 SECOND * CAST(least(300 * pow(2, attempts), 86400) AS BIGINT)")} AS next_retry FROM queue""",
)
def retry(t):
    return t.queue.select("ip", stamp(sc.next_retry(sc.ts_lit(NOW), "attempts")).alias("next_retry"))


@query("d23_reinterpret_tz", "logs", f"SELECT id, {stamp_sql('timestamp - INTERVAL 1 HOUR')} AS at FROM logs")
def reinterpret(t):
    return t.logs.select("id", stamp(sc.reinterpret_tz("timestamp", "Europe/Berlin")).alias("at"))


@query("d24_lower_protocol", "dns_flat", "SELECT lower(type) AS p, count(*) AS n FROM dns_flat GROUP BY 1")
def protocol(t):
    return t.dns_flat.groupBy(sc.lower_protocol("type").alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "d12_vpn_badge", "logs",
    """SELECT interface_out AS iface, CASE WHEN interface_out LIKE 'wgsrv%' THEN 'WGD SRV' END AS badge,
    CASE WHEN interface_out LIKE 'wgsrv%' THEN 'WireGuard Server' END AS description, count(*) AS n FROM logs GROUP BY 1""",
)
def badge(t):
    rows = t.logs.groupBy(F.col("interface_out").alias("iface")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("badge", sc.vpn_badge("iface")).withColumn("description", sc.vpn_description("iface"))
