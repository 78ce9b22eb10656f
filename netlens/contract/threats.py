"""Threat map, reputation lists and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.contract.common import MONTH, NOW, SINCE_MONTH, joined, stamp, stamp_sql
from netlens.contract.registry import query
from netlens.functions.scalars import threat_band
from netlens.operators import threats as th
from netlens.operators.filters import LogFilter
from netlens.operators.topk import latest_per_key

KEYS = "geo_lat, geo_lon, geo_country, geo_city"
MODES = {"threats": "threat_score > 70", "blocked_outbound": "direction = 'outbound' AND rule_action = 'block'"}


def _geo(mode: str) -> str:
    where = f"{SINCE_MONTH} AND {MODES[mode]} AND geo_lat IS NOT NULL AND geo_lon IS NOT NULL"
    return f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY timestamp DESC, id DESC) AS rn FROM logs WHERE {where}),
    geo AS (SELECT {KEYS}, count(*) AS count, max(threat_score) AS max_score, CAST(round(avg(threat_score)) AS INT) AS avg_score,
     count(DISTINCT coalesce(src_ip, dst_ip)) AS unique_ips,
     string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 50) AS log_ids
     FROM e GROUP BY ALL ORDER BY count DESC, {KEYS} LIMIT 500)""".replace("GROUP BY ALL", f"GROUP BY {KEYS}")


for _mode in MODES:

    @query(
        f"f26_threat_geo_{_mode}", "logs",
        f"""{_geo(_mode)} SELECT CAST(geo_lat AS DOUBLE) AS lat, CAST(geo_lon AS DOUBLE) AS lon, geo_country AS country,
        geo_city AS city, count, max_score, avg_score, unique_ips, log_ids FROM geo""",
    )
    def geo(t, mode=_mode):
        return th.threat_geo(t.logs, MONTH, NOW, mode).select(
            F.col("geo_lat").cast("double").alias("lat"), F.col("geo_lon").cast("double").alias("lon"),
            F.col("geo_country").alias("country"), F.col("geo_city").alias("city"), "count", "max_score",
            "avg_score", "unique_ips", joined(F.col("log_ids").cast("array<string>")).alias("log_ids"),
        )


@query(
    "a13_geojson", "logs",
    f"""{_geo('threats')} SELECT 'Feature' AS type, 'Point' AS shape, CAST(geo_lon AS DOUBLE) AS x, CAST(geo_lat AS DOUBLE) AS y,
    geo_country AS country, count, coalesce(max_score, 0) AS max_score, len(string_split(log_ids, ',')) AS ids FROM geo""",
)
def geojson(t):
    f = th.threat_geojson(th.threat_geo(t.logs, MONTH, NOW))
    return f.select(
        "feature.type", F.col("feature.geometry.type").alias("shape"), F.col("feature.geometry.coordinates")[0].alias("x"),
        F.col("feature.geometry.coordinates")[1].alias("y"), "feature.properties.country", "feature.properties.count",
        "feature.properties.max_score", F.size("feature.properties.log_ids").cast("bigint").alias("ids"),
    )


@query(
    "f41_geo_totals", "logs",
    f"{_geo('blocked_outbound')} SELECT count(*) AS total_points, CAST(coalesce(sum(count), 0) AS BIGINT) AS total_events FROM geo",
)
def totals(t):
    return th.geo_totals(th.threat_geo(t.logs, MONTH, NOW, "blocked_outbound"))


@query(
    "g3_newest_ids", "logs",
    """SELECT log_type, direction, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS ids FROM (SELECT *, row_number() OVER
    (PARTITION BY log_type, direction ORDER BY timestamp DESC, id DESC) AS rn FROM logs) q WHERE rn <= 20 GROUP BY 1, 2""",
)
def ids(t):
    from netlens.operators.topk import newest_ids

    out = newest_ids(t.logs, ["log_type", "direction"], 20)
    return out.select("log_type", "direction", joined(F.col("log_ids").cast("array<string>")).alias("ids"))


_SIDES = """sides AS (SELECT src_ip AS ip, rdns, asn_name, timestamp, id FROM logs WHERE src_ip IS NOT NULL
 UNION ALL SELECT dst_ip, rdns, asn_name, timestamp, id FROM logs WHERE dst_ip IS NOT NULL)"""
_LATEST = f"""{_SIDES}, ln AS (SELECT ip, rdns, asn_name FROM (SELECT *, row_number() OVER (PARTITION BY ip
 ORDER BY timestamp DESC, id DESC, rdns DESC NULLS LAST, asn_name DESC NULLS LAST) AS rn FROM sides
 WHERE timestamp >= TIMESTAMP '2023-11-02 00:00:00' AND (rdns IS NOT NULL OR asn_name IS NOT NULL)) q WHERE rn = 1)"""


@query("i1_both_sides", "logs", f"WITH {_SIDES} SELECT ip, count(*) AS n, count(rdns) AS named FROM sides GROUP BY ip")
def both_sides(t):
    return th.both_sides(t.logs).groupBy("ip").agg(F.count(F.lit(1)).alias("n"), F.count("rdns").alias("named"))


@query("g1_latest_names", "logs", f"WITH {_LATEST} SELECT * FROM ln")
def latest_names(t):
    return th.latest_names(t.logs, NOW)


@query(
    "g8_ip_profiles", "logs threats clients",
    f"""WITH {_LATEST}, asked AS (SELECT ip FROM threats UNION SELECT ip FROM clients)
    SELECT asked.ip, threat_score, threat_category_list AS categories, abuse_usage_type, abuse_total_reports, abuse_is_tor, rdns, asn_name
    FROM asked LEFT JOIN threats ON threats.ip = asked.ip LEFT JOIN ln ON ln.ip = asked.ip""",
)
def profiles(t):
    bad = t.tokens.select(F.col("id").alias("ip"))  # not addresses: dropped
    asked = t.threats.select("ip").unionByName(t.clients.select("ip")).unionByName(bad)
    out = th.ip_profiles(asked, t.threats, t.logs, NOW)
    return out.withColumn("categories", joined("threat_categories")).drop("threat_categories")


@query(
    "g6_seed_threats", "logs threats",
    f"""SELECT ip, threat_score, categories, {stamp_sql('timestamp')} AS looked_up_at FROM (SELECT src_ip AS ip, threat_score,
    threat_category_list AS categories, timestamp, row_number() OVER (PARTITION BY src_ip ORDER BY timestamp DESC, id DESC) AS rn
    FROM logs WHERE threat_score IS NOT NULL AND src_ip IS NOT NULL) q WHERE rn = 1 AND ip NOT IN (SELECT ip FROM threats)""",
)
def seed(t):
    out = th.seed_threats(t.logs, t.threats)
    return out.select("ip", "threat_score", joined("threat_categories").alias("categories"), stamp("looked_up_at").alias("looked_up_at"))


@query(
    "g7_latest_client_name", "clients",
    f"""SELECT ip, name, {stamp_sql('last_seen')} AS last_seen FROM (SELECT ip, coalesce(device_name, hostname, oui) AS name, last_seen,
    row_number() OVER (PARTITION BY ip ORDER BY last_seen DESC NULLS LAST, mac DESC) AS rn FROM clients
    WHERE coalesce(device_name, hostname, oui) IS NOT NULL) q WHERE rn = 1""",
)
def latest_client_name(t):
    from netlens.plans.maintenance import latest_name_per_ip

    return latest_name_per_ip(t.clients).withColumn("last_seen", stamp("last_seen"))


@query(
    "g1_latest_per_key", "logs",
    """SELECT dns_query, src_ip, id FROM (SELECT dns_query, src_ip, id, row_number() OVER (PARTITION BY dns_query
    ORDER BY timestamp DESC, id DESC) AS rn FROM logs WHERE dns_query IS NOT NULL) q WHERE rn = 1""",
)
def latest(t):
    rows = t.logs.where(F.col("dns_query").isNotNull()).select("dns_query", "src_ip", "id", "timestamp")
    return latest_per_key(rows, ["dns_query"], "timestamp", "id").drop("timestamp")


@query(
    "h4_list_threats", "threats",
    f"""SELECT ip, threat_score, abuse_total_reports, {stamp_sql('looked_up_at')} AS looked_up_at FROM threats
    WHERE threat_score >= 10 AND threat_score <= 90 ORDER BY abuse_total_reports DESC NULLS FIRST, ip LIMIT 200""",
)
def list_threats(t):
    out = th.list_threats(t.threats, 10, 90, sort="abuse_total_reports", k=200)
    return out.select("ip", "threat_score", "abuse_total_reports", stamp("looked_up_at").alias("looked_up_at"))


@query(
    "e21_fresh_threats", "threats",
    "SELECT ip, threat_score, coalesce(threat_category_list, '') AS categories FROM threats WHERE looked_up_at > TIMESTAMP '2024-01-27 00:00:00'",
)
def fresh_threats(t):
    return th.fresh_threats(t.threats, NOW).select("ip", "threat_score", joined("threat_categories").alias("categories"))


@query(
    "e22_fresh_rdns", "rdns_cache",
    """SELECT ip, status, CASE WHEN status = 'success' THEN hostname END AS rdns FROM rdns_cache
    WHERE epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(looked_up_at)
     < CASE status WHEN 'success' THEN 86400 WHEN 'failure' THEN 604800 ELSE 3600 END""",
)
def fresh_rdns(t):
    return th.fresh_rdns(t.rdns_cache, NOW)


@query(
    "e15_orphans", "logs threats",
    "SELECT DISTINCT remote_ip AS ip FROM logs WHERE remote_ip IS NOT NULL AND remote_ip NOT IN (SELECT ip FROM threats)",
)
def orphans(t):
    return th.orphans(t.logs.where(F.col("remote_ip").isNotNull()).select(F.col("remote_ip").alias("ip")), t.threats)


@query(
    "d14_threat_band", "logs",
    f"""SELECT CASE WHEN threat_score >= 75 THEN 'Critical' WHEN threat_score >= 50 THEN 'High' WHEN threat_score >= 25 THEN 'Medium'
    WHEN threat_score >= 1 THEN 'Low' WHEN threat_score IS NOT NULL THEN 'Clean' END AS band, count(*) AS n
    FROM logs WHERE {SINCE_MONTH} GROUP BY 1""",
)
def band(t):
    rows = LogFilter(time=MONTH).apply(t.logs, NOW)
    return rows.groupBy(threat_band("threat_score").alias("band")).agg(F.count(F.lit(1)).alias("n"))
