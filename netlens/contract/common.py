"""Shared parameters and SQL fragments of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.config import NetConfig
from netlens.fixtures import NOW
from netlens.operators.filters import LogFilter, TimeWindow

WEEK = TimeWindow("7d")
MONTH = TimeWindow("30d")
ALL = LogFilter(time=MONTH)
FIREWALL = LogFilter(time=MONTH, log_type="firewall")
SINCE_WEEK = "timestamp >= TIMESTAMP '2024-01-24 00:00:00'"
SINCE_MONTH = "timestamp >= TIMESTAMP '2024-01-01 00:00:00'"
OWN = ("0.0.0.0", "45.1.0.2", "45.2.0.103", "45.3.1.11")
OWN_SQL = "('0.0.0.0', '45.1.0.2', '45.2.0.103', '45.3.1.11')"

CFG = NetConfig(
    wan_interfaces=("ppp0",),
    wan_ips=("45.1.0.2", "45.2.0.103", "45.3.1.11"),
    gateway_vlans={"192.168.10.2": 10, "192.168.99.2": 99, "192.168.20.7": None},
    wan_ip_names={"45.1.0.2": "WAN uplink", "45.2.0.103": "WAN backup"},
    vpn_networks={"wgsrv1": ("192.168.99.0/28", "WGD SRV"), "tun7": ("192.168.99.0/24", "OVPN TUN")},
    interface_labels={"ppp0": "Internet", "br10": "Home", "wgsrv1": "Road warriors"},
)

# Public in the wide sense, on the IPv4 addresses of the fixtures.
PUBLIC = (
    "({0} IS NOT NULL AND NOT ({0} LIKE '10.%' OR {0} LIKE '192.168.%'"
    " OR regexp_matches({0}, '^172[.](1[6-9]|2[0-9]|3[01])[.]')))"
)
NUMBER = (
    "(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536"
    " + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))"
)
LATEST_CLIENT = (
    "SELECT * FROM (SELECT *, coalesce(device_name, hostname, oui) AS name, row_number() OVER"
    " (PARTITION BY ip ORDER BY last_seen DESC NULLS LAST, mac DESC) AS rn FROM clients {where}) q WHERE rn = 1"
)
LATEST_DEVICE = (
    "SELECT * FROM (SELECT *, coalesce(device_name, model) AS name, row_number() OVER"
    " (PARTITION BY ip ORDER BY updated_at DESC NULLS LAST, mac DESC) AS rn FROM devices) q WHERE rn = 1"
)
LC = LATEST_CLIENT.format(where="")
LC_WEEK = LATEST_CLIENT.format(where="WHERE last_seen >= TIMESTAMP '2024-01-23 00:00:00'")
DIGEST_SQL = (
    "SELECT log_type, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum, min(id) AS id_min, max(id) AS id_max FROM logs"
)


def public(column: str) -> str:
    return PUBLIC.format(column)


def number(column: str) -> str:
    return NUMBER.format(column)


def digest(logs: DataFrame) -> DataFrame:
    """Which rows were selected, in a few figures per type."""
    return logs.groupBy("log_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"), F.min("id").alias("id_min"), F.max("id").alias("id_max")
    )


def stamp(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def joined(column: str) -> Column:
    """Array as comma-separated text."""
    return F.array_join(column, ",")


