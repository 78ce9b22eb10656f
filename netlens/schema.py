"""Explicit schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_COLUMNS = {
    "id": "bigint", "timestamp": "timestamp", "log_type": "string", "direction": "string",
    "src_ip": "string", "src_port": "int", "dst_ip": "string", "dst_port": "int",
    "protocol": "string", "service_name": "string",
    "rule_name": "string", "rule_desc": "string", "rule_action": "string",
    "interface_in": "string", "interface_out": "string", "mac_address": "string", "hostname": "string",
    "dns_query": "string", "dns_type": "string", "dns_answer": "string",
    "dhcp_event": "string", "wifi_event": "string",
    "geo_country": "string", "geo_city": "string", "geo_lat": "decimal(9,6)", "geo_lon": "decimal(9,6)",
    "asn_number": "int", "asn_name": "string",
    "threat_score": "int", "threat_categories": "array<string>", "rdns": "string",
    "abuse_usage_type": "string", "abuse_hostnames": "string", "abuse_total_reports": "int",
    "abuse_last_reported": "timestamp", "abuse_is_whitelisted": "boolean", "abuse_is_tor": "boolean",
    "src_device_name": "string", "dst_device_name": "string", "remote_ip": "string", "raw_log": "string",
}

# Longest text each stored column takes; a longer one is a bad row.
MAX_LENGTHS = {
    "log_type": 20, "direction": 20, "protocol": 10, "rule_name": 100, "rule_desc": 255,
    "rule_action": 20, "interface_in": 20, "interface_out": 20, "hostname": 255,
    "dns_query": 255, "dns_type": 10, "dns_answer": 255, "dhcp_event": 20, "wifi_event": 50,
    "geo_country": 2, "geo_city": 100, "asn_name": 255, "rdns": 255,
}

THREAT_COLUMNS = {
    "ip": "string", "threat_score": "int", "threat_categories": "array<string>",
    "abuse_usage_type": "string", "abuse_hostnames": "string", "abuse_total_reports": "int",
    "abuse_last_reported": "timestamp", "abuse_is_whitelisted": "boolean", "abuse_is_tor": "boolean",
    "looked_up_at": "timestamp", "last_seen_at": "timestamp",
}

DNS_RECORD_SCHEMA = (
    "id bigint, time double, type string, domain string, status string,"
    " client struct<ip:string,name:string>, reply struct<type:string>"
)


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def conform(df: DataFrame, columns: dict[str, str] = LOG_COLUMNS) -> DataFrame:
    """Cast to the stored schema; columns the input lacks become NULL."""
    present = set(df.columns)
    return df.select(
        *[(F.col(c) if c in present else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
    )


def with_category_array(df: DataFrame) -> DataFrame:
    """``threat_categories`` as an array, from its comma-separated text."""
    text = F.col("threat_category_list")
    return df.withColumn(
        "threat_categories",
        F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ",")),
    ).drop("threat_category_list")
