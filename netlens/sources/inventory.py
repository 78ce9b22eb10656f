"""Client, device and reputation-feed sources (controller and feed payloads)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions.ip import ip_text
from netlens.operators.dims import merge_clients
from netlens.operators.filters import without_ips

ACTIVE_SCHEMA = (
    "data array<struct<mac:string,ip:string,last_ip:string,name:string,hostname:string,oui:string,network:string,"
    "essid:string,vlan:int,use_fixedip:boolean,is_wired:boolean,last_seen:bigint>>"
)
HISTORIC_SCHEMA = (
    "data array<struct<mac:string,last_ip:string,name:string,hostname:string,oui:string,"
    "last_connection_network_name:string,use_fixedip:boolean,is_wired:boolean,last_seen:bigint>>"
)
DEVICE_SCHEMA = (
    "data array<struct<mac:string,ip:string,name:string,model:string,shortname:string,type:string,"
    "version:string,serial:string,state:int,uptime:bigint>>"
)
FEED_SCHEMA = "data array<struct<ipAddress:string,abuseConfidenceScore:int>>"


def read_payload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _items(payload: DataFrame) -> DataFrame:
    return payload.select(F.explode("data").alias("i")).select("i.*")


def _mac() -> Column:
    return F.lower(F.coalesce("mac", F.lit("")))


def _seen() -> Column:
    return F.timestamp_seconds("last_seen")


def _text(*names: str) -> Column:
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def active_clients(payload: DataFrame) -> DataFrame:
    rows = _items(payload).withColumn("mac", _mac()).where(F.col("mac") != "")
    return rows.select(
        "mac", _text("ip", "last_ip").alias("ip"), F.col("name").alias("device_name"), "hostname", "oui",
        "network", "essid", "vlan", F.coalesce("use_fixedip", F.lit(False)).alias("is_fixed_ip"), "is_wired",
        _seen().alias("last_seen"),
    )


def historic_clients(payload: DataFrame) -> DataFrame:
    rows = _items(payload).withColumn("mac", _mac()).where(F.col("mac") != "")
    return rows.select(
        "mac", F.col("last_ip").alias("ip"), F.col("name").alias("device_name"), "hostname", "oui",
        F.col("last_connection_network_name").alias("network"), F.lit(None).cast("string").alias("essid"),
        F.lit(None).cast("int").alias("vlan"), F.coalesce("use_fixedip", F.lit(False)).alias("is_fixed_ip"),
        "is_wired", _seen().alias("last_seen"),
    )


def load_clients(active: DataFrame, historic: DataFrame) -> DataFrame:
    """All known clients; what is active now describes itself."""
    return merge_clients(active_clients(active), historic_clients(historic))


def load_devices(payload: DataFrame) -> DataFrame:
    rows = _items(payload).withColumn("mac", _mac()).where(F.col("mac") != "")
    return rows.select(
        "mac", "ip", F.col("name").alias("device_name"), "model", "shortname", F.col("type").alias("device_type"),
        F.col("version").alias("firmware"), "serial", "state", "uptime",
    )


def load_blacklist(payload: DataFrame, exclude_ips: Iterable[str]) -> DataFrame:
    """Feed entries as reputation rows, without the site's own addresses."""
    rows = _items(payload).where(F.coalesce("ipAddress", F.lit("")) != "")
    entries = rows.select(
        F.coalesce(ip_text("ipAddress"), F.col("ipAddress")).alias("ip"),
        F.coalesce("abuseConfidenceScore", F.lit(100)).alias("threat_score"),
    )
    # An address may be listed twice, or in two spellings: the higher score counts.
    once = entries.groupBy("ip").agg(F.max("threat_score").alias("threat_score"))
    return without_ips(once.withColumn("threat_categories", F.array(F.lit("blacklist"))), "ip", exclude_ips)
