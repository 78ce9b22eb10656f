"""Queries of the sources (A1, A5-A8, C1): payloads and lines that Spark writes from the
tables, read back by the loaders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.contract.common import NOW, OWN, OWN_SQL
from netlens.contract.registry import query
from netlens.operators.filters import TimeWindow
from netlens.sources import inventory, services, syslog


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share; only a local session may do without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="netlens-")
    return f"{shared.rstrip('/')}/netlens-sources/{uuid.uuid4().hex}"


PAGE = 1000


def payload(items: DataFrame, key: str, schema: str) -> DataFrame:
    """``items`` as a controller delivers them: documents with a list of up to ``PAGE``
    entries each, one file per document, read by the loader."""
    path = scratch(items.sparkSession)
    entry = F.struct(*[c for c in items.columns if c != key])
    pages = items.groupBy(F.floor(F.col(key) / PAGE).alias("page")).agg(F.collect_list(entry).alias("data"))
    pages.select("data").write.option("maxRecordsPerFile", 1).json(path)
    return inventory.read_payload(items.sparkSession, path, schema)


@query(
    "a1_read_syslog", "logs",
    "SELECT substr(raw_log, 1, 6) AS day, count(*) AS n, CAST(sum(length(raw_log)) AS BIGINT) AS chars FROM logs"
    " WHERE raw_log IS NOT NULL AND trim(raw_log) <> '' GROUP BY 1",
)
def read_syslog(t):
    path = scratch(t.spark)
    # Padded lines and empty ones between them.
    t.lines.select(F.concat(F.lit("\t "), "raw_log", F.lit(" \r\n  ")).alias("value")).write.text(path)
    lines = syslog.read_syslog(t.spark, path)
    return lines.groupBy(F.substring("raw_log", 1, 6).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw_log")).alias("chars"))


_MAC = "'aa:bb:' || CAST({0} AS STRING)"
_SQL_MAC = _MAC.replace("STRING", "VARCHAR")


@query("a5_load_clients", "", f"""
SELECT {_SQL_MAC.format('c_custkey')} AS mac, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE 'net' END AS network,
 CASE WHEN c_custkey % 3 = 0 THEN '10.1.0.' ELSE '10.0.0.' END || CAST(c_custkey % 200 AS VARCHAR) AS ip,
 c_name AS device_name, c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AS is_fixed_ip
FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 3 = 0
UNION ALL SELECT {_SQL_MAC.format('c_custkey')}, 'old', '10.1.0.' || CAST(c_custkey % 200 AS VARCHAR), c_name, false
FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 3 <> 0
""")
def load_clients(t):
    """Active clients (some without an address of their own) and all historic ones."""
    rows, key = t.base("customer"), "c_custkey"
    mac = F.upper(F.expr(_MAC.format(key)))
    seen = F.lit(1_700_000_000).cast("bigint").alias("last_seen")
    address = F.concat(F.lit("10.0.0."), (F.col(key) % 200).cast("string"))
    active = rows.where("c_custkey % 3 <> 0").select(
        key, F.when(F.col(key) % 7 == 0, "").otherwise(mac).alias("mac"), F.when(F.col(key) % 5 > 0, address).otherwise("").alias("ip"),
        address.alias("last_ip"), F.col("c_name").alias("name"), F.lit("net").alias("network"),
        F.when(F.col(key) % 2 == 0, True).alias("use_fixedip"), seen,
    )
    historic = rows.select(
        key, mac.alias("mac"), F.concat(F.lit("10.1.0."), (F.col(key) % 200).cast("string")).alias("last_ip"), F.col("c_name").alias("name"),
        F.lit("old").alias("last_connection_network_name"), seen,
    )
    clients = inventory.load_clients(payload(active, key, inventory.ACTIVE_SCHEMA), payload(historic, key, inventory.HISTORIC_SCHEMA))
    return clients.select("mac", "network", "ip", "device_name", "is_fixed_ip")


@query("a6_load_devices", "", f"""
SELECT {_SQL_MAC.format('s_suppkey')} AS mac, s_name AS device_name, 'M' || CAST(s_nationkey AS VARCHAR) AS model,
 CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey AS BIGINT) END AS uptime
FROM supplier WHERE s_suppkey % 9 <> 0
""")
def load_devices(t):
    rows, key = t.base("supplier"), "s_suppkey"
    mac = F.upper(F.expr(_MAC.format(key)))
    items = rows.select(
        key, F.when(F.col(key) % 9 != 0, mac).alias("mac"), F.col("s_name").alias("name"),
        F.concat(F.lit("M"), F.col("s_nationkey").cast("string")).alias("model"), F.when(F.col(key) % 4 != 0, F.col(key).cast("bigint")).alias("uptime"),
    )
    return inventory.load_devices(payload(items, key, inventory.DEVICE_SCHEMA)).select("mac", "device_name", "model", "uptime")


_LISTED = "'45.' || CAST({0} % 5 AS {1}) || '.' || CAST({0} % 90 AS {1}) || '.' || CAST({0} % 250 AS {1})"


@query("a7_load_blacklist", "", f"""
SELECT ip, max(score) AS threat_score FROM (
 SELECT {_LISTED.format('c_custkey', 'VARCHAR')} AS ip, CASE WHEN c_custkey % 6 = 0 THEN 100 ELSE CAST(c_custkey % 97 AS INT) END AS score
 FROM customer WHERE c_custkey % 11 <> 0) x
WHERE ip NOT IN {OWN_SQL} GROUP BY ip
""")
def load_blacklist(t):
    """Feed entries, some without a score or an address, some addresses twice or the site's own."""
    key = "c_custkey"
    ip = F.expr(_LISTED.format(key, "STRING"))
    items = t.base("customer").select(
        key, F.when(F.col(key) % 11 == 0, "").otherwise(ip).alias("ipAddress"), F.when(F.col(key) % 6 != 0, (F.col(key) % 97).cast("int")).alias("abuseConfidenceScore")
    )
    return inventory.load_blacklist(payload(items, key, inventory.FEED_SCHEMA), OWN).select("ip", "threat_score")


@query("a8_service_dim", "", """
WITH rows AS (
 SELECT p_partkey AS pos, p_partkey * 7 % 5000 AS port, CASE WHEN p_partkey % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS name,
  CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 10 = 3 THEN p_brand ELSE p_name END AS long, p_partkey % 13 = 0 AS rfc
 FROM part WHERE p_partkey % 17 <> 0),
ranked AS (
 SELECT *, row_number() OVER (PARTITION BY port, protocol ORDER BY rfc DESC, CASE WHEN rfc THEN -pos ELSE pos END) AS rn
 FROM rows WHERE name <> '' OR long <> '')
SELECT port, protocol, CASE WHEN name <> '' THEN name ELSE long END AS service_name,
 CASE WHEN long <> '' AND name <> '' AND long <> name THEN long END AS description FROM ranked WHERE rn = 1
""")
def service_dim(t):
    """Registry entries: port ranges, unknown transports, entries without name or text."""
    key = F.col("p_partkey")
    port = (key * 7 % 5000).cast("string")
    registry = t.base("part").select(
        key.alias("pos"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(" "), "p_brand")).alias("Service Name"),
        F.when(key % 4 == 0, F.concat(port, F.lit("-9999"))).otherwise(port).alias("Port Number"),
        F.when(key % 17 == 0, "quic").when(key % 2 == 0, "TCP").otherwise("udp").alias("Transport Protocol"),
        F.when(key % 10 == 0, None).when(key % 10 == 3, F.col("p_brand")).otherwise(F.col("p_name")).alias("Description"),
        F.when(key % 13 == 0, "[rfc793]").otherwise("").alias("Reference"),
    )
    return services.service_dim(registry).withColumn("port", F.col("port").cast("bigint"))


_CASES = {
    "unknown preset": (TimeWindow("9y"), "timestamp >= TIMESTAMP '2024-01-30 00:00:00'"),
    "start replaces preset": (TimeWindow("7d", "2024-01-05T00:00:00Z"), "timestamp >= TIMESTAMP '2024-01-05 00:00:00'"),
    "bad start": (TimeWindow("7d", "yesterday", "2024-01-27T12:00:00Z"), "timestamp BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-27 12:00:00'"),
    "bad end": (TimeWindow(None, "2024-01-05T02:00:00+02:00", "soon"), "timestamp >= TIMESTAMP '2024-01-05 00:00:00'"),
}


@query("c1_time_parameters", "logs", " UNION ALL ".join(
    f"SELECT '{name}' AS parameters, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM logs WHERE {where}" for name, (_, where) in _CASES.items()
))
def time_parameters(t):
    """One scan: a row counts for each window it lies in."""
    cases = [F.when(window.condition(NOW), F.lit(name)) for name, (window, _) in _CASES.items()]
    hits = t.logs.select("id", F.explode(F.array(*cases)).alias("parameters")).where("parameters IS NOT NULL")
    return hits.groupBy("parameters").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))
