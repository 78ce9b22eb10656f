"""Device-name dimensions and the joins that use them.

Each dimension is first reduced to one row per join key, so a join never
multiplies log rows, and carries no broadcast hint: adaptive execution
broadcasts it when its measured size allows and splits hot keys when not.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions.ip import ip_text
from netlens.functions.scalars import ts_lit
from netlens.operators.topk import latest_per_key
from netlens.plans.staging import spread_null

CLIENT_NAME = ("device_name", "hostname", "oui")
DEVICE_NAME = ("device_name", "model")


def _name(columns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.col(c) for c in columns])


def latest_client(clients: DataFrame, since: str | datetime | None = None) -> DataFrame:
    """Most recently seen client per address; ``since`` ignores clients last seen
    more than a day before it."""
    clients = clients.where(F.col("ip").isNotNull())
    if since is not None:
        clients = clients.where(F.col("last_seen") >= ts_lit(since) - F.expr("INTERVAL 1 DAY"))
    return latest_per_key(clients, ["ip"], "last_seen", "mac")


def latest_device(devices: DataFrame) -> DataFrame:
    return latest_per_key(devices.where(F.col("ip").isNotNull()), ["ip"], "updated_at", "mac")


def client_names(clients: DataFrame, since: str | datetime | None = None) -> DataFrame:
    return latest_client(clients, since).select("ip", _name(CLIENT_NAME).alias("client_name"))


def device_names(devices: DataFrame) -> DataFrame:
    return latest_device(devices).select("ip", _name(DEVICE_NAME).alias("infra_name"))


def join_latest_client(
    df: DataFrame, clients: DataFrame, ip_col: str, out: str, since: str | datetime | None = None
) -> DataFrame:
    dim = client_names(clients, since).select(F.col("ip").alias("_ip"), F.col("client_name").alias(out))
    return df.join(dim, F.col(ip_col) == F.col("_ip"), "left").drop("_ip")


def join_latest_device(df: DataFrame, devices: DataFrame, ip_col: str, out: str) -> DataFrame:
    dim = device_names(devices).select(F.col("ip").alias("_ip"), F.col("infra_name").alias(out))
    return df.join(dim, F.col(ip_col) == F.col("_ip"), "left").drop("_ip")


def join_names_by_ip(
    df: DataFrame, clients: DataFrame, devices: DataFrame, ip_col: str, out: str, existing: str | None = None
) -> DataFrame:
    """Name of an address: stored, else latest client's, else latest device's."""
    named = join_latest_client(df, clients, ip_col, "_client")
    named = join_latest_device(named, devices, ip_col, "_device")
    known = [F.col(existing)] if existing else []
    return named.withColumn(out, F.coalesce(*known, F.col("_client"), F.col("_device"))).drop("_client", "_device")


def join_name_by_mac(
    df: DataFrame, clients: DataFrame, devices: DataFrame, out: str = "src_device_name", existing: str | None = None
) -> DataFrame:
    """Name of the row's ``mac_address`` in both inventories (``mac`` is their key)."""
    c = clients.select(F.col("mac").alias("_cmac"), _name(CLIENT_NAME).alias("_client"))
    d = devices.select(F.col("mac").alias("_dmac"), _name(DEVICE_NAME).alias("_device"))
    known = [F.col(existing)] if existing else []
    return (
        df.join(c, F.col("mac_address") == F.col("_cmac"), "left")
        .join(d, F.col("mac_address") == F.col("_dmac"), "left")
        .withColumn(out, F.coalesce(*known, F.col("_client"), F.col("_device")))
        .drop("_cmac", "_dmac", "_client", "_device")
    )


def names_for_ips(ips: DataFrame, clients: DataFrame, devices: DataFrame, ip_col: str = "ip") -> DataFrame:
    return join_names_by_ip(ips.select(ip_col).distinct(), clients, devices, ip_col, "device_name")


def name_maps(clients: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ip -> name, mac -> name). The last write wins: clients by ``last_seen``,
    then devices by ``updated_at`` on top of them."""
    entries = (
        clients.select("mac", "ip", _name(CLIENT_NAME).alias("name"), F.lit(0).alias("source"), F.col("last_seen").alias("seen"))
        .unionByName(
            devices.select("mac", "ip", _name(DEVICE_NAME).alias("name"), F.lit(1).alias("source"), F.col("updated_at").alias("seen"))
        )
        .where(F.col("name").isNotNull())
    )

    def last(key: str) -> DataFrame:
        order = F.struct("source", "seen", "mac")
        return entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("name", order).alias("name"))

    return last("ip"), last("mac")


def resolve_names(
    logs: DataFrame, ip_map: DataFrame, mac_map: DataFrame, src_private: Column, dst_private: Column
) -> DataFrame:
    """Device names of the private sides: source by MAC then address, target by
    address; a name found replaces the stored one."""
    by = F.xxhash64(*[F.col(c) for c in ("raw_log", "src_ip", "dst_ip") if c in logs.columns])
    by_mac = mac_map.select(F.lower("mac").alias("_mac"), F.col("name").alias("_mac_name"))
    by_src = ip_map.select(F.col("ip").alias("_sip"), F.col("name").alias("_src_name"))
    by_dst = ip_map.select(F.col("ip").alias("_dip"), F.col("name").alias("_dst_name"))
    return (
        logs.withColumn("_sp", src_private & F.col("src_ip").isNotNull())
        .withColumn("_dp", dst_private & F.col("dst_ip").isNotNull())
        # Most rows have no MAC: they must not meet in one task.
        .join(by_mac, spread_null(F.lower("mac_address"), by) == F.col("_mac"), "left")
        .join(by_src, spread_null(F.col("src_ip"), by) == F.col("_sip"), "left")
        .join(by_dst, spread_null(F.col("dst_ip"), by) == F.col("_dip"), "left")
        .withColumn(
            "src_device_name",
            F.coalesce(F.when(F.col("_sp"), F.coalesce("_mac_name", "_src_name")), F.col("src_device_name")),
        )
        .withColumn(
            "dst_device_name", F.coalesce(F.when(F.col("_dp"), F.col("_dst_name")), F.col("dst_device_name"))
        )
        .drop("_sp", "_dp", "_mac", "_mac_name", "_sip", "_src_name", "_dip", "_dst_name")
    )


def merge_clients(active: DataFrame, historic: DataFrame) -> DataFrame:
    """One row per MAC; an active row replaces the historic one as a whole."""
    rows = active.withColumn("_active", F.lit(1)).unionByName(historic.withColumn("_active", F.lit(0)))
    return latest_per_key(rows, ["mac"], "_active").drop("_active")


def join_service(df: DataFrame, services: DataFrame, port: str = "dst_port", protocol: str = "protocol") -> DataFrame:
    """Registered service of (port, protocol); adds ``iana_service`` and
    ``service_description``. Of several entries of a key the least name counts, so a log
    row stays one. One row per key bounds the table by 65 536 ports x 4 transports, which
    makes the broadcast safe."""
    known = F.col("port").between(0, 65_535) & F.col("protocol").isin("tcp", "udp", "sctp", "dccp")
    dim = services.where(known).groupBy(F.col("port").alias("_port"), F.col("protocol").alias("_proto")).agg(
        F.min(F.struct("service_name", "description")).alias("_s")
    ).select("_port", "_proto", F.col("_s.service_name").alias("iana_service"), F.col("_s.description").alias("service_description"))
    on = (F.col(port) == F.col("_port")) & (F.coalesce(F.lower(protocol), F.lit("tcp")) == F.col("_proto"))
    return df.join(F.broadcast(dim), on, "left").drop("_port", "_proto")


def normalised_dim(df: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Dimension keyed by canonical address text; rows with a bad address go."""
    return df.withColumn(ip_col, ip_text(ip_col)).where(F.col(ip_col).isNotNull())


def rank_within(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key (cut inside each task before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
