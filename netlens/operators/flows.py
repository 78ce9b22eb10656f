"""Three-layer flow graph, interface matrix and host profile."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.config import NetConfig
from netlens.functions.scalars import flow_dim, heat_tier
from netlens.operators.dims import device_names, join_names_by_ip, latest_client, names_for_ips, rank_within
from netlens.operators.filters import LogFilter, checked_ip
from netlens.operators.identity import identity_of
from netlens.operators.topk import top_k, with_texts

Now = str | datetime
DEFAULT_DIMS = ("src_ip", "dst_port", "dst_ip")
MAX_LINKS = 400  # at most 200 nodes too, which N <= 50 can never exceed
MIN_TOP, MAX_TOP = 3, 50
ALWAYS_FITS = 13  # 2 (N + 1)^2 links at most: 392 for N = 13
OTHER = "Other"


def flow_groups(
    logs: DataFrame, flt: LogFilter, now: Now, dims: tuple[str, str, str] = DEFAULT_DIMS, ip: str | None = None
) -> DataFrame:
    """Rows per combination of three dimensions: a, b, c, value."""
    if len(dims) != 3 or len(set(dims)) != 3:
        raise ValueError("three different dimensions are needed")
    rows = flt.apply(logs, now).where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    if ip:
        host = checked_ip(ip)
        rows = rows.where((F.col("src_ip") == host) | (F.col("dst_ip") == host))
    a, b, c = (flow_dim(d) for d in dims)
    return rows.groupBy(a.alias("a"), b.alias("b"), c.alias("c")).agg(F.count(F.lit(1)).alias("value"))


def dimension_ranks(groups: DataFrame, n: int) -> DataFrame:
    """The n largest values of each of the three dimensions: dim, key, rank.

    One pass for all three. The ranking is per dimension over sums, and
    ``rank <= n`` is cut inside each task first, so no task sees all values.
    """
    per_value = (
        groups.select(
            "value",
            F.explode(
                F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("key")) for d in ("a", "b", "c")])
            ).alias("_d"),
        )
        .groupBy(F.col("_d.dim").alias("dim"), F.col("_d.key").alias("key"))
        .agg(F.sum("value").alias("total"))
    )
    return rank_within(per_value, ["dim"], [F.desc("total"), F.asc("key")], n).select("dim", "key", "rank")


def ranked_groups(groups: DataFrame, n: int) -> DataFrame:
    """Groups with each value replaced by its rank (n + 1 beyond the top n) and
    summed again: at most (n + 1)^3 rows, however many groups there were.

    The rank table holds at most 3 n <= 150 rows, hence the broadcast.
    """
    ranks = dimension_ranks(groups, n)
    out = groups
    for d in ("a", "b", "c"):
        dim = ranks.where(F.col("dim") == d).select(F.col("key").alias(f"_k{d}"), F.col("rank").alias(f"r{d}"))
        out = (
            out.join(F.broadcast(dim), F.col(d) == F.col(f"_k{d}"), "left")
            .withColumn(d, F.when(F.col(f"r{d}").isNull(), F.lit(OTHER)).otherwise(F.col(d)))
            .withColumn(f"r{d}", F.coalesce(f"r{d}", F.lit(n + 1)))
            .drop(f"_k{d}")
        )
    return out.groupBy("a", "b", "c", "ra", "rb", "rc").agg(F.sum("value").alias("value"))


def _relabel(df: DataFrame, n: Column) -> DataFrame:
    for d in ("a", "b", "c"):
        df = df.withColumn(d, F.when(F.col(f"r{d}") > n, F.lit(OTHER)).otherwise(F.col(d)))
    return df


def top_n_other(groups: DataFrame, n: int) -> DataFrame:
    """Each dimension's top n values, everything else as "Other", re-summed."""
    ranked = ranked_groups(groups, n)
    return ranked.groupBy("a", "b", "c").agg(F.sum("value").alias("value"))


def adaptive_top_n(groups: DataFrame, n: int, max_links: int = MAX_LINKS) -> DataFrame:
    """Like ``top_n_other`` with the largest N <= n whose graph has at most
    ``max_links`` links. Adds requested_top_n, applied_top_n and capped.

    All candidate N are tried at once on the ranked groups, whose number does not
    depend on the data size.
    """
    if not MIN_TOP <= n <= MAX_TOP:
        raise ValueError(f"n must be between {MIN_TOP} and {MAX_TOP}")
    ranked = ranked_groups(groups, n)
    floor = min(n, ALWAYS_FITS)
    tried = _relabel(ranked.withColumn("n", F.explode(F.sequence(F.lit(floor), F.lit(n)))), F.col("n"))
    # Every group has a value; naming it keeps both uses of the groups alike, so that
    # Spark computes them once and reads the log once.
    links = (
        tried.where(F.col("value") > 0).select("n", F.explode(F.array(F.struct(F.lit(1).alias("layer"), F.col("a").alias("s"), F.col("b").alias("t")),
                                            F.struct(F.lit(2).alias("layer"), F.col("b").alias("s"), F.col("c").alias("t")))).alias("l"))
        .groupBy("n")
        .agg(F.count_distinct("l").alias("links"))
    )
    applied = links.where((F.col("links") <= max_links) | (F.col("n") == floor)).agg(F.max("n").alias("applied_top_n"))
    kept = tried.join(F.broadcast(applied), F.col("n") == F.col("applied_top_n"))
    return (
        kept.groupBy("a", "b", "c", "applied_top_n")
        .agg(F.sum("value").alias("value"))
        .withColumn("requested_top_n", F.lit(n))
        .withColumn("capped", F.col("applied_top_n") != n)
    )


def sankey_nodes(rows: DataFrame, dims: tuple[str, str, str] = DEFAULT_DIMS) -> DataFrame:
    sides = F.array(
        *[F.struct(F.lit(dim).alias("type"), F.col(c).alias("label")) for dim, c in zip(dims, ("a", "b", "c"))]
    )
    return (
        rows.select("value", F.explode(sides).alias("n"))
        .groupBy(F.col("n.type").alias("type"), F.col("n.label").alias("label"))
        .agg(F.sum("value").alias("value"))
        .withColumn("id", F.concat_ws(":", "type", "label"))
    )


def sankey_links(rows: DataFrame, dims: tuple[str, str, str] = DEFAULT_DIMS) -> DataFrame:
    def end(position: int) -> Column:
        return F.concat(F.lit(dims[position] + ":"), F.col("abc"[position]))

    pairs = F.array(
        F.struct(end(0).alias("source"), end(1).alias("target")),
        F.struct(end(1).alias("source"), end(2).alias("target")),
    )
    return (
        rows.select("value", F.explode(pairs).alias("l"))
        .groupBy(F.col("l.source").alias("source"), F.col("l.target").alias("target"))
        .agg(F.sum("value").alias("value"))
    )


def sankey(rows: DataFrame, dims: tuple[str, str, str] = DEFAULT_DIMS) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of remapped groups."""
    return sankey_nodes(rows, dims), sankey_links(rows, dims)


def node_identity(nodes: DataFrame, clients: DataFrame, devices: DataFrame, cfg: NetConfig) -> DataFrame:
    """Name, VLAN and VPN badge of the address nodes of a flow graph."""
    ips = (
        nodes.where(F.col("type").isin("src_ip", "dst_ip") & (F.col("label") != OTHER))
        .select(F.col("label").alias("ip")).distinct()
    )
    client = latest_client(clients).select(
        F.col("ip").alias("_cip"),
        F.coalesce("device_name", "hostname", "oui").alias("_client"),
        F.col("vlan").alias("_client_vlan"),
    )
    device = device_names(devices).select(F.col("ip").alias("_dip"), F.col("infra_name").alias("_device"))
    found = (
        ips.join(client, F.col("ip") == F.col("_cip"), "left")
        .join(device, F.col("ip") == F.col("_dip"), "left")
        .withColumn("_name", F.coalesce("_client", "_device"))
        .withColumn("_who", identity_of("ip", "_name", cfg))
    )
    return found.select(
        "ip", F.col("_who.name").alias("device_name"),
        F.coalesce(F.col("_who.vlan"), F.col("_client_vlan")).alias("vlan"),
        F.col("_who.vpn_badge").alias("vpn_badge"),
    )


def zone_matrix(
    logs: DataFrame, flt: LogFilter, now: Now, cfg: NetConfig = NetConfig(), approximate: bool = False
) -> DataFrame:
    """Traffic per (interface in, interface out) with distinct address pairs."""
    rows = flt.apply(logs, now).where(F.col("interface_in").isNotNull() & F.col("interface_out").isNotNull())
    pairs = (
        F.approx_count_distinct(F.concat_ws("-", "src_ip", "dst_ip"))
        if approximate
        else F.count_distinct("src_ip", "dst_ip")
    )
    cells = rows.groupBy("interface_in", "interface_out").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("rule_action") == "allow").alias("allow_count"),
        F.count_if(F.col("rule_action") == "block").alias("block_count"),
        pairs.alias("unique_pairs"),
    )
    for side in ("in", "out"):
        label = F.col(f"interface_{side}")
        for name, text in cfg.interface_labels.items():
            label = F.when(F.col(f"interface_{side}") == name, text).otherwise(label)
        cells = cells.withColumn(f"{side}_label", label)
    return cells


def with_heat(cells: DataFrame) -> DataFrame:
    """Colour tier of each matrix cell (one row per interface pair)."""
    return cells.withColumn("tier", heat_tier("total", F.max("total").over(Window.partitionBy(F.lit(0)))))


def _host_rows(logs: DataFrame, flt: LogFilter, now: Now, ip: str) -> DataFrame:
    host = checked_ip(ip)
    return flt.apply(logs, now).where((F.col("src_ip") == host) | (F.col("dst_ip") == host))


def host_summary(logs: DataFrame, flt: LogFilter, now: Now, ip: str) -> DataFrame:
    rows = _host_rows(logs, flt, now, ip)
    is_source = F.coalesce(F.col("src_ip") == checked_ip(ip), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("rule_action") == "allow").alias("allow_count"),
        F.count_if(F.col("rule_action") == "block").alias("block_count"),
        F.count_distinct(F.when(is_source, F.col("dst_ip")).otherwise(F.col("src_ip"))).alias("unique_peers"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.max("asn_name").alias("asn_name"),
        F.max("rdns").alias("rdns"),
    )


def host_device(ip: str, clients: DataFrame, devices: DataFrame, cfg: NetConfig = NetConfig()) -> DataFrame:
    """Inventory entry of one host: its latest client, else its latest device."""
    host = checked_ip(ip)
    spark = clients.sparkSession
    one = spark.range(1).select(F.lit(host).alias("ip"))
    client = latest_client(clients.where(F.col("ip") == host)).select(
        "ip", F.coalesce("device_name", "hostname", "oui").alias("_cn"), "network", "vlan", F.col("mac").alias("_cm")
    )
    device = (
        devices.where(F.col("ip") == host)
        .groupBy("ip")
        .agg(F.max_by(F.struct("device_name", "model", "mac"), F.struct("updated_at", "mac")).alias("_d"))
    )
    found = one.join(client, "ip", "left").join(device, "ip", "left")
    has_client = F.col("_cm").isNotNull()
    name = F.when(has_client, F.col("_cn")).otherwise(F.coalesce("_d.device_name", "_d.model"))
    found = found.withColumn("_name", name).withColumn("_who", identity_of("ip", "_name", cfg))
    return found.select(
        "ip", F.col("_who.name").alias("device_name"),
        F.coalesce(F.nullif(F.col("network"), F.lit("")), F.col("_who.vpn_badge")).alias("network"),
        F.coalesce(F.col("_who.vlan"), F.col("vlan")).alias("vlan"),
        F.when(has_client, F.col("_cm")).otherwise(F.col("_d.mac")).alias("mac"),
    )


def host_peers(
    logs: DataFrame, clients: DataFrame, devices: DataFrame, flt: LogFilter, now: Now, ip: str, side: str, k: int = 10
) -> DataFrame:
    """Busiest peers of a host: ``side='src'`` where it is the source."""
    own, peer = ("src_ip", "dst_ip") if side == "src" else ("dst_ip", "src_ip")
    rows = flt.apply(logs, now).where((F.col(own) == checked_ip(ip)) & F.col(peer).isNotNull())
    grouped = with_texts(
        rows.withColumnRenamed(peer, "peer_ip"), ["peer_ip"], ["asn_name", "rdns"], count=(F.count(F.lit(1)), "sum"),
        allow_count=(F.count_if(F.col("rule_action") == "allow"), "sum"), block_count=(F.count_if(F.col("rule_action") == "block"), "sum"),
    ).select("peer_ip", "count", "allow_count", "block_count", "asn_name", "rdns")
    top = top_k(grouped, k, F.desc("count"), F.asc("peer_ip"))
    named = join_names_by_ip(top, clients, devices, "peer_ip", "device_name")
    return named.orderBy(F.desc("count"), F.asc("peer_ip"))


def peer_names(peers: DataFrame, clients: DataFrame, devices: DataFrame) -> DataFrame:
    return names_for_ips(peers.select(F.col("peer_ip").alias("ip")), clients, devices)


def host_ports(logs: DataFrame, flt: LogFilter, now: Now, ip: str, k: int = 15) -> DataFrame:
    """Port breakdown, grouped by the raw service and protocol."""
    rows = _host_rows(logs, flt, now, ip).where(F.col("dst_port").isNotNull())
    grouped = rows.groupBy("dst_port", "service_name", "protocol").agg(F.count(F.lit(1)).alias("count"))
    top = top_k(
        grouped, k, F.desc("count"), F.asc("dst_port"), F.asc_nulls_last("service_name"), F.asc_nulls_last("protocol")
    )
    return top.select(
        "dst_port", F.coalesce("service_name", F.lit("Unknown")).alias("service_name"),
        F.coalesce(F.lower("protocol"), F.lit("unknown")).alias("protocol"), "count",
    )
