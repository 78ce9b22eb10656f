"""Reputation lists, threat map and per-address profiles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.config import RDNS_TTL_SECONDS
from netlens.functions.ip import ip_text
from netlens.functions.scalars import ts_lit
from netlens.operators.filters import TimeWindow, in_window, threat_filter
from netlens.operators.topk import latest_per_key, newest_ids, top_k

Now = str | datetime
MAP_SCORE = 70
MAX_POINTS = 10_000
MAP_MODES = {
    "threats": lambda: F.col("threat_score") > MAP_SCORE,
    "blocked_outbound": lambda: (F.col("direction") == "outbound") & (F.col("rule_action") == "block"),
}
GEO_KEYS = ["geo_lat", "geo_lon", "geo_country", "geo_city"]


def threat_geo(
    logs: DataFrame, window: TimeWindow, now: Now, mode: str = "threats", points: int = 500, ids: int = 50
) -> DataFrame:
    """Events per place with the newest event ids.

    The places are counted and cut to ``points`` first. Ids are then gathered for
    those places only, at most ``ids`` per place and task, so neither the number
    of places nor a place with a third of all events matters.
    """
    if mode not in MAP_MODES:
        raise ValueError(f"mode must be one of {sorted(MAP_MODES)}")
    if not 1 <= points <= MAX_POINTS:
        raise ValueError(f"points must be between 1 and {MAX_POINTS}")
    rows = in_window(logs, window, now).where(
        MAP_MODES[mode]() & F.col("geo_lat").isNotNull() & F.col("geo_lon").isNotNull()
    )
    places = rows.groupBy(*GEO_KEYS).agg(
        F.count(F.lit(1)).alias("count"),
        F.max("threat_score").alias("max_score"),
        # Halves round away from zero; a plain cast would truncate.
        F.round(F.avg("threat_score")).cast("int").alias("avg_score"),
        F.count_distinct(F.coalesce("src_ip", "dst_ip")).alias("unique_ips"),
    )
    order = [F.desc("count"), *[F.asc_nulls_last(c) for c in GEO_KEYS]]
    top = top_k(places, points, *order)
    # At most `points` rows. The events carry the figures of their place, so the
    # places are computed once.
    figures = F.struct(*top.columns).alias("_place")
    picked = F.broadcast(top.select(*[F.col(c).alias(f"_p_{c}") for c in GEO_KEYS], figures))
    same = F.lit(True)
    for key in GEO_KEYS:
        same = same & F.col(key).eqNullSafe(F.col(f"_p_{key}"))
    newest = newest_ids(rows.join(picked, same), ["_place"], ids)
    return newest.select("_place.*", "log_ids").orderBy(*order)


def threat_geojson(geo: DataFrame) -> DataFrame:
    """One GeoJSON Feature per row of ``threat_geo``."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Point").alias("type"),
            F.array(F.col("geo_lon").cast("double"), F.col("geo_lat").cast("double")).alias("coordinates"),
        ).alias("geometry"),
        F.struct(
            F.col("geo_country").alias("country"), F.col("geo_city").alias("city"), F.col("count"),
            F.coalesce("max_score", F.lit(0)).alias("max_score"),
            F.coalesce("avg_score", F.lit(0)).alias("avg_score"),
            F.col("unique_ips"), F.col("log_ids"),
        ).alias("properties"),
    )
    return geo.select(feature.alias("feature"))


def feature_collection(geo: DataFrame, mode: str = "threats", time_range: str | None = None) -> DataFrame:
    """The whole map as one JSON document (at most 500 features)."""
    whole = threat_geojson(geo).agg(
        F.collect_list("feature").alias("features"),
        F.count(F.lit(1)).alias("total_points"),
        F.coalesce(F.sum("feature.properties.count"), F.lit(0)).alias("total_events"),
    )
    document = F.struct(
        F.lit("FeatureCollection").alias("type"), F.col("features"),
        F.struct("total_points", "total_events", F.lit(time_range).alias("time_range"), F.lit(mode).alias("mode")).alias("summary"),
    )
    return whole.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("geojson"))


def geo_totals(geo: DataFrame) -> DataFrame:
    return geo.agg(
        F.count(F.lit(1)).alias("total_points"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_events")
    )


LIST_SORTS = ("threat_score", "looked_up_at", "abuse_total_reports")


def list_threats(
    threats: DataFrame, min_score: int = 0, max_score: int | None = None, ip: str | None = None,
    since: str | None = None, sort: str = "threat_score", descending: bool = True, k: int = 100,
) -> DataFrame:
    if not 1 <= k <= 1000:
        raise ValueError("k must be between 1 and 1000")
    column = sort if sort in LIST_SORTS else "threat_score"
    order = F.desc_nulls_first(column) if descending else F.asc_nulls_last(column)
    rows = threats.where(threat_filter(min_score, max_score, ip, since))
    return top_k(rows, k, order, F.asc("ip"))


def both_sides(logs: DataFrame, columns: tuple[str, ...] = ("rdns", "asn_name", "timestamp", "id")) -> DataFrame:
    """Each log once per address it names: as source and as target (UNION ALL)."""
    src = logs.where(F.col("src_ip").isNotNull()).select(F.col("src_ip").alias("ip"), *columns)
    dst = logs.where(F.col("dst_ip").isNotNull()).select(F.col("dst_ip").alias("ip"), *columns)
    return src.unionByName(dst)


def latest_names(logs: DataFrame, now: Now, days: int = 90, ips: DataFrame | None = None) -> DataFrame:
    """Latest reverse name and AS of each address, from either side of the logs.

    The wanted addresses cut the rows before the union is aggregated.
    """
    recent = logs.where(
        (F.col("timestamp") >= ts_lit(now) - F.expr(f"INTERVAL {int(days)} DAYS"))
        & (F.col("rdns").isNotNull() | F.col("asn_name").isNotNull())
    )
    rows = both_sides(recent)
    if ips is not None:
        rows = rows.join(ips.select("ip"), "ip", "left_semi")
    return latest_per_key(rows, ["ip"], "timestamp", "id").select("ip", "rdns", "asn_name")


PROFILE_COLUMNS = ("threat_score", "threat_categories", "abuse_usage_type", "abuse_total_reports", "abuse_is_tor")


def ip_profiles(ips: DataFrame, threats: DataFrame, logs: DataFrame, now: Now) -> DataFrame:
    """Reputation and latest names of the asked addresses; an address nothing is
    known of keeps a row of NULLs, an invalid one is dropped."""
    asked = ips.select(ip_text("ip").alias("ip")).where(F.col("ip").isNotNull()).distinct()
    known = threats.select("ip", *PROFILE_COLUMNS)
    names = latest_names(logs, now, ips=asked)
    return asked.join(known, "ip", "left").join(names, "ip", "left")


def seed_threats(logs: DataFrame, threats: DataFrame) -> DataFrame:
    """Reputation rows for scored sources that have none yet, from their newest
    scored log. Known addresses are dropped after the aggregate, not per log."""
    scored = logs.where(F.col("threat_score").isNotNull() & F.col("src_ip").isNotNull())
    newest = latest_per_key(
        scored.select(F.col("src_ip").alias("ip"), "threat_score", "threat_categories", "timestamp", "id"),
        ["ip"], "timestamp", "id",
    )
    return newest.join(threats.select("ip"), "ip", "left_anti").select(
        "ip", "threat_score", "threat_categories", F.col("timestamp").alias("looked_up_at")
    )


def fresh_threats(threats: DataFrame, now: Now, days: int = 4) -> DataFrame:
    """Reputation rows young enough to use; missing categories read as empty."""
    return threats.where(F.col("looked_up_at") > ts_lit(now) - F.expr(f"INTERVAL {int(days)} DAYS")).withColumn(
        "threat_categories", F.coalesce("threat_categories", F.array().cast("array<string>"))
    )


def fresh_rdns(cache: DataFrame, now: Now) -> DataFrame:
    """Reverse names still valid for their status; only a success shows a name."""
    ttl = F.lit(None).cast("bigint")
    for status, seconds in RDNS_TTL_SECONDS.items():
        ttl = F.when(F.col("status") == status, F.lit(seconds).cast("bigint")).otherwise(ttl)
    age = ts_lit(now).cast("bigint") - F.col("looked_up_at").cast("bigint")
    return cache.where(age < ttl).select(
        "ip", "status", F.when(F.col("status") == "success", F.col("hostname")).alias("rdns")
    )


def orphans(ips: DataFrame, threats: DataFrame) -> DataFrame:
    """Addresses without a reputation row."""
    return ips.select("ip").distinct().join(threats.select("ip"), "ip", "left_anti")
