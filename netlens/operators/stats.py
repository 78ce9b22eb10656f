"""Dashboard figures: overview, breakdowns, top lists and time series.

Every function takes the full ``logs``; the time window comes first, so date
partitions outside it are not read. Counts are conditional aggregates of one
scan, top lists keep k rows per task, names are joined after the limit.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions.ip import is_public_ip_sql, not_own
from netlens.functions.scalars import bucket_of, time_bucket
from netlens.operators.dims import join_latest_client, rank_within
from netlens.operators.filters import TimeWindow, in_window
from netlens.operators.topk import count_top, top_k, with_texts

Now = str | datetime
TOP = 10
HIGH_SCORE = 50  # a threat in the figures is a score above this


def blocked() -> Column:
    return F.col("rule_action") == "block"


def allowed() -> Column:
    return F.col("rule_action") == "allow"


def firewall() -> Column:
    return F.col("log_type") == "firewall"


def overview(logs: DataFrame, window: TimeWindow, now: Now) -> DataFrame:
    """Allowed counts firewall rows only, blocked counts every type."""
    return in_window(logs, window, now).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(firewall() & allowed()).alias("allowed"),
        F.count_if(blocked()).alias("blocked"),
        F.count_if(F.col("threat_score") > HIGH_SCORE).alias("threats"),
    )


def by_type(logs: DataFrame, window: TimeWindow, now: Now) -> DataFrame:
    return in_window(logs, window, now).groupBy("log_type").agg(F.count(F.lit(1)).alias("count"))


def by_direction(logs: DataFrame, window: TimeWindow, now: Now) -> DataFrame:
    rows = in_window(logs, window, now).where(F.col("direction").isNotNull())
    return rows.groupBy("direction").agg(F.count(F.lit(1)).alias("count"))


def _rows() -> tuple[Column, str]:
    return F.count(F.lit(1)), "sum"


def _score() -> tuple[Column, str]:
    return F.max("threat_score"), "max"


def _action_rows(logs: DataFrame, window: TimeWindow, now: Now, action: str) -> DataFrame:
    return in_window(logs, window, now).where(F.col("rule_action") == action)


def top_countries(logs: DataFrame, window: TimeWindow, now: Now, action: str, k: int = TOP) -> DataFrame:
    """Blocked: any direction. Allowed: outbound only."""
    rows = _action_rows(logs, window, now, action).where(F.col("geo_country").isNotNull())
    if action == "allow":
        rows = rows.where(F.col("direction") == "outbound")
    return count_top(rows.withColumnRenamed("geo_country", "country"), ["country"], k)


def top_countries_both(logs: DataFrame, window: TimeWindow, now: Now, k: int = TOP) -> DataFrame:
    """Both lists from one scan."""
    rows = (
        in_window(logs, window, now)
        .where(F.col("geo_country").isNotNull())
        .where(blocked() | (allowed() & (F.col("direction") == "outbound")))
    )
    counted = rows.groupBy("rule_action", F.col("geo_country").alias("country")).agg(F.count(F.lit(1)).alias("count"))
    return rank_within(counted, ["rule_action"], [F.desc("count"), F.asc("country")], k)


def top_services(logs: DataFrame, window: TimeWindow, now: Now, action: str, k: int = TOP) -> DataFrame:
    rows = _action_rows(logs, window, now, action).where(F.col("service_name").isNotNull())
    return count_top(rows, ["service_name"], k)


def top_services_both(logs: DataFrame, window: TimeWindow, now: Now, k: int = TOP) -> DataFrame:
    rows = in_window(logs, window, now).where(F.col("service_name").isNotNull() & (blocked() | allowed()))
    counted = rows.groupBy("rule_action", "service_name").agg(F.count(F.lit(1)).alias("count"))
    return rank_within(counted, ["rule_action"], [F.desc("count"), F.asc("service_name")], k)


def top_blocked_external(
    logs: DataFrame, window: TimeWindow, now: Now, own: Iterable[str] = ("0.0.0.0",), k: int = TOP
) -> DataFrame:
    rows = _action_rows(logs, window, now, "block").where(is_public_ip_sql("src_ip") & not_own("src_ip", tuple(own)))
    rows = rows.withColumnsRenamed({"src_ip": "ip", "geo_country": "country", "asn_name": "asn"})
    grouped = with_texts(rows, ["ip"], ["country", "asn"], count=_rows(), threat_score=_score())
    return top_k(grouped.select("ip", "count", "country", "asn", "threat_score"), k, F.desc("count"), F.asc("ip"))


def _internal_sources(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("src_ip").isNotNull() & ~is_public_ip_sql("src_ip")).withColumnRenamed("src_ip", "ip")


def top_blocked_internal(
    logs: DataFrame, clients: DataFrame, window: TimeWindow, now: Now, k: int = TOP
) -> DataFrame:
    """Names come from clients seen since a day before the window."""
    top = count_top(_internal_sources(_action_rows(logs, window, now, "block")), ["ip"], k)
    named = join_latest_client(top, clients, "ip", "device_name", since=window.bounds(now)[0])
    return named.orderBy(F.desc("count"), F.asc("ip"))


def top_threats(
    logs: DataFrame, threats: DataFrame, window: TimeWindow, now: Now,
    own: Iterable[str] = ("0.0.0.0",), k: int = TOP,
) -> DataFrame:
    """Sources with a high score; categories of the log, else of the reputation
    row. The dimension is joined to the k result rows only."""
    rows = in_window(logs, window, now).where(
        (F.col("threat_score") > HIGH_SCORE) & F.col("src_ip").isNotNull() & not_own("src_ip", tuple(own))
    )
    rows = rows.select(
        F.col("src_ip").alias("ip"), F.col("geo_country").alias("country"), F.col("asn_name").alias("asn"), F.col("geo_city").alias("city"),
        "rdns", "threat_score", F.col("threat_categories").alias("_own_categories"), "timestamp",
    )
    texts = ["country", "asn", "city", "rdns", "_own_categories"]
    grouped = with_texts(rows, ["ip"], texts, count=_rows(), threat_score=_score(), last_seen=(F.max("timestamp"), "max"))
    grouped = grouped.select("ip", "count", "country", "asn", "city", "rdns", "threat_score", "_own_categories", "last_seen")
    top = top_k(grouped, k, F.desc("threat_score"), F.desc("count"), F.asc("ip"))
    return (
        join_threat(top, threats.select("ip", "threat_categories"))
        .withColumn("threat_categories", F.coalesce("_own_categories", "threat_categories"))
        .drop("_own_categories")
        .orderBy(F.desc("threat_score"), F.desc("count"), F.asc("ip"))
    )


def join_threat(df: DataFrame, threats: DataFrame, ip_col: str = "ip") -> DataFrame:
    dim = threats.withColumnRenamed("ip", "_tip")
    return df.join(dim, F.col(ip_col) == F.col("_tip"), "left").drop("_tip")


def top_allowed_dst(
    logs: DataFrame, window: TimeWindow, now: Now, own: Iterable[str] = ("0.0.0.0",), k: int = TOP
) -> DataFrame:
    rows = _action_rows(logs, window, now, "allow").where(is_public_ip_sql("dst_ip") & not_own("dst_ip", tuple(own)))
    rows = rows.withColumnsRenamed({"dst_ip": "ip", "geo_country": "country", "asn_name": "asn"})
    grouped = with_texts(rows, ["ip"], ["country", "asn"], count=_rows())
    return top_k(grouped.select("ip", "count", "country", "asn"), k, F.desc("count"), F.asc("ip"))


def top_active_internal(
    logs: DataFrame, clients: DataFrame, window: TimeWindow, now: Now,
    gateways: Iterable[str] = (), k: int = TOP,
) -> DataFrame:
    rows = _internal_sources(_action_rows(logs, window, now, "allow")).where(not_own("ip", tuple(gateways)))
    named = join_latest_client(count_top(rows, ["ip"], k), clients, "ip", "device_name", since=window.bounds(now)[0])
    return named.orderBy(F.desc("count"), F.asc("ip"))


def top_dns(logs: DataFrame, window: TimeWindow, now: Now, k: int = TOP) -> DataFrame:
    rows = in_window(logs, window, now).where((F.col("log_type") == "dns") & F.col("dns_query").isNotNull())
    return count_top(rows, ["dns_query"], k)


def over_time(logs: DataFrame, window: TimeWindow, now: Now) -> DataFrame:
    rows = in_window(logs, window, now)
    return rows.groupBy(time_bucket("timestamp", window.normalise().preset).alias("period")).agg(
        F.count(F.lit(1)).alias("count")
    )


def action_over_time(logs: DataFrame, window: TimeWindow, now: Now) -> DataFrame:
    """Firewall rows per bucket and action, zero where an action is missing."""
    rows = in_window(logs, window, now).where(firewall() & F.col("rule_action").isNotNull())
    return rows.groupBy(time_bucket("timestamp", window.normalise().preset).alias("period")).agg(
        *[F.count_if(F.col("rule_action") == a).alias(a) for a in ("allow", "block", "redirect")]
    )


# ---- the whole dashboard from one scan --------------------------------------


def _sections(own: tuple[str, ...], gateways: tuple[str, ...], bucket: str) -> list[tuple[str, Column, Column]]:
    """(section, condition, key): which rows count for which list."""
    score = F.col("threat_score") > HIGH_SCORE
    public_src = is_public_ip_sql("src_ip") & not_own("src_ip", own)
    public_dst = is_public_ip_sql("dst_ip") & not_own("dst_ip", own)
    internal = ~is_public_ip_sql("src_ip")
    period = F.date_format(F.date_trunc(bucket, "timestamp"), "yyyy-MM-dd HH:mm:ss")
    everything = F.lit(True)
    return [
        ("total", everything, F.lit("all")),
        ("allowed", firewall() & allowed(), F.lit("all")),
        ("blocked", blocked(), F.lit("all")),
        ("threats", score, F.lit("all")),
        ("by_type", everything, F.col("log_type")),
        ("by_direction", everything, F.col("direction")),
        ("logs_over_time", everything, period),
        ("traffic_by_action", firewall() & F.col("rule_action").isNotNull(), F.concat_ws("|", period, "rule_action")),
        ("top_blocked_countries", blocked(), F.col("geo_country")),
        ("top_allowed_countries", allowed() & (F.col("direction") == "outbound"), F.col("geo_country")),
        ("top_blocked_services", blocked(), F.col("service_name")),
        ("top_allowed_services", allowed(), F.col("service_name")),
        ("top_blocked_ips", blocked() & public_src, F.col("src_ip")),
        ("top_blocked_internal_ips", blocked() & internal, F.col("src_ip")),
        ("top_threat_ips", score & not_own("src_ip", own), F.col("src_ip")),
        ("top_allowed_destinations", allowed() & public_dst, F.col("dst_ip")),
        ("top_active_internal_ips", allowed() & internal & not_own("src_ip", gateways), F.col("src_ip")),
        ("top_dns", F.col("log_type") == "dns", F.col("dns_query")),
    ]


TABLE_SECTIONS = tuple(
    "top_blocked_countries top_allowed_countries top_blocked_services top_allowed_services top_blocked_ips"
    " top_blocked_internal_ips top_threat_ips top_allowed_destinations top_active_internal_ips top_dns".split()
)
# Lists that show country and AS of an address.
EXTERNAL_SECTIONS = ("top_blocked_ips", "top_threat_ips", "top_allowed_destinations")
CHART_SECTIONS = ("logs_over_time", "traffic_by_action")
OVERVIEW_SECTIONS = ("total", "allowed", "blocked", "threats", "by_type", "by_direction")


def dashboard(
    logs: DataFrame, clients: DataFrame, window: TimeWindow, now: Now,
    own: Iterable[str] = ("0.0.0.0",), gateways: Iterable[str] = (),
    sections: Iterable[str] = (*OVERVIEW_SECTIONS, *CHART_SECTIONS, *TABLE_SECTIONS), k: int = TOP,
) -> DataFrame:
    """All requested sections as one long table (section, rank, key, count, ...).

    A row is emitted once per section it counts for and aggregated right away in
    the same stage: one scan and one shuffle of partial counts instead of one
    scan per list. Ranking happens per section on the counts.
    """
    wanted = set(sections)
    chosen = [
        s for s in _sections(tuple(own), tuple(gateways), bucket_of(window.normalise().preset)) if s[0] in wanted
    ]
    entries = F.array(
        *[
            F.when(
                cond & key.isNotNull(),
                F.struct(
                    F.lit(name).alias("section"), key.alias("key"), F.lit(name in TABLE_SECTIONS).alias("ranked"),
                    F.lit(name in EXTERNAL_SECTIONS).alias("external"),
                ),
            )
            for name, cond, key in chosen
        ]
    )
    emitted = (
        in_window(logs, window, now)
        .select("geo_country", "asn_name", "threat_score", F.explode(entries).alias("_e"))
        .where(F.col("_e").isNotNull())
    )
    shown = F.col("_e.external")
    emitted = emitted.select(
        "_e.section", "_e.key", "_e.ranked", "threat_score",
        F.when(shown, F.col("geo_country")).alias("country"), F.when(shown, F.col("asn_name")).alias("asn"),
    )
    # ``ranked`` is an aggregate, so a test of it stays above the aggregation: both parts
    # below read the same shuffle.
    counted = with_texts(emitted, ["section", "key"], ["country", "asn"], count=_rows(), threat_score=_score(), ranked=(F.max("ranked"), "max"))
    is_table = F.col("ranked")
    series = counted.where(~is_table).withColumn("rank", F.lit(0))
    worst_first = F.desc(F.when(F.col("section") == "top_threat_ips", F.col("threat_score")))
    lists = rank_within(counted.where(is_table), ["section"], [worst_first, F.desc("count"), F.asc("key")], k)
    ranked = series.unionByName(lists)
    named = join_latest_client(ranked, clients, "key", "device_name", since=window.bounds(now)[0])
    internal = F.col("section").isin("top_blocked_internal_ips", "top_active_internal_ips")
    external = F.col("section").isin(*EXTERNAL_SECTIONS)
    return named.select(
        "section", "rank", "key", "count",
        F.when(external, F.col("country")).alias("country"),
        F.when(external, F.col("asn")).alias("asn"),
        F.when(external, F.col("threat_score")).alias("threat_score"),
        F.when(internal, F.col("device_name")).alias("device_name"),
    )
