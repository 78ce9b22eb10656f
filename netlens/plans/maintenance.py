"""Repair and upkeep jobs: table in, corrected table out.

Spark tables have no row updates. A job on a keyed snapshot returns the complete new
table, which ``sources.sinks`` writes next to the old one.

Patches split the logs by the patch condition first. Only the few candidate rows
meet the reputation table; all others pass through without a shuffle. Given the
stored log table, a patch returns the partitions that hold candidates, complete, and
no others; the sink replaces just these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.config import ABUSE_DETAILS, NetConfig
from netlens.functions.ip import ip_text, is_remote, not_own, one_of
from netlens.functions.rules import direction_of
from netlens.functions.scalars import lower_protocol, next_retry, non_empty, reinterpret_tz, service_display, ts_lit
from netlens.operators.dims import CLIENT_NAME, join_service
from netlens.operators.filters import normalised_exclusions
from netlens.operators.policy import resolve_action
from netlens.operators.threats import orphans
from netlens.operators.topk import latest_per_key, top_k
from netlens.plans.changes import Repair, repaired
from netlens.plans.staging import spread_null
from netlens.sources.sinks import PARTITIONS

Now = str | datetime
Rule = Callable[[Column, Column], Column]
QUEUE_BATCH = 50
STALE_BATCH = 10


def replaced(old: Column, new: Column) -> Column:
    return new


def kept_if_null(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def larger(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def upsert(old: DataFrame, new: DataFrame, key: str, rules: dict[str, Rule]) -> DataFrame:
    """Rows of both tables by key. Where both have one, each column follows its
    rule (columns without a rule keep the old value). New rows without a key are left
    out; of several with one key the greatest by all columns counts."""
    new = latest_per_key(new.where(F.col(key).isNotNull()), [key])
    o = old.select(F.col(key).alias("_ok"), F.struct(*old.columns).alias("_o"))
    n = new.select(F.col(key).alias("_nk"), F.struct(*new.columns).alias("_n"))
    joined = o.join(n, F.col("_ok") == F.col("_nk"), "full_outer")
    out = []
    for c, kind in old.dtypes:
        before = F.col(f"_o.{c}")
        after = F.col(f"_n.{c}").cast(kind) if c in new.columns else F.lit(None).cast(kind)
        merged = rules[c](before, after) if c in rules else before
        out.append(F.when(F.col("_nk").isNull(), before).when(F.col("_ok").isNull(), after).otherwise(merged).alias(c))
    return joined.select(*out)


# ---- reputation table -------------------------------------------------------


def _spelled(rows: DataFrame) -> DataFrame:
    """Addresses in the one spelling the tables use."""
    return rows.withColumn("ip", F.coalesce(ip_text("ip"), F.col("ip")))


def upsert_threats(threats: DataFrame, results: DataFrame, now: Now, own: Iterable[str] = ()) -> DataFrame:
    """Store lookup results. Details a result lacks keep their old value; own
    addresses are never stored."""
    fresh = _spelled(results)
    excluded = normalised_exclusions(own)
    if excluded:
        fresh = fresh.where(~F.col("ip").isin(excluded))
    fresh = fresh.withColumns(
        {
            "threat_score": F.coalesce("threat_score", F.lit(0)),
            "threat_categories": F.coalesce("threat_categories", F.array().cast("array<string>")),
            "looked_up_at": ts_lit(now), "last_seen_at": ts_lit(now),
        }
    )
    rules: dict[str, Rule] = {c: kept_if_null for c in ABUSE_DETAILS}
    rules |= {c: replaced for c in ("threat_score", "threat_categories", "looked_up_at", "last_seen_at")}
    return upsert(threats, fresh, "ip", rules)


def upsert_feed(threats: DataFrame, feed: DataFrame, now: Now) -> DataFrame:
    """Store a block-list feed: the higher score, and several known categories
    outweigh the feed's single one."""
    fresh = _spelled(feed).withColumns({"looked_up_at": ts_lit(now), "last_seen_at": ts_lit(now)})
    rules: dict[str, Rule] = {
        "threat_score": larger,
        "threat_categories": lambda old, new: F.when(F.size(old) > 1, old).otherwise(new),
        "looked_up_at": replaced,
    }
    return upsert(threats, fresh, "ip", rules)


def touch_last_seen(threats: DataFrame, logs: DataFrame) -> DataFrame:
    """Move ``last_seen_at`` of known addresses to their newest log."""
    seen = logs.where(F.col("remote_ip").isNotNull()).groupBy(F.col("remote_ip").alias("_ip")).agg(
        F.max("timestamp").alias("_seen")
    )
    return (
        threats.join(seen, F.col("ip") == F.col("_ip"), "left")
        .withColumn("last_seen_at", F.greatest("last_seen_at", "_seen"))
        .drop("_ip", "_seen")
    )


def fill_last_seen(threats: DataFrame) -> DataFrame:
    return threats.withColumn("last_seen_at", F.coalesce("last_seen_at", "looked_up_at"))


def stale_candidates(threats: DataFrame, now: Now, k: int = STALE_BATCH) -> DataFrame:
    """Scored addresses without any detail, looked up more than a week ago."""
    bare = F.lit(True)
    for c in ABUSE_DETAILS:
        bare = bare & F.col(c).isNull()
    old = F.col("looked_up_at") < ts_lit(now) - F.expr("INTERVAL 7 DAYS")
    rows = threats.where((F.col("threat_score") > 0) & bare & old)
    return top_k(rows, k, F.desc_nulls_last("last_seen_at"), F.desc("threat_score"), F.asc("ip"))


# ---- retry queue ------------------------------------------------------------


def enqueue(queue: DataFrame, ips: DataFrame, now: Now, source: str = "live_miss") -> DataFrame:
    """Add addresses; one already queued is seen again but keeps a later retry."""
    at = ts_lit(now)
    new = ips.select("ip").distinct().select(
        "ip", F.lit(source).alias("source"), at.alias("first_seen_at"), at.alias("last_seen_at"),
        at.alias("next_retry_at"), F.lit(0).alias("attempts"),
    )
    return upsert(queue, new, "ip", {"last_seen_at": replaced, "next_retry_at": larger})


def due(queue: DataFrame, now: Now, k: int = QUEUE_BATCH) -> DataFrame:
    rows = queue.where(F.col("next_retry_at") <= ts_lit(now))
    return top_k(rows, k, F.asc("next_retry_at"), F.desc("last_seen_at"), F.asc("ip"))


def complete(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("ip"), "ip", "left_anti")


def fail(queue: DataFrame, failed: DataFrame, error: str, now: Now) -> DataFrame:
    """Count an attempt and push the next one back exponentially."""
    marks = failed.select(F.col("ip").alias("_ip")).distinct()
    hit = F.col("_ip").isNotNull()
    columns = queue.columns
    if "last_error" not in columns:
        queue = queue.withColumn("last_error", F.lit(None).cast("string"))
    return (
        queue.join(marks, F.col("ip") == F.col("_ip"), "left")
        .withColumns(
            {
                "next_retry_at": F.when(hit, next_retry(ts_lit(now), "attempts")).otherwise(F.col("next_retry_at")),
                "attempts": F.col("attempts") + F.when(hit, 1).otherwise(0),
                "last_error": F.when(hit, F.lit(error)).otherwise(F.col("last_error")),
            }
        )
        .drop("_ip")
    )


def queue_stats(queue: DataFrame, now: Now) -> DataFrame:
    return queue.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("next_retry_at") <= ts_lit(now)).alias("due"),
        F.count_if(F.col("attempts") > 0).alias("retried"),
    )


def queue_cycle(
    queue: DataFrame, results: DataFrame, threats: DataFrame, logs: DataFrame, now: Now,
    own: Iterable[str] = (), budget: int = QUEUE_BATCH,
) -> dict[str, DataFrame]:
    """One round of the retry queue with the lookup results as a table: a row with
    a score is a success, a row without one or no row a failure, and what exceeds
    the budget stays queued. Returns the new threats, queue and logs.
    """
    own = tuple(own)
    tried = due(queue, now, budget).select("ip")
    looked = tried.join(results, "ip", "left")
    good = looked.where(F.col("threat_score").isNotNull())
    bad = looked.where(F.col("threat_score").isNull()).select("ip")
    detailed = F.lit(False)
    for c, kind in results.dtypes:
        if c in ABUSE_DETAILS:
            empty = {"string": F.lit(""), "int": F.lit(0), "boolean": F.lit(False)}.get(kind)
            known = F.col(c).isNotNull() if empty is None else F.coalesce(F.col(c) != empty, F.lit(False))
            detailed = detailed | known
    new_threats = upsert_threats(threats, good, now, own)
    # Both in one pass: the second sees the scores that the first has filled.
    patched = repaired(
        logs, [score_repair(new_threats, good.select("ip"), own), detail_repair(new_threats, good.where(detailed).select("ip"), own)]
    )
    rest = fail(complete(queue, good), bad, "lookup_failed", now)
    return {"threats": new_threats, "queue": rest, "logs": patched}


def seed_queue(logs: DataFrame, threats: DataFrame, queue: DataFrame, cfg: NetConfig, now: Now) -> DataFrame:
    """Queue the remote addresses of unscored blocks that have no reputation."""
    rows = logs.where(_blocked_firewall() & F.col("threat_score").isNull())
    sides = [
        rows.where(is_remote(side, cfg.own_ips)).select(F.col(side).alias("ip")) for side in ("src_ip", "dst_ip")
    ]
    return enqueue(queue, orphans(sides[0].unionByName(sides[1]), threats), now, source="seed")


# ---- patches of log rows ----------------------------------------------------


def _blocked_firewall() -> Column:
    return (F.col("log_type") == "firewall") & (F.col("rule_action") == "block")


def _split(logs: DataFrame, candidate: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates, rows that stay as they are). Of the stored table only partitions
    that hold a candidate are given on, so that a repair of few rows rewrites few files."""
    test = F.coalesce(candidate, F.lit(False))
    rows, rest = logs.where(test), logs.where(~test)
    if set(PARTITIONS) <= set(logs.columns):
        touched = rows.select(*[F.col(c).alias(f"_{c}") for c in PARTITIONS]).distinct()
        same = F.lit(True)
        for c in PARTITIONS:
            same = same & (F.col(c) == F.col(f"_{c}"))
        rest = rest.join(touched, same, "left_semi")
    return rows, rest


def _with_reputation(rows: DataFrame, threats: DataFrame, ips: DataFrame | None, own: tuple[str, ...]) -> DataFrame:
    dim = threats.where(not_own("ip", own))
    if ips is not None:
        dim = dim.join(ips.select("ip").distinct(), "ip", "left_semi")
    details = F.struct("threat_score", "threat_categories", *ABUSE_DETAILS)
    for name, side in (("_src", "src_ip"), ("_dst", "dst_ip")):
        rows = rows.join(
            dim.select(F.col("ip").alias(f"{name}_ip"), details.alias(name)),
            spread_null(F.col(side), F.col("id")) == F.col(f"{name}_ip"), "left",
        ).drop(f"{name}_ip")
    return rows


def _unscored() -> Column:
    return _blocked_firewall() & F.col("threat_score").isNull()


def _scored(rows: DataFrame, threats: DataFrame, ips: DataFrame | None, own: tuple[str, ...]) -> DataFrame:
    joined = _with_reputation(rows, threats, ips, own).withColumn("_t", F.coalesce("_src", "_dst"))
    known = F.col("_t").isNotNull()
    fills = {c: F.when(known, F.col(f"_t.{c}")).otherwise(F.col(c)) for c in ("threat_score", "threat_categories")}
    fills |= {c: F.coalesce(F.col(c), F.col(f"_t.{c}")) for c in ABUSE_DETAILS}
    return joined.withColumns(fills).drop("_src", "_dst", "_t")


def score_repair(threats: DataFrame, ips: DataFrame | None = None, own: Iterable[str] = ()) -> Repair:
    own = tuple(own)
    return Repair(_unscored(), lambda rows: _scored(rows, threats, ips, own))


def patch_scores(logs: DataFrame, threats: DataFrame, ips: DataFrame | None = None, own: Iterable[str] = ()) -> DataFrame:
    """Give unscored blocks the reputation of their source, else of their target."""
    rows, rest = _split(logs, _unscored())
    return rest.unionByName(_scored(rows, threats, ips, tuple(own)).select(*logs.columns))


def _detail_pass(rows: DataFrame, side: str) -> DataFrame:
    any_detail = F.lit(False)
    for c in ABUSE_DETAILS:
        any_detail = any_detail | F.col(f"{side}.{c}").isNotNull()
    hit = F.col(side).isNotNull() & any_detail & F.col("abuse_usage_type").isNull()
    fills = {c: F.when(hit, F.col(f"{side}.{c}")).otherwise(F.col(c)) for c in ABUSE_DETAILS}
    fills["threat_categories"] = F.when(
        hit, F.coalesce(non_empty("threat_categories"), non_empty(f"{side}.threat_categories"), F.col("threat_categories"))
    ).otherwise(F.col("threat_categories"))
    return rows.withColumns(fills)


def _undetailed() -> Column:
    return _blocked_firewall() & F.col("threat_score").isNotNull() & F.col("abuse_usage_type").isNull()


def _detailed(rows: DataFrame, threats: DataFrame, ips: DataFrame | None, own: tuple[str, ...]) -> DataFrame:
    joined = _with_reputation(rows, threats, ips, own)
    return _detail_pass(_detail_pass(joined, "_src"), "_dst").drop("_src", "_dst")


def detail_repair(threats: DataFrame, ips: DataFrame | None = None, own: Iterable[str] = ()) -> Repair:
    own = tuple(own)
    return Repair(_undetailed(), lambda rows: _detailed(rows, threats, ips, own))


def patch_details(logs: DataFrame, threats: DataFrame, ips: DataFrame | None = None, own: Iterable[str] = ()) -> DataFrame:
    """Fill abuse details of scored blocks without a usage type, from the source
    and then from the target, which overwrites a source without usage type."""
    rows, rest = _split(logs, _undetailed())
    return rest.unionByName(_detailed(rows, threats, ips, tuple(own)).select(*logs.columns))


def patch_refresh(logs: DataFrame, threats: DataFrame, ip: str, own: Iterable[str] = ()) -> DataFrame:
    """Overwrite the blocks of one address with its refreshed reputation; where it
    is on both sides both passes agree, and the target pass comes last."""
    own = tuple(own)
    involved = (F.col("src_ip") == ip) | (F.col("dst_ip") == ip)
    rows, rest = _split(logs, _blocked_firewall() & involved)
    joined = _with_reputation(rows, threats.where(F.col("ip") == ip), None, own)
    for side in ("_src", "_dst"):
        hit = F.col(side).isNotNull()
        fills = {c: F.when(hit, F.col(f"{side}.{c}")).otherwise(F.col(c)) for c in ABUSE_DETAILS}
        fills["threat_score"] = F.coalesce(F.col(f"{side}.threat_score"), F.col("threat_score"))
        fills["threat_categories"] = F.coalesce(non_empty(f"{side}.threat_categories"), F.col("threat_categories"))
        joined = joined.withColumns(fills)
    return rest.unionByName(joined.select(*logs.columns))


def backfill_services(logs: DataFrame, services: DataFrame) -> DataFrame:
    """Service names of firewall rows that lack one, as shown at ingest."""
    wanted = (F.col("log_type") == "firewall") & F.col("service_name").isNull() & F.col("dst_port").isNotNull()
    rows, rest = _split(logs, wanted)
    named = join_service(rows, services).withColumn("service_name", service_display("iana_service"))
    return rest.unionByName(named.select(*logs.columns))


def backfill_actions(logs: DataFrame, zmap: DataFrame, policies: DataFrame) -> DataFrame:
    """Correct the action of zone-index rules from the policies."""
    rows, rest = _split(
        logs, (F.col("log_type") == "firewall") & F.col("rule_name").rlike("^[A-Z][A-Z0-9]*_[A-Z][A-Z0-9]*-[0-9]+$")
    )
    fixed = resolve_action(rows, zmap, policies).withColumn("rule_action", F.coalesce("resolved_action", "rule_action"))
    return rest.unionByName(fixed.select(*logs.columns))


def backfill_direction(logs: DataFrame, cfg: NetConfig) -> DataFrame:
    """Derive the direction of all firewall rows again, after a WAN change. Of the stored
    table only partitions are given in which some row gets another one."""
    again = direction_of("interface_in", "interface_out", "rule_name", "src_ip", "dst_ip", cfg)
    rows, rest = _split(logs, (F.col("log_type") == "firewall") & ~again.eqNullSafe(F.col("direction")))
    return rest.unionByName(rows.withColumn("direction", again))


def wan_repairs(logs: DataFrame, attributes: DataFrame, threats: DataFrame, cfg: NetConfig) -> list[Repair]:
    """The repairs of ``repair_wan_enrichment``: clear and enrich, then score the unscored
    blocks whose source or target is the target of a cleared row."""
    wrong = (
        (F.col("log_type") == "firewall") & one_of("src_ip", cfg.wan_ips)
        & F.col("geo_country").isNotNull() & F.col("dst_ip").isNotNull()
    )
    geo = ("geo_country", "geo_city", "geo_lat", "geo_lon", "asn_number", "asn_name", "rdns")
    present = [c for c in geo if c in attributes.columns]
    remote = is_remote("dst_ip", cfg.own_ips)
    targets = logs.where(wrong & remote).select(F.col("dst_ip").alias("ip")).distinct()

    def clear(rows: DataFrame) -> DataFrame:
        dim = attributes.select(F.col("ip").alias("_ip"), F.struct(*present).alias("_a"))
        joined = rows.join(dim, spread_null(F.col("dst_ip"), F.col("id")) == F.col("_ip"), "left")
        types = dict(rows.dtypes)
        fills = {
            c: F.when(remote, F.col(f"_a.{c}") if c in present else F.lit(None)).cast(types[c]) for c in geo if c in types
        }
        if "rdns" in fills and not cfg.rdns_enabled:
            fills["rdns"] = F.lit(None).cast("string")
        fills |= {c: F.lit(None).cast(types[c]) for c in ("threat_score", "threat_categories", *ABUSE_DETAILS)}
        return joined.withColumns(fills).drop("_ip", "_a")

    return [Repair(wrong, clear), score_repair(threats, targets, cfg.wan_ips)]


def repair_wan_enrichment(
    logs: DataFrame, attributes: DataFrame, threats: DataFrame, cfg: NetConfig
) -> DataFrame:
    """Rows enriched on the site's own source address: enrich them on a remote
    target instead, or clear them. ``attributes`` (ip, geography, AS, rdns) comes
    from ``operators.enrich.remote_attributes`` over the targets."""
    if not cfg.wan_ips:
        return logs
    return repaired(logs, wan_repairs(logs, attributes, threats, cfg))


def drop_own_threats(threats: DataFrame, cfg: NetConfig) -> DataFrame:
    return threats.where(not_own("ip", cfg.own_ips))


def repair_abuse(logs: DataFrame, threats: DataFrame, cfg: NetConfig) -> tuple[DataFrame, DataFrame]:
    """(threats, logs) without the site's own reputation: inbound rows to an own
    address take the reputation of their source, or none."""
    if not cfg.wan_ips:
        return threats, logs
    clean = drop_own_threats(threats, cfg)
    wrong = (
        one_of("dst_ip", cfg.wan_ips) & F.col("direction").isin("inbound", "in") & not_own("src_ip", cfg.own_ips)
        & (F.col("abuse_hostnames").isNotNull() | F.col("abuse_usage_type").isNotNull())
    )
    rows, rest = _split(logs, wrong)
    columns = ("threat_score", "threat_categories", *ABUSE_DETAILS)
    dim = clean.select(F.col("ip").alias("_ip"), F.struct(*columns).alias("_t"))
    fixed = rows.join(dim, F.col("src_ip") == F.col("_ip"), "left").withColumns({c: F.col(f"_t.{c}") for c in columns})
    return clean, rest.unionByName(fixed.select(*logs.columns))


def latest_name_per_ip(clients: DataFrame) -> DataFrame:
    """Newest named client per address: ip, name, last_seen."""
    name = F.coalesce(*[F.col(c) for c in CLIENT_NAME])
    named = clients.select("ip", name.alias("name"), "last_seen", "mac").where(
        F.col("name").isNotNull() & F.col("ip").isNotNull()
    )
    return latest_per_key(named, ["ip"], "last_seen", "mac").select("ip", "name", "last_seen")


def join_name_timebound(logs: DataFrame, clients: DataFrame) -> DataFrame:
    """Adds ``_dst_name``: the target's client name, if the row is not older than a
    day before that client was last seen."""
    dim = latest_name_per_ip(clients).select(
        F.col("ip").alias("_ip"), F.col("name").alias("_dst_name"), F.col("last_seen").alias("_seen")
    )
    on = (F.col("dst_ip") == F.col("_ip")) & (F.col("timestamp") >= F.col("_seen") - F.expr("INTERVAL 1 DAY"))
    return logs.join(dim, on, "left").drop("_ip", "_seen")


def backfill_names(logs: DataFrame, clients: DataFrame, since: Now) -> DataFrame:
    """Fill missing device names of rows since a date: source by MAC, target by
    address within the time bound. Adds the flags ``_src_patched`` and
    ``_dst_patched`` for counting."""
    src, dst = F.col("src_device_name"), F.col("dst_device_name")
    open_src = src.isNull() & F.col("mac_address").isNotNull()
    open_dst = dst.isNull() & F.col("dst_ip").isNotNull()
    rows, rest = _split(logs, (F.col("timestamp") >= ts_lit(since)) & (open_src | open_dst))
    by_mac = clients.select(
        F.col("mac").alias("_mac"), F.coalesce(*[F.col(c) for c in CLIENT_NAME]).alias("_src_name")
    ).where(F.col("_src_name").isNotNull())
    key = spread_null(F.col("mac_address"), F.col("id"))
    joined = join_name_timebound(rows, clients).join(by_mac, key == F.col("_mac"), "left")
    fills, none = {}, {}
    for side, stored in (("src", src), ("dst", dst)):
        found = F.col(f"_{side}_name")
        fills[f"_{side}_patched"] = stored.isNull() & found.isNotNull()
        fills[f"{side}_device_name"] = F.coalesce(stored, found)
        none[f"_{side}_patched"] = F.lit(False)
    fixed = joined.withColumns(fills).select(*logs.columns, "_src_patched", "_dst_patched")
    return rest.withColumns(none).unionByName(fixed)


def patch_counts(patched: DataFrame) -> DataFrame:
    return patched.agg(
        F.count_if("_src_patched").alias("src_patched"), F.count_if("_dst_patched").alias("dst_patched")
    )


def repair_tz(logs: DataFrame, tz: str) -> DataFrame:
    if tz in ("", "UTC", "Etc/UTC", "GMT", "Etc/GMT"):
        return logs
    return logs.withColumn("timestamp", reinterpret_tz("timestamp", tz))


def repair_protocol(logs: DataFrame) -> DataFrame:
    return logs.withColumn("protocol", lower_protocol("protocol"))


# ---- inventory and reverse names --------------------------------------------


def _by_mac(batch: DataFrame) -> DataFrame:
    return batch.withColumn("mac", F.nullif(F.lower(F.trim("mac")), F.lit("")))


def upsert_clients(clients: DataFrame, batch: DataFrame, now: Now) -> DataFrame:
    keep = ("device_name", "hostname", "oui", "network", "essid", "vlan", "is_fixed_ip", "is_wired")
    rules: dict[str, Rule] = {c: kept_if_null for c in keep}
    rules |= {"ip": replaced, "last_seen": larger, "updated_at": replaced}
    return upsert(clients, _by_mac(batch).withColumn("updated_at", ts_lit(now)), "mac", rules)


def upsert_devices(devices: DataFrame, batch: DataFrame, now: Now) -> DataFrame:
    keep = ("device_name", "model", "shortname", "device_type", "firmware", "serial")
    rules: dict[str, Rule] = {c: kept_if_null for c in keep}
    rules |= {c: replaced for c in ("ip", "state", "uptime", "updated_at")}
    return upsert(devices, _by_mac(batch).withColumn("updated_at", ts_lit(now)), "mac", rules)


def upsert_rdns(cache: DataFrame, batch: DataFrame, now: Now) -> DataFrame:
    fresh = _spelled(batch).withColumn("looked_up_at", ts_lit(now))
    return upsert(cache, fresh, "ip", {c: replaced for c in ("hostname", "status", "looked_up_at")})


def sweep_rdns(cache: DataFrame, now: Now) -> DataFrame:
    """Entries of the last eight days: older ones are expired whatever their status."""
    return cache.where(F.col("looked_up_at") >= ts_lit(now) - F.expr("INTERVAL 8 DAYS"))
