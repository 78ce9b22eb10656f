"""Filters, scalars, joins and limits on literal inputs."""

import pytest
from pyspark.sql import functions as F

from netlens.config import NetConfig
from netlens.functions import register, scalars as sc
from netlens.operators import aggregate, filters, flows, identity, search, threats, topk
from netlens.operators.dims import resolve_names
from netlens.operators.enrich import EnrichmentTables, enrich
from netlens.operators.rangejoin import cidr_blocks, range_join
from netlens.operators.topk import newest
from netlens.plans import maintenance, retention
from netlens.plans.maintenance import upsert_clients, upsert_feed, upsert_threats
from netlens.schema import THREAT_COLUMNS

NOW = "2024-01-31 00:00:00"


@pytest.mark.parametrize(
    "given, expected",
    [
        ((None, None, None), ("24h", None, None)), (("bad", None, None), ("24h", None, None)), (("7d", None, None), ("7d", None, None)),
        (("7d", "2024-01-01", None), (None, "2024-01-01", None)), (("7d", "nonsense", "2024-01-02"), ("7d", None, "2024-01-02")),
        ((None, "nonsense", "also"), ("24h", None, None)), ((None, None, "2024-01-02T00:00:00Z"), ("24h", None, "2024-01-02T00:00:00Z")),
    ],
)
def test_time_parameters(given, expected):
    window = filters.TimeWindow(*given).normalise()
    assert (window.preset, window.start, window.end) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("80", (False, 80)), ("!80", (True, 80)), ("0", (False, None)), ("65535", (False, 65535)), ("65536", (False, None)), ("http", (False, None)), ("!", (True, None))],
)
def test_port(text, expected):
    assert filters.parse_port(text) == expected


def test_bad_parameters(spark):
    for call in (lambda: filters.checked_ip("1.2.3"), lambda: retention.resolve_days() and retention._checked(0, 1), lambda: filters.exact(src="x")):
        with pytest.raises(ValueError):
            call()
    assert retention.resolve_days("x", "7") == (7, "env") and retention.resolve_days(30, "7") == (30, "config")
    assert retention.resolve_days(None, "-1") == (60, "default")


def _one(spark, kind, value, fn):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first().y


def test_scalars(spark):
    cells = {"=1": "'=1", "+1": "'+1", "-1": "-1", "-.5": "-.5", "-": "'-", "-.": "'-.", "-a": "'-a", "\tx": "'\tx", "\0": "'\0", "ok": "ok", "": "", "a=b": "a=b"}
    df = spark.createDataFrame(list(cells.items()), "x string, want string")
    assert all(r.y == r.want for r in df.withColumn("y", sc.csv_safe("x")).collect())
    assert _one(spark, "array<string>", ["14", "99", "blacklist", "x"], sc.decode_categories) == "Port Scan, Cat 99, Blacklist, Cat x"
    assert _one(spark, "array<string>", [], sc.decode_categories) is None
    assert _one(spark, "map<string,string>", {"User_Password": "a", "q": "b"}, sc.redact) == {"User_Password": "***", "q": "b"}
    assert _one(spark, "map<string,string>", None, sc.redact) == {}
    assert _one(spark, "string", "[A]b [C] d", sc.rule_desc_norm) == "[A] b [C] d"
    got = _one(spark, "string", '{"tool_name":"t","success":true,"params":{"a":1}}', sc.audit_fields)
    assert (got.tool_name, got.scope, got.success, got.params) == ("t", None, "true", '{"a":1}')
    assert _one(spark, "string", "nope", sc.audit_fields).tool_name is None
    for score, band in ((100, "Critical"), (75, "Critical"), (74, "High"), (50, "High"), (25, "Medium"), (1, "Low"), (0, "Clean"), (None, None)):
        assert _one(spark, "int", score, sc.threat_band) == band
    reports = spark.createDataFrame([([([18, 4],), ([4],)], ["a", "b"])], "r array<struct<categories:array<int>>>, h array<string>")
    row = reports.select(sc.report_summary("r", "h").alias("s")).first().s
    assert (row.categories, row.hostnames) == (["18", "4"], "a, b")
    for name, badge in (("wgsrv1", "WGD SRV"), ("tunovpnc2", "OVPN CLT"), ("tun0", "OVPN TUN"), ("vtun1", "OVPN VTN"), ("br0", None)):
        assert _one(spark, "string", name, sc.vpn_badge) == badge
    labels = spark.createDataFrame([("eth4",), ("eth9",), ("br0",), ("br30",), ("brx",), ("vlan7",), ("eth1",), ("tun1",), ("zz",)], "i string")
    assert [r[0] for r in labels.select(sc.iface_label("i", ["eth4", "eth9"])).collect()] == [
        "WAN1", "WAN2", "Main LAN", "VLAN 30", "brx", "VLAN 7", "Ethernet 1", "VPN", "",
    ]
    assert [r[0] for r in labels.select(sc.iface_vlan_id("i", NetConfig())).collect()][2:5] == [1, 30, None]
    lines = spark.createDataFrame([("inbound", "8.8.8.8", "10.0.0.1"), ("outbound", "10.0.0.1", "8.8.8.8"), (None, None, "fd00::1")], "d string, s string, t string")
    subs = lines.withColumn("a", F.lit("AS")).withColumn("h", F.lit("x")).select(sc.asn_subline("d", "s", "t", "a", "h").alias("z")).select("z.*").collect()
    assert [tuple(r) for r in subs] == [("AS", None), (None, "AS"), (None, None)]


def test_identity(spark):
    cfg = NetConfig(
        gateway_vlans={"192.168.1.1": 1, "10.9.0.1": None}, wan_ip_names={"203.0.113.7": "Uplink"},
        vpn_networks={"wgsrv1": ("10.9.0.0/24", "WGD SRV"), "zz1": ("10.0.0.0/8", "CUSTOM"), "bad": ("x", "B"), "tun1": ("fd09::/64", "OVPN TUN")},
    )
    cases = [
        ("192.168.1.1", None, "Gateway", 1, None), ("192.168.1.1", "router", "router", 1, None), ("203.0.113.7", None, "Uplink", None, None),
        ("203.0.113.7", "x", "x", None, None), ("10.9.0.1", None, "Gateway", None, None), ("10.9.0.2", None, "WireGuard Server", None, "WGD SRV"),
        ("10.8.0.0", None, "CUSTOM", None, "CUSTOM"), ("10.0.0.1", None, "Gateway", None, "CUSTOM"), ("fd09::1", None, "Gateway", None, "OVPN TUN"),
        ("8.8.8.8", None, None, None, None), (None, None, None, None, None), ("10.9.0.2", "named", "named", None, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "n int, ip string, name string, w string, v int, b string")
    for r in df.withColumn("who", identity.identity_of("ip", "name", cfg)).collect():
        assert tuple(r.who) == (r.w, r.v, r.b), r
    both = spark.createDataFrame([("10.0.0.1", "192.168.1.1", None, 5)], "src_ip string, dst_ip string, src_device_name string, dst_device_vlan int")
    row = identity.annotate_identity(both, cfg).first()
    assert (row.src_device_name, row.src_device_network, row.dst_device_name, row.dst_device_vlan) == ("Gateway", "CUSTOM", None, 5)


def test_range_join_both_families(spark):
    blocks = spark.createDataFrame(
        [("10.0.0.0/7", "wide"), ("10.1.0.0/16", "mid"), ("10.1.2.0/25", "narrow"), ("10.1.2.3/32", "one"), ("2000::/3", "v6 all"),
         ("2001:db8::/33", "v6 half"), ("2001:db8:0:1::/64", "v6 net"), ("2001:db8:0:1::5/128", "v6 one"), ("128.0.0.0/1", "half")],
        "network string, name string",
    )
    want = {
        "10.9.9.9": "wide", "11.0.0.1": "wide", "12.0.0.1": None, "10.1.9.9": "mid", "10.1.2.127": "narrow", "10.1.2.128": "mid", "10.1.2.3": "one",
        "200.1.1.1": "half", "3fff::1": "v6 all", "2001:db8:8000::1": "v6 all", "2001:db8:1::1": "v6 half", "2001:db8:0:1::9": "v6 net",
        "2001:db8:0:1::5": "v6 one", "fe80::1": None, "junk": None,
    }
    ips = spark.createDataFrame([(ip,) for ip in want for _ in range(2)] + [(None,)], "ip string")
    dim = cidr_blocks(blocks).select("start_key", "end_key", "prefix_len", "name")
    assert {r.ip: r.name for r in range_join(ips, dim).collect()} == want
    plan = range_join(ips, dim)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_large_limit_equals_plain_limit(spark):
    rows = spark.range(20_000).select("id", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id % 5000)").alias("timestamp"))
    order = [F.desc("timestamp"), F.desc("id")]
    want = [r.id for r in rows.orderBy(*order).limit(3000).collect()]
    assert [r.id for r in topk.newest(rows, 3000, *order).collect()] == want
    assert topk.newest(rows.limit(10), 5000, *order).count() == 10


def test_hot_group_stays_small(spark):
    """One place holds nearly all events: its ids are cut in each task, before the shuffle."""
    rows = spark.range(200_000, numPartitions=8).select(
        "id", F.when(F.col("id") % 1000 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("k"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("timestamp"),
    )
    out = topk.newest_ids(rows, ["k"], 50)
    got = {r.k: r.log_ids for r in out.collect()}
    assert got[99] == list(range(199_999, 199_948, -1))[:50] and all(len(v) <= 50 for v in got.values())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_modal_and_latest(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "b"), ("a", "b"), ("a", None), ("a", None), ("a", None), ("c", None)], "k string, v string")
    assert {r.k: r.m for r in topk.modal(rows, ["k"], "v", "m").collect()} == {"a": "b", "c": None}
    latest = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("b", None, 3)], "k string, at int, v int")
    assert {r.k: r.v for r in topk.latest_per_key(latest, ["k"], "at").collect()} == {"a": 2, "b": 3}


def test_adaptive_flow_graph(spark):
    """Against the step-down rule on a dense graph."""
    import random

    rng = random.Random(3)
    data = [(f"s{rng.randint(1, 60)}", f"p{rng.randint(1, 60)}", f"d{rng.randint(1, 60)}", rng.randint(1, 9)) for _ in range(6000)]
    totals = {}
    for a, b, c, v in data:
        totals[(a, b, c)] = totals.get((a, b, c), 0) + v

    def graph(n):
        tops = []
        for i in range(3):
            sums = {}
            for key, v in totals.items():
                sums[key[i]] = sums.get(key[i], 0) + v
            tops.append({k for k, _ in sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:n]})
        out = {}
        for key, v in totals.items():
            new = tuple(k if k in top else "Other" for k, top in zip(key, tops))
            out[new] = out.get(new, 0) + v
        return out, {(1, a, b) for a, b, _ in out} | {(2, b, c) for _, b, c in out}

    for asked in (50, 20, 5):
        n = asked
        while len(graph(n)[1]) > 400:
            n -= 1
        df = spark.createDataFrame([(*k, v) for k, v in totals.items()], "a string, b string, c string, value long")
        rows = flows.adaptive_top_n(df, asked).collect()
        assert {r.applied_top_n for r in rows} == {n} and {r.capped for r in rows} == {n != asked}
        assert {(r.a, r.b, r.c): r.value for r in rows} == graph(n)[0]


def test_sql_functions(spark):
    names = register.register(spark, NetConfig())
    assert "rule_parse" in names
    row = spark.sql(
        "SELECT is_public_ip_sql('8.8.8.8') a, is_public_ip_sql(NULL) b, cidr24_of('10.1.2.3') c, rule_parse('A_B-7', 'Drop').desc_hint d,"
        " direction_of('ppp0', 'br0', 'x', NULL, NULL) e, csv_safe('=1') f"
    ).first()
    assert tuple(row) == (True, False, "10.1.2.0/24", "block", "inbound", "'=1")


def test_enrichment_decisions(spark):
    cfg = NetConfig(wan_ips=("45.1.1.1",), dns_enrichment="geoip")
    logs = spark.createDataFrame(
        [
            (1, "firewall", "block", "8.8.8.8", "192.168.1.1", None, None), (2, "firewall", "block", "192.168.1.1", "9.9.9.9", None, None),
            (3, "firewall", "allow", "8.8.8.8", "9.9.9.9", None, None), (4, "firewall", "block", "45.1.1.1", "192.168.1.1", None, None),
            (5, "dns", "allow", "192.168.1.5", "9.9.9.9", "dns_resolver", None), (6, "system", None, None, None, None, None),
            (7, "firewall", "block", "7.7.7.7", "192.168.1.1", None, "old"),
        ],
        "id int, log_type string, rule_action string, src_ip string, dst_ip string, source string, rdns string",
    ).withColumn("raw_log", F.col("id").cast("string")).withColumn("mac_address", F.lit(None).cast("string"))
    blocks = cidr_blocks(spark.createDataFrame([("8.0.0.0/8", "US"), ("9.0.0.0/8", "CH")], "network string, geo_country string"))
    rep = spark.createDataFrame([("8.8.8.8", 90), ("9.9.9.9", 10)], "ip string, threat_score int").withColumn("looked_up_at", F.lit("2024-01-30 00:00:00").cast("timestamp"))
    for c in ("threat_categories",):
        rep = rep.withColumn(c, F.lit(None).cast("array<string>"))
    for c, k in (("abuse_usage_type", "string"), ("abuse_hostnames", "string"), ("abuse_total_reports", "int"), ("abuse_last_reported", "timestamp"), ("abuse_is_whitelisted", "boolean"), ("abuse_is_tor", "boolean")):
        rep = rep.withColumn(c, F.lit(None).cast(k))
    names = spark.createDataFrame([("8.8.8.8", "dns.google", "success"), ("9.9.9.9", "gone", "failure")], "ip string, hostname string, status string").withColumn("looked_up_at", F.lit("2024-01-30 12:00:00").cast("timestamp"))
    tables = EnrichmentTables(city_blocks=blocks.select("start_key", "end_key", "prefix_len", "geo_country"), rdns_cache=names, threats=rep)
    rows = enrich(logs, tables, cfg, NOW).orderBy("id").collect()
    assert [(r.remote_ip, r.geo_country, r.rdns, r.threat_score, r.reputation_missing) for r in rows] == [
        ("8.8.8.8", "US", "dns.google", 90, False), ("9.9.9.9", "CH", None, 10, False), ("8.8.8.8", "US", "dns.google", None, False),
        (None, None, None, None, False), ("9.9.9.9", "CH", None, None, False), (None, None, None, None, False), ("7.7.7.7", None, "old", None, True),
    ]


def test_name_resolution_prefers_mac(spark):
    logs = spark.createDataFrame([("10.0.0.1", "10.0.0.2", "AA:00", "old", None), ("10.0.0.1", "8.8.8.8", None, None, "keep")], "src_ip string, dst_ip string, mac_address string, src_device_name string, dst_device_name string")
    ips = spark.createDataFrame([("10.0.0.1", "by-ip"), ("10.0.0.2", "target"), ("8.8.8.8", "public")], "ip string, name string")
    macs = spark.createDataFrame([("aa:00", "by-mac")], "mac string, name string")
    rows = resolve_names(logs, ips, macs, F.col("src_ip").startswith("10."), F.col("dst_ip").startswith("10.")).collect()
    assert sorted((r.src_device_name, r.dst_device_name) for r in rows) == [("by-ip", "keep"), ("by-mac", "target")]


def test_parameter_checks(spark):
    logs = spark.createDataFrame([], "id long, timestamp timestamp, src_ip string, dst_ip string")
    flt = filters.LogFilter()
    for call in (
        lambda: aggregate.aggregate(logs, flt, NOW, by="nope"), lambda: aggregate.aggregate(logs, flt, NOW, by="asn", prefix=24),
        lambda: aggregate.aggregate(logs, flt, NOW, by="src_ip", prefix=23), lambda: aggregate.aggregate(logs, flt, NOW, by="src_ip", min_unique_ips=2),
        lambda: flows.flow_groups(logs, flt, NOW, ("src_ip", "src_ip", "dst_ip")), lambda: flows.flow_groups(logs, flt, NOW, ip="x"),
        lambda: flows.adaptive_top_n(logs, 2), lambda: search.search_page(logs, flt, NOW, size=500), lambda: threats.threat_geo(logs, filters.TimeWindow(), NOW, "x"),
        lambda: retention.purge(logs, "dns", 1), lambda: maintenance.backfill_direction and retention.retain(logs, NOW, 0),
    ):
        with pytest.raises(ValueError):
            call()


def test_newest_agrees_with_a_sort_for_any_limit(spark):
    rows = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 10 = 0 THEN NULL ELSE timestamp_seconds(1706000000 + (id DIV 3) * 7) END AS timestamp"
    )
    order = [F.desc("timestamp"), F.desc("id")]
    whole = [r.id for r in rows.orderBy(*order).collect()]
    for k in (1, 5, 1000, 1001, 2000, 2699, 2701, 5000):
        assert [r.id for r in newest(rows, k, *order).collect()] == whole[:k]
    for skip, k in ((7, 5), (1000, 300), (2695, 10), (2800, 50), (2990, 50), (4000, 5)):
        assert [r.id for r in newest(rows, k, *order, skip=skip).collect()] == whole[skip : skip + k]
    two = rows.where("id in (10, 11)")
    assert [r.id for r in newest(two, 5, *order).collect()] == [11, 10]
    assert newest(rows.where("id % 10 = 0"), 3, *order).count() == 3
    assert newest(rows.limit(0), 3, *order).count() == 0


def test_upserts_take_one_row_per_key(spark):
    old = spark.createDataFrame([("2001:db8::1", 5), ("9.9.9.9", 1)], "ip string, threat_score int")
    for name, kind in THREAT_COLUMNS.items():
        if name not in old.columns:
            old = old.withColumn(name, F.lit(None).cast(kind))
    new = spark.createDataFrame([("2001:DB8::1", 20), ("2001:db8:0::1", 30), (None, 99), ("1.1.1.1", 7), ("1.1.1.1", 8)], "ip string, threat_score int")
    feed = new.withColumn("threat_categories", F.array(F.lit("blacklist")))
    scored = {r.ip: r.threat_score for r in upsert_threats(old, feed, "2024-01-31 00:00:00").collect()}
    assert scored == {"2001:db8::1": 30, "9.9.9.9": 1, "1.1.1.1": 8}
    listed = upsert_feed(old, feed, "2024-01-31 00:00:00")
    assert sorted(r.ip for r in listed.collect()) == ["1.1.1.1", "2001:db8::1", "9.9.9.9"]
    clients = spark.createDataFrame([("aa:bb", "10.0.0.1")], "mac string, ip string")
    batch = spark.createDataFrame([("AA:BB ", "10.0.0.2"), ("aa:bb", "10.0.0.3"), (None, "10.0.0.4"), ("", "10.0.0.5")], "mac string, ip string")
    assert [tuple(r) for r in upsert_clients(clients, batch, "2024-01-31 00:00:00").collect()] == [("aa:bb", "10.0.0.3")]


def test_blocks_meet_only_what_they_hold(spark):
    blocks = cidr_blocks(
        spark.createDataFrame(
            [("45.0.0.0/8", "eight"), ("45.1.0.0/16", "sixteen"), ("45.1.2.128/25", "odd"), ("45.1.2.3/32", "host"), ("2001:db8::/33", "six"), ("0.0.0.0/0", "all4")],
            "network string, name string",
        )
    ).drop("network")
    ips = ["45.9.9.9", "45.1.9.9", "45.1.2.200", "45.1.2.100", "45.1.2.3", "2001:db8:7fff::1", "2001:db8:8000::1", "9.9.9.9", "junk", None]
    found = {r.ip: r.name for r in range_join(spark.createDataFrame([(i,) for i in ips], "ip string"), blocks).collect()}
    assert found == {
        "45.9.9.9": "eight", "45.1.9.9": "sixteen", "45.1.2.200": "odd", "45.1.2.100": "sixteen", "45.1.2.3": "host",
        "2001:db8:7fff::1": "six", "2001:db8:8000::1": None, "9.9.9.9": "all4", "junk": None,
    }
    assert range_join(spark.createDataFrame([("1.1.1.1",)], "ip string"), blocks.limit(0)).collect()[0].name is None


def test_dashboard_reads_the_log_once(spark):
    from netlens.contract import QUERIES

    plan = QUERIES["f18_tables_bundle"](spark, "/root/testdata/sf0.001")
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString()
    assert final.split("== Initial Plan ==")[0].count("events.parquet") == 1
