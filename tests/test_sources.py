"""Sources, sinks and snapshots on literal inputs."""

import json

from pyspark.sql import functions as F

from netlens.config import NetConfig
from netlens.operators.filters import LogFilter, TimeWindow
from netlens.schema import conform
from netlens.sources import dns_queries, inventory, services, sinks, syslog


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("  one \n\n   \n\ttwo \nthr\udcffee\n".encode("utf-8", "surrogateescape"))
    rows = syslog.read_syslog(spark, str(tmp_path)).collect()
    assert [r.raw_log for r in rows] == ["one", "two", "thr�ee"]


def test_service_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "Service Name,Port Number,Transport Protocol,Description,Reference,Notes\n"
        "first,80,tcp,First,,\nwww,80,TCP,World Wide Web,[RFC1],\nhttp,80,tcp,\"World, Wide\nWeb\",[rfc9110],\nlate,80,tcp,Late,,\n"
        ",81,udp,Only text,,\nrange,90-95,udp,range,,\nx,,tcp,No port,,\nbad,a-b,tcp,Bad,,\ny,5,xyz,Bad protocol,,\n"
        "one,7,udp,A,,\ntwo,7,udp,B,,\n"
    )
    rows = {(r.port, r.protocol): (r.service_name, r.description) for r in services.load_service_dim(spark, str(tmp_path / "r.csv")).collect()}
    assert rows == {
        (80, "tcp"): ("http", "World, Wide\nWeb"), (81, "udp"): ("Only text", None), (90, "udp"): ("range", None), (7, "udp"): ("one", "A"),
    }
    df = spark.createDataFrame([(80, "TCP"), (80, None), (7, "udp"), (None, "tcp"), (1, "tcp")], "dst_port int, protocol string")
    dim = services.load_service_dim(spark, str(tmp_path / "r.csv"))
    assert [r.iana_service for r in services.service_name(df, dim).collect()] == ["http", "http", "one", None, None]


def test_inventory(spark, tmp_path):
    active = [{"mac": "AA:BB:CC:00:00:01", "last_ip": "10.0.0.1", "name": "now", "last_seen": 1700000000}, {"mac": ""}]
    historic = [
        {"mac": "aa:bb:cc:00:00:01", "last_ip": "10.0.0.9", "name": "then", "hostname": "h"},
        {"mac": "aa:bb:cc:00:00:02", "last_ip": "10.0.0.2", "last_connection_network_name": "LAN"},
    ]
    device = [{"mac": "DD:00:00:00:00:01", "ip": "10.0.0.5", "name": "sw", "type": "usw", "version": "1.2", "uptime": 5}]
    feed = [{"ipAddress": "1.2.3.4"}, {"ipAddress": "2001:DB8:0::1", "abuseConfidenceScore": 90}, {"abuseConfidenceScore": 1}, {"ipAddress": "9.9.9.9"}]
    for name, rows in (("a", active), ("h", historic), ("d", device), ("f", feed)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"data": rows}))

    def load(name, schema):
        return inventory.read_payload(spark, str(tmp_path / f"{name}.json"), schema)

    clients = inventory.load_clients(load("a", inventory.ACTIVE_SCHEMA), load("h", inventory.HISTORIC_SCHEMA)).orderBy("mac").collect()
    assert [(r.mac, r.ip, r.device_name, r.hostname, r.network, r.is_fixed_ip) for r in clients] == [
        ("aa:bb:cc:00:00:01", "10.0.0.1", "now", None, None, False), ("aa:bb:cc:00:00:02", "10.0.0.2", None, None, "LAN", False),
    ]
    assert str(clients[0].last_seen) == "2023-11-14 22:13:20"
    (dev,) = inventory.load_devices(load("d", inventory.DEVICE_SCHEMA)).collect()
    assert (dev.mac, dev.device_type, dev.firmware, dev.uptime) == ("dd:00:00:00:00:01", "usw", "1.2", 5)
    listed = inventory.load_blacklist(load("f", inventory.FEED_SCHEMA), ["2001:db8::1", "junk"]).orderBy("ip").collect()
    assert [(r.ip, r.threat_score, r.threat_categories) for r in listed] == [("1.2.3.4", 100, ["blacklist"]), ("9.9.9.9", 100, ["blacklist"])]


def test_dns_mapping(spark):
    records = spark.createDataFrame(
        [
            (1, 1706745600.5, "a", "ok.org", "Forwarded", ("10.0.0.1", "pc"), ("IP",)),
            (2, 1706745601.0, "AAAA", "v6.org", "CACHE", ("10.0.0.1", ""), None),
            (3, 1706745602.0, "A", "bad.org", "GRAVITY", None, ("IP",)),
            (4, 1706745603.0, "A", "none.org", "odd", ("", None), ("NXDOMAIN",)),
            (5, None, None, None, None, None, None),
        ],
        "id bigint, time double, type string, domain string, status string, client struct<ip:string,name:string>, reply struct<type:string>",
    )
    answers = spark.createDataFrame([("ok.org", "A", "192.168.3.3"), ("v6.org", "AAAA", "2606:4700::1"), ("bad.org", "A", "9.9.9.9"), ("none.org", "A", "9.9.9.9")], "domain string, qtype string, answer string")
    rows = dns_queries.map_dns_query(records, answers, "2024-02-01 00:00:00").orderBy("id").collect()
    assert [(r.dns_answer, r.dst_ip, r.rule_action, r.rule_desc) for r in rows] == [
        ("192.168.3.3", None, "allow", "FORWARDED"), ("2606:4700::1", "2606:4700::1", "allow", "CACHE"), (None, None, "block", "GRAVITY"),
        (None, None, "allow", "ODD"), (None, None, "allow", ""),
    ]
    assert str(rows[0].timestamp) == "2024-02-01 00:00:00.500000" and str(rows[4].timestamp) == "2024-02-01 00:00:00"
    assert (rows[1].src_device_name, rows[3].src_ip, rows[0].dst_port, rows[0].protocol) == (None, None, 53, "UDP")


def test_log_table_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = spark.range(1000).select(
        "id", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id)").alias("timestamp"),
        F.when(F.col("id") % 4 == 0, "dns").otherwise("firewall").alias("log_type"), F.lit("x").alias("raw_log"),
    )
    sinks.write_logs(rows, path)
    logs = sinks.read_logs(spark, path)
    assert logs.count() == 1000
    recent = LogFilter(time=TimeWindow("24h"), log_type="dns").apply(logs, "2024-02-11 16:00:00")
    plan = recent.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "log_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "log_type" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in plan
    assert recent.count() == 6
    # A repair rewrites the partitions it touches and no others.
    day = conform(logs.where("log_date = '2024-01-02' AND log_type = 'dns'").withColumn("raw_log", F.lit("fixed")))
    sinks.write_logs(day, path, mode="overwrite")
    again = sinks.read_logs(spark, path)
    assert again.count() == 1000 and again.where("raw_log = 'fixed'").count() == 6


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    assert sinks.read_snapshot(spark, path, "k int").count() == 0
    for version in (1, 2):
        sinks.write_snapshot(spark.createDataFrame([(version,)], "k int"), path, version)
    assert [r.k for r in sinks.read_snapshot(spark, path, "k int").collect()] == [2]
    assert [r.k for r in sinks.read_snapshot(spark, path, "k int", before=2).collect()] == [1]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1", ["a", "b"], True), (None, None, None), ('q"x', [], False)], "t string, l array<string>, b boolean")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"))
    (file,) = (tmp_path / "c").glob("*.csv")
    assert file.read_text().splitlines() == ["t,l,b", "'=1,\"['a', 'b']\",True", ",,", '"q""x",[],False']
    assert NetConfig().own_ips == ()
