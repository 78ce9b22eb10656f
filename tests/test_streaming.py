"""Streams over files, run to the end and compared with the batch result."""

import json

from pyspark.sql import functions as F

from netlens.config import NetConfig
from netlens.operators.enrich import EnrichmentTables
from netlens.operators.rangejoin import cidr_blocks
from netlens.plans.parse import parse_lines
from netlens.schema import THREAT_COLUMNS, ddl
from netlens.plans.maintenance import patch_scores
from netlens.plans.retention import purge, purge_snapshot
from netlens.sources.sinks import read_logs, write_logs
from netlens.streaming import dns, ingest, state
from netlens.streaming.queue import read_queue

NOW = "2024-02-10 12:00:00"
HEAD = "Feb  8 16:43:{:02d} GW "
LINES = [
    HEAD.format(1) + "[WAN_LAN-B-1]IN=ppp0 OUT=br0 SRC=45.0.0.5 DST=192.168.1.2 PROTO=TCP SPT=5 DPT=22",
    HEAD.format(2) + "[WAN_LAN-B-1]IN=ppp0 OUT=br0 SRC=45.9.0.5 DST=192.168.1.2 PROTO=TCP SPT=5 DPT=22",
    HEAD.format(3) + "[WAN_LAN-A-1]IN=ppp0 OUT=br0 SRC=45.9.0.6 DST=192.168.1.2 PROTO=TCP SPT=5 DPT=80",
    HEAD.format(4) + "hostapd: ath0: STA aa:bb:cc:dd:ee:ff IEEE 802.11: associated",
    HEAD.format(5) + "systemd[1]: started",
    "garbage",
    "Feb 31 10:00:00 GW systemd[1]: no such day",
    "",
]


def _tables(spark):
    blocks = spark.createDataFrame([("45.0.0.0/8", 1, "big"), ("45.0.0.0/24", 2, "small")], "network string, asn_number int, asn_name string")
    threats = spark.createDataFrame([("45.0.0.5", 80)], "ip string, threat_score int").withColumn("looked_up_at", F.lit("2024-02-09 00:00:00").cast("timestamp"))
    for name, kind in THREAT_COLUMNS.items():
        if name not in threats.columns:
            threats = threats.withColumn(name, F.lit(None).cast(kind))
    services = spark.createDataFrame([(22, "tcp", "ssh", None)], "port int, protocol string, service_name string, description string")
    return EnrichmentTables(asn_blocks=cidr_blocks(blocks).select("start_key", "end_key", "prefix_len", "asn_number", "asn_name"), threats=threats), services


def test_ingest(spark, tmp_path):
    src, out, queue = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "queue")
    src.mkdir()
    (src / "1.log").write_text("\n".join(LINES))
    tables, services = _tables(spark)

    def run():
        ingest.start_ingest(
            spark, str(src), out, str(tmp_path / "cp"), tables, NetConfig(), services, ["wifi"], queue, NOW, once=True
        ).awaitTermination()

    run()
    rows = spark.read.parquet(f"{out}/logs").orderBy("timestamp").collect()
    assert [(r.log_type, r.remote_ip, r.asn_name, r.threat_score, r.service_name) for r in rows] == [
        ("firewall", "45.0.0.5", "small", 80, "ssh"), ("firewall", "45.9.0.5", "big", None, "ssh"),
        ("firewall", "45.9.0.6", "big", None, None), ("system", None, None, None, None),
    ]
    assert sorted((r.raw_log, r.reason) for r in spark.read.parquet(f"{out}/quarantine").collect()) == [
        (LINES[6], "timestamp"), ("garbage", "header"),
    ]
    # Only a block without reputation is queued.
    assert [(r.ip, r.attempts) for r in read_queue(spark, queue).collect()] == [("45.9.0.5", 0)]
    # A second file adds its rows; the first one is not read again.
    (src / "2.log").write_text(LINES[1].replace("45.9.0.5", "45.9.0.77") + "\n")
    run()
    assert spark.read.parquet(f"{out}/logs").count() == 5
    assert sorted(r.ip for r in read_queue(spark, queue).collect()) == ["45.9.0.5", "45.9.0.77"]


def test_batch_repeated_gives_the_same(spark, tmp_path):
    tables, services = _tables(spark)
    lines = spark.createDataFrame([(t,) for t in LINES[:3]], "raw_log string")
    for _ in range(2):
        ingest.store_batch(lines, 4, str(tmp_path), NetConfig(), NOW, tables, services, (), str(tmp_path / "q"))
    rows = spark.read.parquet(f"{tmp_path}/logs")
    assert rows.count() == 3 and rows.select("id").distinct().count() == 3
    assert read_queue(spark, str(tmp_path / "q")).count() == 1


def test_one_table_through_ingest_repair_purge_and_replay(spark, tmp_path):
    tables, services = _tables(spark)
    out = str(tmp_path)
    same = LINES[4]
    first = spark.createDataFrame([(t,) for t in (same, same, LINES[1])], "raw_log string").coalesce(1)
    second = spark.createDataFrame([(t,) for t in (same, LINES[0])], "raw_log string").coalesce(1)

    def store(lines, batch):
        return ingest.store_batch(lines, batch, out, NetConfig(), NOW, tables, services)

    def logs():
        return read_logs(spark, f"{out}/logs")

    assert store(first, 0) == {"received": 3, "parsed": 3, "filtered": 0, "failed": 0, "dropped": 0}
    ids = [r.id for r in logs().collect()]
    assert len(set(ids)) == 3
    snapshot = purge_snapshot(logs(), "system").first()
    store(second, 1)
    store(first, 0)  # a replay
    again = logs().orderBy("id").collect()
    assert [r.id for r in again][:3] == sorted(ids) and len(again) == 5 and len({r.id for r in again}) == 5
    kept = purge(logs(), "system", snapshot.max_id)
    assert sorted((r.log_type, r.batch // 2) for r in kept.collect()) == [("firewall", 0), ("firewall", 1), ("system", 1)]
    # A repair gives back the partitions that hold a candidate and the sink replaces just them.
    files = {f for f in (tmp_path / "logs").rglob("*.parquet")}
    threats = tables.threats.withColumn("ip", F.lit("45.9.0.5"))
    fixed = patch_scores(logs(), threats)
    assert {(r.log_type, r.batch) for r in fixed.select("log_type", "batch").distinct().collect()} == {("firewall", 0)}
    write_logs(fixed, f"{out}/logs", mode="overwrite")
    assert logs().count() == 5 and logs().where("threat_score = 80").count() == 2
    left = {f for f in (tmp_path / "logs").rglob("*.parquet")}
    assert {f for f in files if "log_type=firewall/batch=0" not in str(f)} <= left


def test_own_addresses_are_learned_while_none_is_configured(spark, tmp_path):
    shows = HEAD.format(9) + "[WAN_LOCAL-B-1]IN=ppp0 OUT= SRC=45.9.0.7 DST=45.8.8.8 PROTO=TCP SPT=5 DPT=22"
    uses = HEAD.format(10) + "[LAN_WAN-A-1]IN=br0 OUT=br7 SRC=45.8.8.8 DST=45.9.0.7 PROTO=TCP SPT=5 DPT=22"
    found = {}
    for name, cfg in (("learned", NetConfig()), ("configured", NetConfig(wan_ips=("45.1.1.1",)))):
        lines = spark.createDataFrame([(shows,), (uses,)], "raw_log string")
        ingest.store_batch(lines, 0, str(tmp_path / name), cfg, NOW, EnrichmentTables())
        rows = read_logs(spark, str(tmp_path / name / "logs")).where("src_ip = '45.8.8.8'")
        found[name] = rows.first().direction
    assert found["learned"] != found["configured"]


def test_ingest_metrics(spark):
    lines = spark.createDataFrame([(t,) for t in LINES if t], "raw_log string")
    from pyspark.sql import Observation

    seen = Observation("ingest")
    parsed = parse_lines(lines, NetConfig(), NOW)
    watched = ingest.with_ingest_metrics(parsed, ["wifi"], seen)
    watched.count()
    assert seen.get == {"received": 7, "parsed": 6, "filtered": 1, "failed": 1, "dropped": 1}


def _records(path, name, rows):
    (path / name).write_text("\n".join(
        json.dumps({"id": i, "time": t, "type": "A", "domain": f"h{i}.org", "status": "FORWARDED", "client": {"ip": "10.0.0.1"}, "reply": {"type": "IP"}})
        for i, t in rows
    ))


def test_dns_ingest(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    answers = spark.createDataFrame([("h2.org", "A", "45.0.0.5")], "domain string, qtype string, answer string")

    def run():
        dns.run_dns_ingest(spark, str(src), out, str(tmp_path / "cp"), answers, NOW, tables=_tables(spark)[0]).awaitTermination()

    _records(src, "1.json", [(1, 1707560000.0), (2, 1707560001.0), (2, 1707560001.0)])
    run()
    _records(src, "2.json", [(2, 1707560001.0), (3, 1707560002.0)])  # overlapping poll
    run()
    # A record two hours late, after an outage, and text that is no record.
    _records(src, "3.json", [(4, 1707552800.0)])
    (src / "4.json").write_text("no json\n")
    run()
    rows = read_logs(spark, f"{out}/logs").orderBy("record_id").collect()
    assert [(r.record_id, r.dns_query, r.dst_ip, r.rule_action, r.asn_name) for r in rows] == [
        (1, "h1.org", None, "allow", None), (2, "h2.org", "45.0.0.5", "allow", "small"), (3, "h3.org", None, "allow", None),
        (4, "h4.org", None, "allow", None),
    ]
    assert len({r.id for r in rows}) == 4
    assert [(r.raw_log, r.reason) for r in spark.read.parquet(f"{out}/quarantine").collect()] == [("no json", "json")]


def _stream(spark, tmp_path, rows):
    schema = "timestamp timestamp, remote_ip string, log_type string, rule_action string, threat_score int"
    typed = spark.createDataFrame(rows, "at string, remote_ip string, log_type string, rule_action string, threat_score int")
    path = str(tmp_path / "in")
    typed.withColumn("timestamp", F.col("at").cast("timestamp")).drop("at").coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


ROWS = [
    ("2024-02-08 10:00:00", "1.1.1.1", "firewall", "block", 80), ("2024-02-08 10:00:20", "1.1.1.1", "firewall", "block", 10),
    ("2024-02-08 10:00:30", "2.2.2.2", "firewall", "allow", None), ("2024-02-08 11:30:00", None, "dns", None, None),
]


def test_coalesced_touches(spark, tmp_path):
    out = str(tmp_path / "out")
    touches = state.coalesce_touches(_stream(spark, tmp_path, ROWS))
    touches.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert sorted(r.ip for r in spark.read.parquet(out).collect()) == ["1.1.1.1", "2.2.2.2"]


def test_live_counts(spark, tmp_path):
    found = {}

    def keep(df, _):
        for r in df.collect():  # a few hours of test data
            found[str(r.period)] = (r.total, r.allowed, r.blocked, r.threats, r.redirect)

    counts = state.live_counts(_stream(spark, tmp_path, ROWS))
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert found == {"2024-02-08 10:00:00": (3, 1, 2, 1, 0), "2024-02-08 11:00:00": (1, 0, 0, 0, 0)}
    assert ddl({"a": "int"}) == "a int"
