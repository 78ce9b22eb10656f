"""Repairs, removals and compaction of the stored table, and what streams keep beside it."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netlens.config import NetConfig
from netlens.operators.dims import join_service
from netlens.plans import compaction, maintenance, retention
from netlens.plans.changes import Repair, changes, merged, repaired, store_changes, store_repairs
from netlens.schema import THREAT_COLUMNS, ddl
from netlens.sources import partitions, sinks
from netlens.sources.sinks import PARTITIONS, laid_out, read_logs, write_batch, write_logs
from netlens.streaming import dns, ledger
from netlens.streaming import queue as events

NOW = "2024-02-10 12:00:00"
OWN, REMOTE, OTHER = "45.1.1.1", "45.9.0.5", "45.9.0.6"


def block(i, at, src=REMOTE, **more):
    return {"id": i, "timestamp": at, "log_type": "firewall", "rule_action": "block", "src_ip": src, "dst_ip": "10.0.0.2", **more}


COLUMNS = {
    "id": "long", "timestamp": "string", "log_type": "string", "rule_action": "string", "src_ip": "string", "dst_ip": "string",
    "geo_country": "string", "threat_score": "int", "abuse_usage_type": "string", "protocol": "string", "batch": "long",
}


def stored(spark, path, rows):
    table = spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], ddl(COLUMNS))
    write_logs(table.withColumn("timestamp", F.col("timestamp").cast("timestamp")), path)


def threats(spark, rows):
    table = spark.createDataFrame(rows, "ip string, threat_score int, abuse_usage_type string")
    for name, kind in THREAT_COLUMNS.items():
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast(kind))
    return table.withColumn("looked_up_at", F.lit(NOW).cast("timestamp"))


def content(logs):
    names = [c for c in logs.columns if c not in ("log_date", "batch")]
    return sorted((tuple(r) for r in logs.select(*names).collect()), key=repr)


def files(path):
    return {f for f in path.rglob("*.parquet")}


ROWS = [
    block(1, "2024-02-01 10:00:00", batch=0), block(2, "2024-02-02 10:00:00", OTHER, batch=0), block(3, "2024-02-03 10:00:00", "45.7.7.7", batch=0),
    block(4, "2024-02-02 11:00:00", REMOTE, threat_score=5, batch=2),
    {"id": 5, "timestamp": "2024-02-04 10:00:00", "log_type": "firewall", "rule_action": "allow", "src_ip": OWN, "dst_ip": REMOTE, "geo_country": "DE", "batch": 2},
    {"id": 6, "timestamp": "2024-02-05 10:00:00", "log_type": "wifi", "batch": 2}, {"id": 7, "timestamp": "2024-02-05 10:00:00", "log_type": "system", "batch": 4},
    {"id": 8, "timestamp": "2024-02-05 11:00:00", "log_type": "system", "batch": 6},
]


def test_wan_repair_reaches_the_stored_table(spark, tmp_path):
    """The row repaired and the block scored again are in different partitions."""
    path = str(tmp_path / "logs")
    stored(spark, path, ROWS)
    cfg = NetConfig(wan_ips=(OWN,))
    attributes = spark.createDataFrame([(REMOTE, "FR")], "ip string, geo_country string")
    rep = threats(spark, [(REMOTE, 80, None), (OTHER, 70, None)])
    plain = read_logs(spark, path).drop("log_date", "batch")
    want = content(maintenance.repair_wan_enrichment(plain, attributes, rep, cfg))
    part = maintenance.repair_wan_enrichment(read_logs(spark, path), attributes, rep, cfg)
    assert {r.id for r in part.collect()} == {1, 5}
    logs = read_logs(spark, path)
    store_repairs(spark, path, maintenance.wan_repairs(logs, attributes, rep, cfg))
    logs = {r.id: r for r in read_logs(spark, path).collect()}
    assert content(read_logs(spark, path)) == want and len(logs) == len(ROWS)
    assert logs[5].geo_country == "FR" and logs[1].threat_score == 80 and logs[2].threat_score is None


def test_queue_cycle_keeps_both_patches(spark, tmp_path):
    """One partition gets scores, another details."""
    path = str(tmp_path / "logs")
    stored(spark, path, ROWS)
    queue = spark.createDataFrame([(REMOTE,), (OTHER,)], "ip string")
    queue = maintenance.enqueue(spark.createDataFrame([], events.QUEUE).drop("last_error"), queue, "2024-02-09 00:00:00")
    results = spark.createDataFrame([(REMOTE, 90, "Hosting"), (OTHER, 60, None)], "ip string, threat_score int, abuse_usage_type string")
    results = results.withColumn("threat_categories", F.lit(None).cast("array<string>"))
    none = threats(spark, []).select(*THREAT_COLUMNS)
    logs = read_logs(spark, path)
    want = content(maintenance.queue_cycle(queue, results, none, logs.drop("log_date", "batch"), NOW)["logs"])
    write_logs(maintenance.queue_cycle(queue, results, none, logs, NOW)["logs"], path, mode="overwrite")
    assert content(read_logs(spark, path)) == want
    found = {r.id: (r.threat_score, r.abuse_usage_type) for r in read_logs(spark, path).collect()}
    assert found[1] == (90, "Hosting") and found[2] == (60, None) and found[4] == (5, "Hosting") and found[3] == (None, None)


def test_chained_repairs_are_one_pass_and_rewrite_few_files(spark, tmp_path):
    path = str(tmp_path / "logs")
    stored(spark, path, [*ROWS, {"id": 9, "timestamp": "2024-02-06 10:00:00", "log_type": "firewall", "protocol": "TCP", "batch": 6}])
    rep = threats(spark, [(REMOTE, 80, "Hosting")])
    chain = [
        maintenance.score_repair(rep), maintenance.detail_repair(rep),
        # Sees the score that the first repair has filled.
        Repair(F.col("threat_score") == 80, lambda rows: rows.withColumn("direction", F.lit("scored"))),
        Repair(F.col("protocol") == "TCP", lambda rows: rows.withColumn("protocol", F.lower("protocol"))), Repair(F.col("id") == 3),
    ]
    logs = read_logs(spark, path)
    want = content(repaired(logs.drop("log_date", "batch"), chain))
    before = files(tmp_path)
    store_repairs(spark, path, chain)
    assert content(read_logs(spark, path)) == want
    found = {r.id: (r.threat_score, r.abuse_usage_type, r.direction, r.protocol) for r in read_logs(spark, path).collect()}
    assert found[1] == (80, "Hosting", "scored", None) and found[9][3] == "tcp" and 3 not in found and found[4] == (5, "Hosting", None, None)
    kept = before & files(tmp_path)
    assert {str(f).split("logs/")[1].rpartition("/")[0] for f in before - kept} == {
        "log_date=2024-02-01/log_type=firewall/batch=0", "log_date=2024-02-02/log_type=firewall/batch=2",
        "log_date=2024-02-03/log_type=firewall/batch=0", "log_date=2024-02-06/log_type=firewall/batch=6",
    }
    assert not (tmp_path / "logs/log_date=2024-02-03").exists() or not files(tmp_path / "logs/log_date=2024-02-03")


def test_change_sets_of_independent_jobs_merge_by_column(spark, tmp_path):
    path = str(tmp_path / "logs")
    stored(spark, path, ROWS)
    logs = read_logs(spark, path)
    one = changes(logs, [Repair(F.col("id") < 4, lambda r: r.withColumns({"direction": F.lit("x"), "protocol": F.lit("udp")}))])
    two = changes(logs, [Repair(F.col("id") > 2, lambda r: r.withColumn("protocol", F.lit("tcp"))), Repair(F.col("id") == 6)])
    store_changes(spark, path, merged([one, two]))
    found = {r.id: (r.direction, r.protocol) for r in read_logs(spark, path).collect()}
    assert found == {1: ("x", "udp"), 2: ("x", "udp"), 3: ("x", "tcp"), 4: (None, "tcp"), 5: (None, "tcp"), 7: (None, "tcp"), 8: (None, "tcp")}


def test_removals_empty_partitions(spark, tmp_path):
    """Partitions that lose all rows, some, or none."""
    path = str(tmp_path / "logs")
    stored(spark, path, ROWS)
    untouched = files(tmp_path / "logs/log_date=2024-02-04")
    retention.retain_stored(spark, path, "2024-02-05 10:30:00", days=3, dns_days=1)
    assert sorted(r.id for r in read_logs(spark, path).collect()) == [3, 4, 5, 6, 7, 8]
    assert files(tmp_path / "logs/log_date=2024-02-04") == untouched
    snapshot = retention.purge_snapshot(read_logs(spark, path).where("id < 8"), "system").first()
    for _ in range(2):
        retention.purge_stored(spark, path, "system", snapshot.max_id)
        assert sorted(r.id for r in read_logs(spark, path).collect()) == [3, 4, 5, 6, 8]
    assert not (tmp_path / "logs/log_date=2024-02-05/log_type=system/batch=4").exists()


def test_rows_that_change_their_date_are_stored_once(spark, tmp_path):
    """J24, over partitions of both dates."""
    path = str(tmp_path / "logs")
    stored(spark, path, [block(1, "2024-02-01 23:30:00", batch=0), block(2, "2024-02-02 01:00:00", batch=0), block(3, "2024-02-02 23:00:00", batch=2)])
    want = content(maintenance.repair_tz(read_logs(spark, path).drop("log_date", "batch"), "America/New_York"))
    store_repairs(spark, path, [Repair(F.lit(True), lambda rows: maintenance.repair_tz(rows, "America/New_York"))])
    assert content(read_logs(spark, path)) == want
    assert {(r.id, str(r.log_date)) for r in read_logs(spark, path).collect()} == {(1, "2024-02-02"), (2, "2024-02-02"), (3, "2024-02-03")}


def test_an_interrupted_replacement_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "logs")
    stored(spark, path, ROWS)
    logs = read_logs(spark, path)
    rows = laid_out(logs.where("id in (1, 2)").withColumn("direction", F.lit("new")))
    touched = logs.where("id in (1, 2, 3)").select(*PARTITIONS)
    want = [4, 5, 6, 7, 8, (1, "new"), (2, "new")]
    # It dies while the files are written: nothing has changed.
    laid_out(logs.where("id = 4")).write.partitionBy(*PARTITIONS).parquet(f"{path}/{partitions.STAGED}")
    assert read_logs(spark, path).count() == len(ROWS)
    # It dies after the first folder was moved.
    moves = []
    move = partitions.Folder.move

    def dying(self, old, new):
        if old.startswith(partitions.STAGED):
            if moves:
                raise RuntimeError("lost")
            moves.append(new)
        move(self, old, new)

    with monkeypatch.context() as m:
        m.setattr(partitions.Folder, "move", dying)
        with pytest.raises(RuntimeError):
            partitions.replace_partitions(rows, path, touched, PARTITIONS)
    for _ in range(2):
        partitions.finish(spark, path)
        got = read_logs(spark, path).collect()
        assert sorted(([r.id, (r.id, r.direction)][r.direction is not None] for r in got), key=repr) == sorted(want, key=repr)


def test_compaction_bounds_the_folders_and_knows_replays(spark, tmp_path):
    path = str(tmp_path / "logs")

    def batch(n):
        rows = [(100 * n + k, f"2024-02-0{1 + k % 2} 10:00:00", ("firewall", "system")[k % 3 == 0], n) for k in range(6)]
        return spark.createDataFrame(rows, "id long, timestamp string, log_type string, n long").withColumn("timestamp", F.col("timestamp").cast("timestamp"))

    for n in range(1, 10):
        assert write_batch(batch(n), path, n)
    every = content(read_logs(spark, path))
    compaction.compact(spark, path, before=8)
    folders = compaction.folder_sizes(spark, path)
    assert content(read_logs(spark, path)) == every
    assert folders.groupBy("log_date", "log_type").count().agg(F.max("count")).first()[0] == 3  # one merged, two recent
    assert not write_batch(batch(3), path, 3)  # a replay of what was merged
    assert write_batch(batch(9), path, 9)  # and of a recent batch
    assert content(read_logs(spark, path)) == every
    compaction.compact(spark, path, before=10)
    compaction.compact(spark, path, before=10)
    assert compaction.folder_sizes(spark, path).groupBy("log_date", "log_type").count().agg(F.max("count")).first()[0] == 1
    retention.purge_stored(spark, path, "system", 10**6)
    assert content(read_logs(spark, path)) == [r for r in every if "system" not in r]
    # Bins by length: no more than about the target, neighbours together no less.
    sizes = spark.range(50).selectExpr("date'2024-02-01' log_date", "'dns' log_type", "id batch", "1L files", "10L * (1 + id % 3) bytes")
    into = compaction.bins(sizes, 50, 100).join(sizes, "batch").groupBy("into").agg(F.sum("bytes").alias("b")).collect()
    assert all(r.b <= 130 for r in into) and len(into) <= 2 * 1000 / 100


def test_services_registered_twice_keep_rows_single(spark):
    services = spark.createDataFrame([(443, "tcp", "https", "a"), (443, "tcp", "http-alt", None), (70_000, "tcp", "x", None)], "port int, protocol string, service_name string, description string")
    logs = spark.createDataFrame([(1, 443, "tcp"), (2, 22, "tcp")], "id long, dst_port int, protocol string")
    assert sorted((r.id, r.iana_service) for r in join_service(logs, services).collect()) == [(1, "http-alt"), (2, None)]


# ---- ledger and queue -------------------------------------------------------


def test_ledger_of_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "BLOCK", 8)
    path = str(tmp_path / "ledger")
    batches = [[1, 2, 3, 9, 10], [4, 5, 20], [6, 7, 8, 11, 12, 13, 14, 15, 16, 17], [100, 102]]
    for n, ids in enumerate(batches):
        ledger.note(spark.createDataFrame([(i,) for i in ids], "record_id long"), path, n)
    ledger.note(spark.createDataFrame([(100,), (102,)], "record_id long"), path, 3)  # again
    probe = spark.range(0, 110).withColumnRenamed("id", "record_id")
    known = {i for ids in batches for i in ids}

    def new(batch):
        return {r.record_id for r in ledger.unstored(probe, ledger.read_ledger(spark, path), batch).collect()}

    assert new(9) == set(range(110)) - known
    assert new(3) == set(range(110)) - known | {100, 102}
    assert ledger.fold(spark, path, before=3, at_least=3) and not ledger.fold(spark, path, before=3, at_least=3)
    assert new(9) == set(range(110)) - known
    # 1 to 17 in a row and 20: a run per block of 8.
    folded = sorted((r.low, r.high) for r in ledger.read_ledger(spark, path).where("batch < 3").collect())
    assert folded == [(1, 7), (8, 15), (16, 17), (20, 20)]


def test_records_of_any_time_read_no_log(spark, tmp_path, monkeypatch):
    """K4: one record with a wrong clock doesn't open the whole table."""
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    answers = spark.createDataFrame([], "domain string, qtype string, answer string")

    def poll(name, records):
        lines = [json.dumps({"id": i, "time": t, "type": "A", "domain": f"h{i}.org", "status": "FORWARDED", "client": {"ip": "10.0.0.1"}}) for i, t in records]
        (src / name).write_text("\n".join(lines))
        dns.run_dns_ingest(spark, str(src), out, str(tmp_path / "cp"), answers, NOW).awaitTermination()

    poll("1.json", [(k, 1707560000.0 + k) for k in range(20)])
    monkeypatch.setattr(sinks, "read_logs", lambda *a: pytest.fail("the log was read"))
    poll("2.json", [(19, 1707560019.0), (20, 5.0), (21, 1707560021.0)])  # 1970, and an overlap
    poll("3.json", [(3, 1707560003.0), (22, 1000.0), (20, 5.0)])  # late and again
    monkeypatch.undo()
    rows = read_logs(spark, f"{out}/logs").collect()
    assert sorted(r.record_id for r in rows) == list(range(23)) and len({r.id for r in rows}) == 23
    assert ledger.read_ledger(spark, f"{out}/ledger").count() <= 6


def test_queue_events_equal_the_batch_upsert(spark, tmp_path):
    path = str(tmp_path / "queue")
    start = datetime(2024, 2, 1)
    model = {}
    for n in range(60):
        now = start + timedelta(minutes=n)
        ips = [f"45.0.0.{(n * k) % 7}" for k in range(1, 4)] * 2
        day = spark.createDataFrame([(i,) for i in ips], "ip string")
        happened = events.enqueued(day, now)
        if n % 5 == 4:  # a round of the queue: one found, one not
            found, lost = "45.0.0.1", "45.0.0.2"
            happened = events.succeeded(spark.createDataFrame([(found,)], "ip string"), now).unionByName(
                events.failed(spark.createDataFrame([(lost,), ("9.9.9.9",)], "ip string"), "lookup_failed", now)
            ).unionByName(happened)
            model.pop(found, None)
            if lost in model:
                source, first, last, retry, attempts, _ = model[lost]
                model[lost] = (source, first, last, None, attempts + 1, "lookup_failed")
                model[lost] = (source, first, last, spark.range(1).select(maintenance.next_retry(F.lit(now), F.lit(attempts))).first()[0], attempts + 1, "lookup_failed")
        for ip in set(ips):
            source, first, _, retry, attempts, error = model.get(ip, ("live_miss", now, now, now, 0, None))
            model[ip] = (source, first, now, max(retry, now), attempts, error)
        for _ in range(1 + (n % 20 == 0)):  # some batches run twice
            events.append(happened, path, n)
        events.fold(spark, path, n, at_least=16)
        assert len(list((tmp_path / "queue").glob("batch=*"))) <= 18
    got = {r.ip: tuple(r)[1:] for r in events.read_queue(spark, path).collect()}
    assert got == model
    # The same by the upsert of the batch job.
    before = events.read_queue(spark, path)
    again = maintenance.enqueue(before, spark.createDataFrame([("45.0.0.3",), ("8.8.8.8",)], "ip string"), "2024-02-20 00:00:00")
    events.append(events.enqueued(spark.createDataFrame([("45.0.0.3",), ("8.8.8.8",)], "ip string"), "2024-02-20 00:00:00"), path, 60)
    names = sorted(before.columns)
    assert sorted(map(tuple, again.select(*names).collect()), key=repr) == sorted(map(tuple, events.read_queue(spark, path).select(*names).collect()), key=repr)
