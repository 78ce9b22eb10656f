"""Kept counts against the direct queries, after every kind of change of the stored table."""

import pytest
from pyspark.sql import functions as F

from netlens.operators import search, stats
from netlens.operators.filters import TimeWindow
from netlens.plans import compaction, figures, retention
from netlens.plans.changes import Repair, store_repairs
from netlens.schema import ddl
from netlens.sources import partitions
from netlens.sources.sinks import read_logs, write_batch

NOW = "2024-02-10 12:20:00"
COLUMNS = {"id": "long", "timestamp": "string", "log_type": "string", "rule_action": "string", "direction": "string", "threat_score": "int"}
WINDOWS = (TimeWindow("24h"), TimeWindow(start="2024-02-08T10:00:00Z", end="2024-02-10T11:10:00Z"),
           TimeWindow(start="2024-02-10T11:05:00Z", end="2024-02-10T11:10:00Z"))


def batch(spark, path, number, rows):
    table = spark.createDataFrame([tuple(r) for r in rows], ddl(COLUMNS))
    return write_batch(table.withColumn("timestamp", F.col("timestamp").cast("timestamp")), path, number)


def some(number):
    i = 100 * number
    return [
        (i, "2024-02-10 11:05:00", "firewall", "block", "inbound", 80), (i + 1, "2024-02-10 11:07:30", "firewall", "allow", "outbound", 3),
        (i + 2, "2024-02-09 12:19:59", "firewall", "redirect", None, None), (i + 3, "2024-02-09 12:20:00", "dns", "block", None, None),
        (i + 4, "2024-02-08 09:59:59", "dns", "allow", None, 51), (i + 5, "2024-02-08 10:00:00", "wifi", None, None, None),
        (i + 6, "2024-02-10 11:10:00", "system", None, None, None), (i + 7, None, "system", None, None, None),
        (i + 8, "1970-01-01 00:00:00", "firewall", None, "inbound", None), (i + 9, "2023-11-01 00:00:00", "wifi", None, None, None),
    ]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def agrees(spark, path, windows=WINDOWS[:1]):
    logs, kept = read_logs(spark, path), figures.read_figures(spark, path)
    assert rows(figures.health(kept)) == rows(search.health(logs))
    assert rows(figures.counts_for_types(kept)) == rows(search.counts_for_types(logs))
    for window in windows:
        counts = figures.in_window(spark, path, window, NOW).persist()
        assert rows(figures.overview(counts)) == rows(stats.overview(logs, window, NOW)), window
        assert rows(figures.by_type(counts)) == rows(stats.by_type(logs, window, NOW))
        assert rows(figures.by_direction(counts)) == rows(stats.by_direction(logs, window, NOW))
        assert rows(figures.over_time(counts, window)) == rows(stats.over_time(logs, window, NOW))
        assert rows(figures.action_over_time(counts, window)) == rows(stats.action_over_time(logs, window, NOW))
        counts.unpersist()


def test_counts_follow_every_change(spark, tmp_path):
    path = str(tmp_path / "logs")
    batch(spark, path, 0, some(0))
    figures.enable(spark, path)
    # Ingest, and a batch that runs again.
    batch(spark, path, 2, some(2))
    batch(spark, path, 4, some(4))
    batch(spark, path, 4, some(4))
    assert figures.refresh(spark, path) == 3
    agrees(spark, path)
    assert figures.refresh(spark, path) == 0
    # A repair that rescores, one that moves a row to another date, a purge and retention.
    store_repairs(spark, path, [Repair(F.col("threat_score") == 80, lambda d: d.withColumn("threat_score", F.lit(1)))])
    store_repairs(spark, path, [Repair(F.col("id") == 204, lambda d: d.withColumn("timestamp", F.lit("2024-02-07 01:00:00").cast("timestamp")))])
    figures.refresh(spark, path)
    agrees(spark, path)
    retention.purge_stored(spark, path, "wifi", 150)
    retention.retain_stored(spark, path, NOW)
    compaction.compact(spark, path, 3)
    figures.refresh(spark, path)
    agrees(spark, path, (TimeWindow("7d"), *WINDOWS))
    assert rows(read_logs(spark, path).where("log_type = 'wifi'").select("id")) == [(205,), (405,)]


def test_health_reads_no_log(spark, tmp_path):
    path = str(tmp_path / "logs")
    batch(spark, path, 0, some(0))
    figures.enable(spark, path)
    read = figures.health(figures.read_figures(spark, path)).inputFiles()
    assert read and all("/logs_figures/" in f for f in read)


def test_an_interrupted_refresh_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "logs")
    batch(spark, path, 0, some(0))
    figures.enable(spark, path)
    batch(spark, path, 2, some(2))
    with monkeypatch.context() as m:
        m.setattr(partitions, "finish", lambda *_: (_ for _ in ()).throw(RuntimeError("executor lost")))
        with pytest.raises(RuntimeError):
            figures.refresh(spark, path)
    assert figures.refresh(spark, path) == 1
    agrees(spark, path)


def test_a_table_without_counts_takes_no_notes(spark, tmp_path):
    path = str(tmp_path / "logs")
    batch(spark, path, 0, some(0))
    assert not (tmp_path / "logs" / partitions.CHANGED).exists()
    assert figures.refresh(spark, path) == 0 and figures.read_figures(spark, path).count() == 0
