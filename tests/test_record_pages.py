"""The record source with an id cursor: batch, stream, restart, first run."""

import json

import pytest
from pyspark.sql import functions as F

from netlens.sources.dns_queries import new_records, read_dns_records
from netlens.sources.record_pages import Page, ranges, read_record_pages
from netlens.sources.sinks import read_logs
from netlens.streaming import dns

NOW = "2024-02-10 12:00:00"
T = 1707566400.0  # NOW in seconds


def _page(folder, rows, extra=()):
    ids = [i for i, _ in rows]
    lines = [json.dumps({"id": i, "time": t, "type": "A", "domain": f"h{i}.org", "status": "FORWARDED", "client": {"ip": "10.0.0.1"}}) for i, t in rows]
    (folder / f"{min(ids)}-{max(ids)}.json").write_text("\n".join([*lines, *extra]) + "\n")


def _ids(df):
    return sorted(r.id for r in df.where("id is not null").collect())


def test_ranges_follow_the_ids():
    pages = [Page(1, 100, "a"), Page(101, 200, "b"), Page(201, 300, "c"), Page(301, 400, "d")]
    assert [[p.path for p in r.pages] for r in ranges(pages, 0, 400, None, 150)] == [["a", "b"], ["c", "d"]]
    assert [[p.path for p in r.pages] for r in ranges(pages, 150, 250, None, 10)] == [["b"], ["c"]]
    assert ranges(pages, 400, 400, None, 10) == []


@pytest.mark.parametrize("cursor", [0, 1, 4, 7, 99])
def test_batch_equals_the_file_reader(spark, tmp_path, cursor):
    _page(tmp_path, [(1, T - 900), (2, T - 300.5), (3, T - 300)], ["no json"])
    _page(tmp_path, [(4, T - 20), (6, T - 10)])
    _page(tmp_path, [(7, T - 5)])
    found = read_record_pages(spark, str(tmp_path), NOW, cursor, ids_per_task=2)
    assert _ids(found) == _ids(new_records(read_dns_records(spark, str(tmp_path)), cursor, NOW))
    # Text that is no record comes with its page's first reading only.
    assert [r.raw_log for r in found.where("id is null").collect()] == (["no json"] if cursor == 0 else [])


def test_empty_folder_and_cursor_beyond_all(spark, tmp_path):
    assert read_record_pages(spark, str(tmp_path), NOW, 0).count() == 0
    assert read_record_pages(spark, f"{tmp_path}/none", NOW, 5).count() == 0


def test_pages_below_the_cursor_are_not_opened(spark, tmp_path):
    _page(tmp_path, [(4, T - 20)])
    (tmp_path / "1-3.json").mkdir()  # can't be read as a file
    assert _ids(read_record_pages(spark, str(tmp_path), NOW, 3)) == [4]


def test_stream_stops_and_goes_on_at_the_cursor(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    answers = spark.createDataFrame([], "domain string, qtype string, answer string")

    def run():
        dns.run_dns_ingest(spark, str(src), out, str(tmp_path / "cp"), answers, NOW, pages=True).awaitTermination()
        return sorted(r.record_id for r in read_logs(spark, f"{out}/logs").collect())

    # The first run looks back five minutes.
    _page(src, [(1, T - 900), (2, T - 800)])
    _page(src, [(3, T - 400), (4, T - 200)], ["no json"])
    assert run() == [4]
    assert run() == [4]
    # Later runs take everything beyond the cursor, whatever its time, and nothing below.
    _page(src, [(5, T - 9000), (6, T + 60)])
    _page(src, [(4, T - 200), (7, T + 70)])  # an overlapping poll
    (src / "1-2.json").unlink()
    (src / "1-2.json").mkdir()
    assert run() == [4, 5, 6, 7]
    bad = spark.read.parquet(f"{out}/quarantine").where(F.col("reason") == "json")
    assert [r.raw_log for r in bad.collect()] == ["no json"]
