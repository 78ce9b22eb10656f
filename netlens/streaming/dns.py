"""Continuous ingest of DNS-resolver records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netlens.config import NetConfig
from netlens.operators.enrich import EnrichmentTables, enrich
from netlens.sources.dns_queries import map_dns_query, read_dns_records
from netlens.sources.record_pages import read_record_pages
from netlens.sources.sinks import write_batch
from netlens.streaming import ledger
from netlens.streaming.ingest import FLUSH, RECORDS, numbered, table_batch, write_quarantine


def once_each(records: DataFrame) -> DataFrame:
    """Each record id once: of several rows the first by position."""
    rest = [c for c in records.columns if c != "record_id"]
    first = F.min_by(F.struct(*rest), F.col("id")).alias("_r")
    return records.groupBy("record_id").agg(first).select("record_id", "_r.*")


def store_records(
    records: DataFrame, batch: int, out: str, answers: DataFrame, now: str | datetime,
    cfg: NetConfig = NetConfig(), tables: EnrichmentTables | None = None,
) -> None:
    """Store one batch of records in the log table: new ids only, enriched as the site
    wants it. Text that is no record goes to the quarantine."""
    own = table_batch(batch, RECORDS)
    given = numbered(records.withColumnRenamed("id", "record_id"), own).persist()
    try:
        known = once_each(given.where(F.col("record_id").isNotNull()))
        mapped = map_dns_query(known.withColumnsRenamed({"id": "_row", "record_id": "id"}), answers, now)
        ids = known.select(F.col("record_id").alias("_record"), F.col("id").alias("_row"))
        rows = mapped.withColumnRenamed("id", "record_id").join(ids, F.col("record_id") == F.col("_record")).drop("_record")
        rows = rows.withColumnRenamed("_row", "id").persist()
        try:
            # Polls overlap and a resolver may deliver late: an id counts, not a time.
            stored = ledger.read_ledger(records.sparkSession, f"{out}/ledger")
            fresh = ledger.unstored(rows, stored, own)
            if write_batch(enrich(fresh, tables, cfg, now) if tables is not None else fresh, f"{out}/logs", own):
                ledger.note(fresh, f"{out}/ledger", own)
                ledger.fold(records.sparkSession, f"{out}/ledger", own)
        finally:
            rows.unpersist()
        write_quarantine(given.where(F.col("record_id").isNull()).select("raw_log", F.lit("json").alias("reason")), out, own)
    finally:
        given.unpersist()


def run_dns_ingest(
    spark: SparkSession, src: str, out: str, checkpoint: str, answers: DataFrame, now: str | datetime,
    once: bool = True, cfg: NetConfig = NetConfig(), tables: EnrichmentTables | None = None, pages: bool = False,
) -> StreamingQuery:
    """Records -> log rows. The checkpoint holds the position, and a batch that runs
    again replaces its own rows, so rows and position never part. ``src`` holds files in
    any order, or with ``pages`` pages named by ids, which are read beyond the cursor."""

    def store(records: DataFrame, batch: int) -> None:
        store_records(records, batch, out, answers, now, cfg, tables)

    records = read_record_pages(spark, src, now) if pages else read_dns_records(spark, src, stream=True)
    writer = records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=FLUSH)).start()


start_dns_ingest = run_dns_ingest
