"""Continuous ingest: lines -> parsed, enriched log rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netlens.config import NetConfig
from netlens.operators.enrich import EnrichmentTables, enrich
from netlens.plans.parse import (
    derive,
    derive_learning,
    drop_disabled,
    good_rows,
    parse_lines,
    quarantine,
    with_service,
)
from netlens.sources.sinks import read_logs, write_batch
from netlens.sources.syslog import read_syslog
from netlens.streaming import queue as events

# Every batch makes files in each partition it touches: few large ones are better.
FLUSH = "30 seconds"
# Writers of the log table. Batch numbers of the table tell them apart.
LINES, RECORDS = 0, 1
_PARTITION_BITS, _ROW_BITS = 14, 26


def table_batch(batch: int, writer: int) -> int:
    return 2 * batch + writer


def numbered(rows: DataFrame, batch: int) -> DataFrame:
    """Adds ``id``: unique, and growing from batch to batch; within a batch by input
    partition and position. A batch that runs again reads the same files and gives the
    same ids, if nothing has shuffled the rows before."""
    position = F.monotonically_increasing_id()
    part, row = F.shiftright(position, 33), position.bitwiseAND(F.lit((1 << 33) - 1))
    fits = (part < (1 << _PARTITION_BITS)) & (row < (1 << _ROW_BITS))
    place = F.shiftleft(part, _ROW_BITS) + row
    too_many = F.raise_error(F.lit("a batch has too many partitions or rows for its ids")).cast("bigint")
    return rows.withColumn("id", F.lit(batch << (_PARTITION_BITS + _ROW_BITS)).cast("bigint") + F.when(fits, place).otherwise(too_many))


def counters(off: Iterable[str] = ()) -> list[Column]:
    """received, parsed, filtered, failed (no header) and dropped (not storable)."""
    off = list(off) or [""]
    error = F.col("parse_error")
    return [
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.coalesce(error != "header", F.lit(True))).alias("parsed"),
        F.count_if(error.isNull() & F.col("log_type").isin(off)).alias("filtered"),
        F.count_if(error == "header").alias("failed"),
        F.count_if(error.isin("timestamp", "size")).alias("dropped"),
    ]


def with_ingest_metrics(parsed: DataFrame, off: Iterable[str] = (), name: str | Observation = "ingest") -> DataFrame:
    """Counters observed while the rows pass."""
    return parsed.observe(name, *counters(off))


def write_quarantine(rows: DataFrame, out: str, batch: int) -> None:
    # A batch owns its directory: running it again replaces its own rows only.
    rows.write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch}")


def store_batch(
    lines: DataFrame, batch: int, out: str, cfg: NetConfig, now: str | datetime, tables: EnrichmentTables,
    services: DataFrame | None = None, disabled: Iterable[str] = (), queue: str | None = None,
) -> dict[str, int]:
    """Parse, filter, enrich and store one batch: ``logs``, ``quarantine`` and,
    if asked for, the retry queue with the addresses that had no reputation. Returns
    the counters.

    While the site's own WAN addresses are not configured, they are learned from the
    batch first.
    """
    own = table_batch(batch, LINES)
    parsed = parse_lines(numbered(lines, own), cfg, now).persist()
    try:
        rows = drop_disabled(good_rows(parsed), disabled)
        rows = derive(rows, cfg) if cfg.wan_ips else derive_learning(rows, cfg)
        rows = with_service(rows, services) if services is not None else rows
        write_batch(enrich(rows, tables, cfg, now), f"{out}/logs", own)
        write_quarantine(quarantine(parsed), out, own)
        if queue is not None and tables.threats is not None:
            stored = read_logs(lines.sparkSession, f"{out}/logs").where(F.col("batch") == own)
            enqueue_misses(stored, batch, queue, now)
        return parsed.agg(*counters(disabled)).first().asDict()
    finally:
        parsed.unpersist()


def enqueue_misses(rows: DataFrame, batch: int, queue: str, now: str | datetime) -> None:
    """Events of the retry queue from stored rows: blocks whose address found no reputation.
    A repeated batch replaces its own events; those of batches that can't run again are
    folded into the state of the queue."""
    blocked = (F.col("log_type") == "firewall") & (F.col("rule_action") == "block")
    missing = blocked & F.col("remote_ip").isNotNull() & F.col("threat_score").isNull()
    events.append(events.enqueued(rows.where(missing).select(F.col("remote_ip").alias("ip")), now), queue, batch)
    events.fold(rows.sparkSession, queue, batch)


def start_ingest(
    spark: SparkSession, src: str, out: str, checkpoint: str, tables: EnrichmentTables | None = None,
    cfg: NetConfig = NetConfig(), services: DataFrame | None = None, disabled: Iterable[str] = (),
    queue: str | None = None, now: str | datetime | None = None, once: bool = False,
    on_batch: Callable[[int, dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """Run the ingest as a stream over the text files in ``src``.

    ``now`` fixes the processing time for replays. ``once`` takes what is there
    and stops. Rows are accepted at any age: there is no watermark here. ``on_batch``
    gets the number of each batch stored and its counters.
    """
    tables = tables or EnrichmentTables()
    disabled = tuple(disabled)

    def store(lines: DataFrame, batch: int) -> None:
        moment = now or datetime.now(timezone.utc).replace(tzinfo=None)
        counted = store_batch(lines, batch, out, cfg, moment, tables, services, disabled, queue)
        if on_batch is not None:
            on_batch(batch, counted)

    writer = read_syslog(spark, src, stream=True).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=FLUSH)).start()
