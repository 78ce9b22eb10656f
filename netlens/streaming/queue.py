"""The retry queue as events.

A batch appends what happened to addresses (enqueued, looked up, failed), never the queue
itself. The queue is the fold of the events in order. Old events are folded into rows of
state now and then, so files stay few.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions.scalars import next_retry, ts_lit
from netlens.sources.partitions import Folder, finish, replace_partitions

Now = str | datetime
# In this order within one batch: a success or failure answers a try, then misses come.
STATE, SUCCESS, FAILURE, ENQUEUE = 0, 1, 2, 3
QUEUE = (
    "ip string, source string, first_seen_at timestamp, last_seen_at timestamp, next_retry_at timestamp,"
    " attempts int, last_error string"
)
EVENTS = f"{QUEUE}, kind int, batch bigint"
STATE_STRUCT = f"struct<{', '.join(c.strip().replace(' ', ':', 1) for c in QUEUE.split(',')[1:])}>"
OWN_EVENTS = 64


def _event(rows: DataFrame, kind: int, now: Now, source: str | None = None, error: str | None = None) -> DataFrame:
    at = ts_lit(now)
    # An address is one event per batch, however often it was seen.
    return rows.select("ip").where(F.col("ip").isNotNull()).distinct().select(
        "ip", F.lit(source).cast("string").alias("source"), at.alias("first_seen_at"), at.alias("last_seen_at"),
        at.alias("next_retry_at"), F.lit(0).alias("attempts"), F.lit(error).cast("string").alias("last_error"), F.lit(kind).alias("kind"),
    )


def enqueued(ips: DataFrame, now: Now, source: str = "live_miss") -> DataFrame:
    return _event(ips, ENQUEUE, now, source)


def succeeded(ips: DataFrame, now: Now) -> DataFrame:
    return _event(ips, SUCCESS, now)


def failed(ips: DataFrame, error: str, now: Now) -> DataFrame:
    return _event(ips, FAILURE, now, error=error)


def append(events: DataFrame, path: str, batch: int) -> None:
    """Store the events of a batch; the same batch again replaces its own."""
    finish(events.sparkSession, path)
    rows = events.withColumn("batch", F.lit(batch).cast("bigint"))
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(EVENTS).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EVENTS)


def state_of(events: DataFrame) -> DataFrame:
    """The queue after all events: per address an ordered fold.

    Enqueue adds an address, or sees it again and keeps a later retry; a failure counts
    an attempt and pushes the next one back; a success takes it out. Events of addresses
    that aren't queued change nothing. An address has one event per batch and kind, and
    ``fold`` keeps the number of batches small, so no list grows without bound.
    """
    fields = [c.split()[0] for c in QUEUE.split(",")][1:]
    event = F.struct("batch", "kind", *fields)
    lists = events.groupBy("ip").agg(F.array_sort(F.collect_list(event)).alias("events"))

    def state(**values: Column) -> Column:
        return F.struct(*[values[f].alias(f) for f in fields]).cast(STATE_STRUCT)

    def step(queued: Column, e: Column) -> Column:
        known = {f: queued[f] for f in fields}
        fresh = {f: e[f] for f in fields}
        again = known | {"last_seen_at": e["last_seen_at"], "next_retry_at": F.greatest(queued["next_retry_at"], e["next_retry_at"])}
        later = known | {
            "next_retry_at": next_retry(e["last_seen_at"], queued["attempts"]), "attempts": queued["attempts"] + 1, "last_error": e["last_error"],
        }
        none = F.lit(None).cast(STATE_STRUCT)
        return (
            F.when(e["kind"] == STATE, state(**fresh))
            .when(e["kind"] == ENQUEUE, F.when(queued.isNull(), state(**fresh)).otherwise(state(**again)))
            .when(queued.isNull() | (e["kind"] == SUCCESS), none)
            .otherwise(state(**later))
        )

    folded = lists.select("ip", F.aggregate("events", F.lit(None).cast(STATE_STRUCT), step).alias("s"))
    return folded.where("s is not null").select("ip", "s.*")


def read_queue(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The queue now, or before a batch."""
    events = read_events(spark, path)
    return state_of(events if before is None else events.where(F.col("batch") < before))


def fold(spark: SparkSession, path: str, before: int, at_least: int = OWN_EVENTS) -> bool:
    """Turn the events of batches below ``before`` into rows of state, under the number of the
    last of them, once ``at_least`` batches have events. Batches from ``before`` on, which
    may run again, keep theirs."""
    folder = Folder(spark, path)
    names = folder.leaves("", 1) if folder.exists("") else []
    old = sorted(b for b in (int(n.partition("=")[2]) for n in names) if b < before)
    if len(old) < at_least:
        return False
    rows = read_queue(spark, path, before).withColumns({"kind": F.lit(STATE), "batch": F.lit(old[-1]).cast("bigint")})
    touched = spark.createDataFrame([(b,) for b in old], "batch bigint")  # a number per folder
    replace_partitions(rows.coalesce(1), path, touched, ("batch",))
    return True
