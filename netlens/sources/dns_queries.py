"""DNS-resolver query records: incremental reading and mapping to log rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.config import DNS_FAILED_REPLIES, DNS_RESOLVABLE_TYPES, DNS_STATUS_ACTIONS
from netlens.functions.ip import is_reserved_ip
from netlens.functions.scalars import ts_lit
from netlens.schema import DNS_RECORD_SCHEMA

FIRST_RUN_MINUTES = 5


def read_dns_records(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON records, one per line, with their text as ``raw_log``."""
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path).withColumnRenamed("value", "raw_log")
    return lines.select(F.from_json("raw_log", DNS_RECORD_SCHEMA).alias("r"), "raw_log").select("r.*", "raw_log")


def new_records(records: DataFrame, cursor: int, now: str | datetime) -> DataFrame:
    """Records beyond the cursor, each id once; the first run (cursor 0) looks
    back five minutes only."""
    rows = records
    if cursor == 0:
        start = ts_lit(now).cast("double") - FIRST_RUN_MINUTES * 60
        rows = rows.where(F.col("time") >= F.floor(start))
    return rows.where(F.col("id") > cursor).dropDuplicates(["id"])


def next_cursor(new: DataFrame, cursor: int) -> DataFrame:
    return new.agg(F.coalesce(F.max("id"), F.lit(cursor)).cast("bigint").alias("cursor"))


def read_dns_queries(spark: SparkSession, path: str, cursor: int, now: str | datetime) -> DataFrame:
    return new_records(read_dns_records(spark, path), cursor, now)


def _upper(column: Column | str) -> Column:
    return F.upper(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))


def status_action(status: Column | str) -> Column:
    blocked = [s for s, a in DNS_STATUS_ACTIONS.items() if a == "block"]
    return F.when(_upper(status).isin(blocked), "block").otherwise("allow")


def resolvable() -> Column:
    """Not blocked, an address query, and a reply that names an answer."""
    return (
        (status_action("status") != "block")
        & _upper("type").isin(*DNS_RESOLVABLE_TYPES)
        & ~_upper(F.col("reply.type")).isin(*DNS_FAILED_REPLIES)
    )


def dns_resolution_candidates(records: DataFrame) -> DataFrame:
    """Work list of (domain, qtype) to resolve."""
    rows = records.where(resolvable() & (F.coalesce("domain", F.lit("")) != ""))
    return rows.select("domain", _upper("type").alias("qtype")).distinct()


def map_dns_query(records: DataFrame, answers: DataFrame, now: str | datetime | Column) -> DataFrame:
    """Log rows of the records. ``answers`` (domain, qtype, answer) are the
    resolved names; only a public answer becomes the target address."""
    now = now if isinstance(now, Column) else ts_lit(now)
    found = answers.groupBy("domain", "qtype").agg(F.max("answer").alias("_answer"))
    rows = (
        records.withColumn("_domain", F.coalesce("domain", F.lit("")))
        .withColumn("_qtype", F.when(resolvable(), _upper("type")))
        .join(
            found.select(F.col("domain").alias("_d"), F.col("qtype").alias("_q"), "_answer"),
            (F.col("_domain") == F.col("_d")) & (F.col("_qtype") == F.col("_q")),
            "left",
        )
    )
    public = F.when(~is_reserved_ip("_answer"), F.col("_answer"))
    raw = F.col("raw_log") if "raw_log" in records.columns else F.to_json(F.struct(*records.columns))
    return rows.select(
        "id",
        F.coalesce(F.expr("try_cast(timestamp_micros(cast(round(time * 1000000) as bigint)) as timestamp)"), now).alias("timestamp"),
        F.lit("dns").alias("log_type"),
        F.nullif(F.coalesce("client.ip", F.lit("")), F.lit("")).alias("src_ip"),
        public.alias("dst_ip"),
        F.lit(53).alias("dst_port"),
        F.lit("UDP").alias("protocol"),
        _upper("status").alias("rule_desc"),
        status_action("status").alias("rule_action"),
        F.nullif("_domain", F.lit("")).alias("dns_query"),
        F.nullif(_upper("type"), F.lit("")).alias("dns_type"),
        F.col("_answer").alias("dns_answer"),
        F.nullif(F.col("client.name"), F.lit("")).alias("src_device_name"),
        public.alias("remote_ip"),
        F.lit("dns_resolver").alias("source"),
        raw.alias("raw_log"),
    )
