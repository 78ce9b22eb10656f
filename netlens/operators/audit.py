"""Audit trail: listing, merge of older entries and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions.scalars import audit_fields, ts_lit
from netlens.operators.topk import newest

Now = str | datetime


def join_token(audit: DataFrame, tokens: DataFrame) -> DataFrame:
    names = tokens.select(F.col("id").alias("_token"), F.col("name").alias("token_name"), "token_prefix")
    return audit.join(names, F.col("token_id") == F.col("_token"), "left").drop("_token")


def audit_page(audit: DataFrame, tokens: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """API calls, newest first; token names are joined to the page only."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be between 1 and 1000 and offset not negative")
    order = [F.desc("created_at"), F.desc("id")]
    page = newest(audit.where(F.col("action") == "api_call"), limit, *order, ts="created_at", skip=offset)
    fields = page.withColumn("_f", audit_fields("detail"))
    return join_token(fields, tokens).select(
        "id", "token_id", "token_name", "token_prefix", "created_at", "_f.*"
    ).orderBy(*order)


def audit_total(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("action") == "api_call").agg(F.count(F.lit(1)).alias("total"))


def merge_audit(audit: DataFrame, incoming: DataFrame) -> DataFrame:
    """Audit rows plus the incoming calls not yet there by (created_at, token);
    a missing token equals a missing token."""
    known = audit.select(F.col("created_at").alias("_at"), F.col("token_id").alias("_token")).distinct()
    fresh = incoming.join(
        known, (F.col("created_at") == F.col("_at")) & F.col("token_id").eqNullSafe(F.col("_token")), "left_anti"
    )
    detail = F.to_json(F.struct("tool_name", "scope", "success", "error", "params"), {"ignoreNullFields": "false"})
    rows = fresh.select("token_id", F.lit("api_call").alias("action"), detail.alias("detail"), "created_at")
    return audit.select("token_id", "action", "detail", "created_at").unionByName(rows)


def retain_audit(audit: DataFrame, now: Now, days: int = 90) -> DataFrame:
    return audit.where(F.col("created_at") >= ts_lit(now) - F.expr(f"INTERVAL {int(days)} DAYS"))
