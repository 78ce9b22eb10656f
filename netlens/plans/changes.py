"""Repairs that compose: several jobs in one pass, written back as one change.

A repair is a condition and a correction. Only rows that meet the condition of some
repair go through the corrections, in order, each of which sees what the one before has
made of a row. Rows that differ afterwards are the change set: their old partition, their
new values, or that they go. Change sets of independent jobs are merged by id, column by
column. The stored table is then read and written in the touched partitions only, and a
partition that is left without rows is emptied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.sources.partitions import replace_partitions
from netlens.sources.sinks import PARTITIONS, ROWS_PER_FILE, laid_out, read_logs


@dataclass(frozen=True)
class Repair:
    """``apply`` gives every row back once, with new values; those of rows that don't meet
    ``candidate`` are ignored. A repair without ``apply`` removes its candidates."""

    candidate: Column
    apply: Callable[[DataFrame], DataFrame] | None = None


def _test(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_candidate(repairs: Iterable[Repair]) -> Column:
    return reduce(Column.__or__, [_test(r.candidate) for r in repairs])


def _worked(logs: DataFrame, repairs: list[Repair]) -> DataFrame:
    """Candidates after all repairs: ``_before``, ``_deleted`` and the columns as they are now."""
    columns = logs.columns
    work = logs.where(is_candidate(repairs)).withColumns({"_before": F.struct(*columns), "_deleted": F.lit(False)})
    for repair in repairs:
        hit = _test(repair.candidate) & ~F.col("_deleted")
        if repair.apply is None:
            work = work.withColumn("_deleted", F.col("_deleted") | hit)
            continue
        # The condition is about the row as it is before this repair.
        work = repair.apply(work.withColumns({"_hit": hit, "_old": F.struct(*columns)}))
        kept = [F.when(F.col("_hit"), F.col(c)).otherwise(F.col(f"_old.{c}")).alias(c) for c in columns]
        work = work.select(*kept, "_before", "_deleted")
    return work


def _differs(columns: Iterable[str]) -> Column:
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_before.{c}")) for c in columns])
    return F.col("_deleted") | ~same


def changes(logs: DataFrame, repairs: list[Repair]) -> DataFrame:
    """(id, _deleted, _before, _after) of the rows that the repairs change."""
    columns = logs.columns
    return _worked(logs, repairs).where(_differs(columns)).select("id", "_deleted", "_before", F.struct(*columns).alias("_after"))


def merged(sets: list[DataFrame]) -> DataFrame:
    """One change per id of change sets that were made from the same rows. Of several that
    set a column the last one wins; a row that one of them removes goes."""
    every = reduce(DataFrame.unionByName, [s.withColumn("_order", F.lit(k)) for k, s in enumerate(sets)])
    columns = every.schema["_after"].dataType.names
    # An id has as many entries as there are sets, at most.
    items = F.array_sort(F.collect_list(F.struct("_order", "_deleted", "_before", "_after")))
    one = every.groupBy("id").agg(items.alias("_items"))

    def last(c: str) -> Column:
        def newer(acc: Column, item: Column) -> Column:
            return F.when(item["_after"][c].eqNullSafe(item["_before"][c]), acc).otherwise(item["_after"][c])

        return F.aggregate("_items", F.element_at("_items", 1)["_before"][c], newer).alias(c)

    return one.select(
        "id", F.exists("_items", lambda i: i["_deleted"]).alias("_deleted"), F.element_at("_items", 1)["_before"].alias("_before"),
        F.struct(*[last(c) for c in columns]).alias("_after"),
    )


def _partitions(rows: DataFrame, prefix: str = "") -> DataFrame:
    return rows.select(*[F.col(f"{prefix}{c}").alias(c) for c in PARTITIONS]).distinct()


def _only(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of some partitions. The list is short and meets partition columns, so the scan
    is pruned at run time."""
    names = touched.select(*[F.col(c).alias(f"_{c}") for c in PARTITIONS])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PARTITIONS])
    return rows.join(names, same, "left_semi")


def repaired(logs: DataFrame, repairs: list[Repair]) -> DataFrame:
    """The log after all repairs. Of the stored table only the partitions are given that
    hold a changed row, complete; use ``store_repairs`` to write them back, since one that
    loses all its rows doesn't occur here."""
    work = _worked(logs, repairs)
    rest = logs.where(~is_candidate(repairs))
    fixed = work.where(~F.col("_deleted"))
    if set(PARTITIONS) <= set(logs.columns):
        touched = _partitions(work.where(_differs(logs.columns)), "_before.")
        rest = _only(rest, touched)
        before = fixed.select(*logs.columns, *[F.col(f"_before.{c}").alias(f"_was_{c}") for c in PARTITIONS])
        names = touched.select(*[F.col(c).alias(f"_{c}") for c in PARTITIONS])
        same = reduce(Column.__and__, [F.col(f"_was_{c}").eqNullSafe(F.col(f"_{c}")) for c in PARTITIONS])
        fixed = before.join(names, same, "left_semi")
    return rest.unionByName(fixed.select(*logs.columns))


def store_changes(spark: SparkSession, path: str, changed: DataFrame) -> None:
    """Write a change set into the log table: reads and replaces the partitions its rows were
    in or come to, empties those left without rows. A job that is run again after a
    failure finds the table as it was or as it is to be."""
    changed = changed.persist()
    try:
        logs = read_logs(spark, path)
        after = changed.where(~F.col("_deleted")).select("_after.*").withColumn("log_date", F.to_date("timestamp"))
        touched = _partitions(changed, "_before.").unionByName(_partitions(after)).distinct().persist()
        kept = _only(logs, touched).join(changed.select("id"), "id", "left_anti")
        rows = laid_out(kept.unionByName(after.select(*logs.columns)))
        replace_partitions(rows, path, touched, PARTITIONS, ROWS_PER_FILE)
        touched.unpersist()
    finally:
        changed.unpersist()


def store_repairs(spark: SparkSession, path: str, repairs: list[Repair]) -> None:
    """Run repairs on the stored table, in order."""
    store_changes(spark, path, changes(read_logs(spark, path), repairs))
