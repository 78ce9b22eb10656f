"""Ordered limits, latest-per-key and modal values that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """``ORDER BY ... LIMIT k``: every task keeps its own k rows first."""
    return df.orderBy(*order).limit(k)


def count_top(df: DataFrame, keys: list[str], k: int, *extra: Column) -> DataFrame:
    """Groups with the most rows; ties in key order."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), *extra)
    return top_k(counted, k, F.desc("count"), *[F.asc_nulls_last(c) for c in keys])


def with_texts(df: DataFrame, keys: list[str], texts: list[str], **figures: tuple[Column, str]) -> DataFrame:
    """Groups with figures, each an aggregate and how its parts merge (``sum`` or ``max``),
    and the greatest of some columns of text.

    ``max`` over text makes Spark sort its input. So rows are hashed by key and texts first,
    and only these few groups, one per combination that occurs, are sorted.
    """
    merge = {"sum": F.sum, "max": F.max}
    inner = df.groupBy(*keys, *texts).agg(*[part.alias(name) for name, (part, _) in figures.items()])
    merged = [merge[how](name).alias(name) for name, (_, how) in figures.items()]
    return inner.groupBy(*keys).agg(*merged, *[F.max(t).alias(t) for t in texts])


def newest(df: DataFrame, k: int, *order: Column, ts: str = "timestamp", skip: int = 0) -> DataFrame:
    """``k`` rows after the ``skip`` newest ones, in the given order, whose first column
    must be descending ``ts``. Rows without a time come last.

    Rows are wide and few of them are wanted, so a first scan of ``ts`` and the filter
    columns counts rows per minute, which tells the minutes the page lies in, and only
    files and row groups of those are read in full. No task sees more than the rows of
    these minutes, however large ``k`` and ``skip`` are.
    """
    minutes = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc("minute", F.col(ts)).alias("minute"))
    counts = minutes.agg(F.count(F.lit(1)).alias("n"))
    # One row per minute of the time window: small enough for one window.
    newer = F.sum("n").over(Window.orderBy(F.desc("minute"))) - F.col("n")
    inside = (F.col("newer") < skip + k) & (F.col("newer") + F.col("n") > skip)
    place = counts.withColumn("newer", newer).agg(
        F.min(F.when(inside, F.col("minute"))).alias("first"),
        F.max(F.when(inside, F.col("minute"))).alias("last"),
        F.min(F.when(inside, F.col("newer"))).alias("newer"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("dated"),
    ).first()  # four figures
    undated = F.col(ts).isNull() & F.lit(place["dated"] < skip + k)
    if place["first"] is None:
        return df.where(undated).orderBy(*order).offset(max(0, skip - place["dated"])).limit(k)
    dated = (F.col(ts) >= F.lit(place["first"])) & (F.col(ts) < F.lit(place["last"]) + F.expr("INTERVAL 1 MINUTE"))
    page = df.where(dated | undated)
    return top_k(page, skip - place["newer"] + k, *order).orderBy(*order).offset(skip - place["newer"]).limit(k) if skip else top_k(page, k, *order)


def latest_per_key(df: DataFrame, keys: list[str], *order: str, columns: list[str] | None = None) -> DataFrame:
    """One row per key, the greatest by ``order``; NULL sorts lowest.

    An aggregate, not a window: tasks reduce their rows before the shuffle, so a
    hot key costs one row per task. The remaining columns join the order to make
    the choice deterministic.
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    ranked = list(order) + [c for c in rest if c not in order]
    best = F.max_by(F.struct(*rest), F.struct(*ranked)) if rest else F.lit(None)
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def modal(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Most frequent non-NULL value per key, the smallest on a tie.

    Two aggregations instead of one ``mode``: its state would hold every value of
    a hot key in one task.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(pick_modal(value, "_n").alias(out))


def pick_modal(value: str, weight: str) -> Column:
    """Aggregate over pre-counted values: the heaviest, then smallest, non-NULL one."""
    rank = F.when(F.col(value).isNotNull(), F.struct((-F.col(weight)).alias("w"), F.col(value).alias("v")))
    return F.min(rank)["v"]


def newest_ids(
    df: DataFrame, keys: list[str], k: int = 50, ts: str = "timestamp", id_col: str = "id"
) -> DataFrame:
    """Ids of the ``k`` newest rows per key, newest first.

    ``row_number() <= k`` lets Spark cut each task's rows of a group to k before
    the shuffle, so a group of any size stays small.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(id_col))
    ranked = df.select(*keys, ts, id_col).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    ids = F.array_sort(F.collect_list(F.struct("_rn", id_col)))
    return ranked.groupBy(*keys).agg(F.transform(ids, lambda s: s[id_col]).alias("log_ids"))
