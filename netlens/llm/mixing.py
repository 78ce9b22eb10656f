"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import WORD, discard, hash_unit, join_checked, saved, text_of

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = 20240131
# The order is cut in this many ranges, and the range of the cut in as many again.
RANGES = 4096
# Documents that are looked at one by one after each that didn't fit; it decides about
# the number of rounds, never about what is taken.
FILLERS = 64
# ``v`` lies between these.
BEFORE, BEHIND = -1.0, 2.0
# A rank beyond all others is 1; the last range holds it, too.
LARGEST = 1 - 2.0**-30
BAND = "array<struct<low: double, high: double, room: double>>"


def source_targets(totals: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of the sum by weight, none above
    ``most`` times its source, the excess going to the others by weight.

    That is target = min(most * size, level * weight) with one level for all. Sources
    in order of most * size / weight are capped up to some point; the level is what is
    left there per unit of weight. One task orders the sources, of which it takes a row
    each: fine up to some ten million, so hosts or domains are to be grouped first.
    """
    everything = Window.partitionBy()
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_need = Window.partitionBy().orderBy("need", F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    t = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    t = t.withColumn("need", F.col("cap") / F.col("weight"))
    t = t.withColumn("left", F.sum("cap").over(everything) / most - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("need"), F.struct("need", "level"))).over(everything)["level"]
    return t.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select(
        "source", "source_size", "target", "mean_weight"
    )


def measured(documents: DataFrame, doc_weight: Column | None = None) -> DataFrame:
    """(row, source, size, w, u): the input row as a struct, the words of its text, its
    weight and a uniform number fixed by id and text. Without a usable weight it is 1."""
    w = F.lit(1.0) if doc_weight is None else doc_weight.cast("double")
    w = F.when(w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < F.lit(float("inf"))), w).otherwise(1.0)
    return documents.select(
        F.struct("*").alias("row"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of("text"), F.lit(WORD)).cast("long").alias("size"),
        w.alias("w"),
        hash_unit(F.lit(SEED), F.col("doc_id"), F.col("text")).alias("u"),
    )


def with_odds(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """Joins each row with its source's plan (null sources meet, too). Expected copies
    are target / size of the source, times the row's share of weight; ``whole`` of them
    are certain, the rest is the inclusion probability p, and the Pareto rank is
    odds(u) / odds(p), here mapped to ``v`` in (0, 1) without changing the order."""
    plan = plan.withColumnRenamed("source", "plan_source")
    out = join_checked(rows, plan, F.col("source").eqNullSafe(F.col("plan_source")), "left").drop("plan_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("w") / F.col("mean_weight"))
    expected = F.least(F.coalesce(expected, F.lit(0.0)), F.lit(float(most)))
    out = out.withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    p = F.col("expected") - F.col("whole")
    rank = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return out.withColumn("v", F.when(p > 0, rank / (1 + rank)))


def mixing_plan(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, ranges: int = RANGES
) -> DataFrame:
    """Per source: (source, source_size, target, mean_weight, bands, last). A document is
    taken ``whole`` times, and once more if one of the ``bands`` (low, high, room) holds
    it: low < v < high, and no more words than room; or if it is ``last``.

    That is every document in Pareto order that fits into the words still wanted when its
    turn comes. A round takes all up to the first that doesn't fit, which sums per range
    find, and looks at the next few one by one; the next round goes on behind them with
    those that are short enough for what is left, until none is. So no task orders a
    whole source. Equal rows have equal ``v`` and share their fate.
    """
    totals = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        # mean weight of a word, so that expected copies keep to the target
        F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("size")), F.sum("size")), F.lit(1.0)).alias("mean_weight"),
    )
    totals = totals.withColumn("mean_weight", F.when(F.col("mean_weight") > 0, F.col("mean_weight")).otherwise(1.0))
    plan = saved(source_targets(totals, weights, most))
    odds = with_odds(rows.select("source", "size", "w", "u"), plan, most).select("source", "size", "target", "whole", "v")
    sure = odds.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"))
    # (s, rest, low): words still wanted of the documents behind ``low``.
    state = saved(sure.select(F.col("source").alias("s"), F.col("rest").cast("double").alias("rest"), F.lit(BEFORE).alias("low")))
    open_rows = saved(odds.where(F.col("v").isNotNull() & (F.col("size") > 0)).select("source", "size", "v"))
    bands = state.select("s", F.array().cast(BAND).alias("bands"))
    while True:
        may = saved(_may_fit(open_rows, state))
        discard(open_rows)
        open_rows = may
        if open_rows.isEmpty():
            break
        for step in (lambda rows, state: _prefix(rows, state, ranges), _next_few):
            found = saved(step(open_rows, state))
            bands = bands.unionByName(found.select("s", "bands"))
            state = found.select("s", "rest", "low")
    bands = bands.groupBy("s").agg(F.array_sort(F.flatten(F.collect_list("bands"))).alias("bands"))
    banded = saved(plan.join(bands, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    last = _nearest(with_odds(rows.select("source", "size", "w", "u"), banded, most))
    out = saved(banded.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    discard(banded)
    return out


def _nearest(odds: DataFrame) -> DataFrame:
    """(s, last): the document (size, v) that the mix takes beyond its target, because it ends
    nearer to it so: the shortest that wasn't taken, if it is below twice the rest."""
    taken = (F.col("whole") + _in_band().cast("long")) * F.col("size")
    rest = odds.groupBy("source").agg((F.max("target") - F.sum(taken)).alias("rest")).withColumnRenamed("source", "s")
    left = odds.where(F.col("v").isNotNull() & (F.col("size") > 0) & ~_in_band())
    left = left.groupBy("source", "size", "v").agg(F.sum("size").cast("double").alias("words"))
    left = join_checked(left, rest, F.col("source").eqNullSafe(F.col("s")), "inner").where(F.col("words") < 2 * F.col("rest"))
    return left.groupBy("s").agg(F.min(F.struct("words", "v", "size")).alias("m")).select("s", F.struct("m.size", "m.v").alias("last"))


def _in_band() -> Column:
    taken = F.exists("bands", lambda b: (F.col("v") > b["low"]) & (F.col("v") < b["high"]) & (F.col("size") <= b["room"]))
    return F.coalesce(taken, F.lit(False))


def _may_fit(open_rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows whose turn is still to come and that aren't longer than what is left."""
    state = state.withColumnsRenamed({"rest": "most", "low": "behind"})
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("v") > F.col("behind")) & (F.col("size") <= F.col("most"))
    return join_checked(open_rows, state, on, "left_semi")


def _prefix(open_rows: DataFrame, state: DataFrame, ranges: int) -> DataFrame:
    """(s, rest, low, bands) after taking the rows up to the first that doesn't fit. It is
    found from sums per range of ``v``, then per smaller range inside the one that holds
    it, then row by row in there."""
    level = state.select("s", F.col("rest").alias("wanted"), F.lit(0).cast("long").alias("range"))

    def inside(rows: DataFrame, scale: int) -> DataFrame:
        rows = rows.withColumn("up", F.floor(F.least(F.col("v"), F.lit(LARGEST)) * scale))
        return join_checked(rows, level, F.col("source").eqNullSafe(F.col("s")) & (F.col("up") == F.col("range")), "inner")

    def before(*order: str) -> Column:
        earlier = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("words").over(earlier), F.lit(0))

    for scale in (1, ranges):
        bins = inside(open_rows, scale).withColumn("bin", F.floor(F.least(F.col("v"), F.lit(LARGEST)) * (scale * ranges)))
        bins = bins.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
        # The last range that begins before the wanted words are complete.
        bins = bins.withColumn("done", before("bin")).where(F.col("done") < F.col("wanted"))
        level = bins.groupBy("source").agg(F.max(F.struct("bin", "done", "wanted")).alias("m"))
        level = saved(level.select(F.col("source").alias("s"), (F.col("m.wanted") - F.col("m.done")).alias("wanted"), F.col("m.bin").alias("range")))
    ties = inside(open_rows, ranges * ranges).groupBy("source", "v").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"), F.first("range").alias("range"))
    ties = ties.withColumn("done", before("v") + F.col("words"))
    # If all rows of the range fit, it ends where the next range begins.
    end = F.when(F.col("range") + 1 < ranges * ranges, (F.col("range") + 1) / F.lit(float(ranges * ranges))).otherwise(BEHIND)
    fits = F.col("done") <= F.col("wanted")
    last = ties.groupBy("source").agg(
        F.coalesce(F.min(F.when(~fits, F.col("v"))), F.first(end)).alias("stop"), (F.first("wanted") - F.coalesce(F.max(F.when(fits, F.col("done"))), F.lit(0))).alias("left")
    )
    out = state.join(last, F.col("s").eqNullSafe(F.col("source")), "inner")
    band = F.struct("low", F.col("stop").alias("high"), F.col("rest").alias("room"))
    return out.select("s", F.col("left").cast("double").alias("rest"), F.col("stop").alias("low"), F.array(band).cast(BAND).alias("bands"))


def _next_few(open_rows: DataFrame, state: DataFrame) -> DataFrame:
    """(s, rest, low, bands) after looking at the next rows one by one. They are found in
    parts, then per source."""
    after = join_checked(open_rows, state, F.col("source").eqNullSafe(F.col("s")), "inner")
    after = after.where((F.col("v") > F.col("low")) & (F.col("size") <= F.col("rest")))
    ties = after.groupBy("source", "v").agg(F.sum("size").cast("double").alias("words"))
    parts = ties.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(32)))
    first = parts.withColumn("k", F.row_number().over(Window.partitionBy("source", "part").orderBy("v"))).where(F.col("k") <= FILLERS)
    near = first.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("v"))).where(F.col("k") <= FILLERS)
    lists = near.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("v", "words"))).alias("next"))
    rows = state.join(lists, F.col("s").eqNullSafe(F.col("source")), "inner")
    # The last one of a full list only says where the others end.
    full = F.size("next") >= FILLERS
    seen = F.when(full, F.slice("next", 1, FILLERS - 1)).otherwise(F.col("next"))
    end = F.when(full, F.element_at("next", -1)["v"]).otherwise(F.lit(BEHIND))
    room = F.col("rest")

    def band(low: Column, high: Column) -> Column:
        return F.array(F.struct(low.alias("low"), high.alias("high"), room.alias("room"))).cast(BAND)

    def take(state: Column, doc: Column) -> Column:
        fits = doc["words"] <= state["rest"]
        taken = F.struct((state["rest"] - doc["words"]).alias("rest"), state["low"].alias("low"), state["bands"].alias("bands"))
        missed = F.struct(state["rest"].alias("rest"), doc["v"].alias("low"), F.concat(state["bands"], band(state["low"], doc["v"])).alias("bands"))
        return F.when(fits, taken).otherwise(missed)

    start = F.struct(F.col("rest"), F.col("low"), F.array().cast(BAND).alias("bands"))
    rows = rows.withColumn("m", F.aggregate(seen, start, take)).withColumn("end", end)
    behind = F.when(full, F.element_at(seen, -1)["v"]).otherwise(F.lit(BEHIND))
    bands = F.concat("m.bands", band(F.col("m.low"), F.col("end")))
    return rows.select("s", F.col("m.rest").alias("rest"), behind.alias("low"), bands.alias("bands"))


def mix(rows: DataFrame, plan: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """Rows of ``measured`` with ``copies``, the number of times the mix takes each."""
    last = F.coalesce((F.col("v") == F.col("last.v")) & (F.col("size") == F.col("last.size")), F.lit(False))
    extra = (_in_band() | last).cast("long")
    return with_odds(rows, plan, most).withColumn("copies", F.col("whole") + extra)


def mixing_digest(documents: DataFrame) -> DataFrame:
    """Words taken of each document.

    Null texts have no words, a source without words has the target 0, null sources are
    one source and come last, an empty table
    gives no rows; repeated rows are taken alike. Which documents are taken depends on
    their ids and texts alone, so reruns agree.
    """
    rows = saved(measured(documents.select("doc_id", "source", "text")).select(F.struct("row.doc_id").alias("row"), "source", "size", "w", "u"))
    out = mix(rows, mixing_plan(rows))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed(documents: DataFrame) -> DataFrame:
    """``documents`` with its own columns, each row as often as the mix takes it. Plan
    and rows are made from the same figures, so the text isn't shuffled."""
    rows = measured(documents)
    plan = mixing_plan(saved(rows.drop("row")))
    out = mix(rows, plan).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
