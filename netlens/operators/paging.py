"""Pages of any depth in any sort order, found by ranges of the sort key."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

# A range of at most so many keys is sorted; a larger one is cut into ranges.
FEW = 100_000
RANGES = 64
# Keys a cut is estimated from; they decide about work, never about the page.
SAMPLED = RANGES * 32


@dataclass(frozen=True)
class Range:
    """Keys from ``lower`` up to, but not including, ``upper`` (None: open), how many
    there are and how many of them come before the page."""

    lower: Row | None
    upper: Row | None
    count: int
    skip: int


def sortable(df: DataFrame, column: str, keys: list[Column]) -> Column:
    """The sort key as one struct: ``keys`` and ``id``, NULL greater than any value."""
    if isinstance(df.schema[column].dataType, TimestampType):
        keys = [F.unix_micros(k) for k in keys]  # exact as a constant, whatever the driver's time zone
    return F.struct(F.col(column).isNull().alias("z"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col("id").alias("id"))


def _literal(split: Row, key: Column) -> Column:
    """A split point as a constant of the key's own types."""
    fields = [F.when(F.lit(True), F.lit(v)).otherwise(key[f]).alias(f) if v is None else F.lit(v).alias(f) for f, v in split.asDict().items()]
    return F.struct(*fields)


def _inside(part: Range, key: Column) -> Column:
    inside = F.lit(True)
    if part.lower is not None:
        inside &= key >= _literal(part.lower, key)
    if part.upper is not None:
        inside &= key < _literal(part.upper, key)
    return inside


def _number(key: Column, splits: list[Row], first: int = 0) -> Column:
    """Number of the range a key lies in, by halving: a few comparisons per row."""
    if not splits:
        return F.lit(first)
    middle = len(splits) // 2
    below, above = _number(key, splits[:middle], first), _number(key, splits[middle + 1 :], first + middle + 1)
    return F.when(key < _literal(splits[middle], key), below).otherwise(above)


def _cut(keys: DataFrame, part: Range, size: int, descending: bool) -> Range:
    """The ranges of ``part`` that the page lies in, as one range."""
    key = F.col("key")
    # The keys with the smallest hashes: an even sample that every run takes alike.
    sample = keys.orderBy(F.xxhash64("key"), "key").limit(SAMPLED)
    sample = [row["key"] for row in sample.orderBy("key").collect()]
    step = max(1, len(sample) // RANGES)
    splits = list(dict.fromkeys(sample[step::step]))
    counts = dict(keys.groupBy(_number(key, splits).alias("number")).count().collect())  # one per range
    numbers = range(len(splits), -1, -1) if descending else range(len(splits) + 1)
    before, hit, skipped = 0, [], 0
    for number in numbers:
        n = counts.get(number, 0)
        if before < part.skip + size and before + n > part.skip:
            skipped = skipped if hit else before
            hit.append(number)
        before += n
    if not hit:
        return replace(part, count=0)
    bounds = [part.lower, *splits, part.upper]
    return Range(bounds[min(hit)], bounds[max(hit) + 1], sum(counts[n] for n in hit if n in counts), part.skip - skipped)


def page_range(keys: DataFrame, skip: int, size: int, descending: bool, few: int = FEW) -> Range:
    """The range of ``keys`` (one column ``key``) with the rows ``skip`` to ``skip + size``.

    Each step counts the keys of up to 64 ranges in one scan and goes on inside those
    the page lies in, so that a step divides the keys by 30 or more. Ids differ, so even
    a value that most rows share is cut, by id.
    """
    part = Range(None, None, keys.count(), skip)
    while part.count > few:
        inside = keys.where(_inside(part, F.col("key")))
        smaller = _cut(inside, part, size, descending)
        if smaller.count == part.count:  # equal keys and ids: nothing to cut by
            break
        part = smaller
    return part


def page_ids(
    df: DataFrame, column: str, keys: list[Column], skip: int, size: int, descending: bool, few: int = FEW
) -> DataFrame:
    """``id`` of the rows of a page in the order of ``column``, then ``id``; NULL is the
    greatest value. ``keys`` are what the column is sorted by.

    No task sorts more than ``few`` keys (and those of one page), however deep the page
    is. A page beyond the last row is empty.
    """
    narrow = df.select(sortable(df, column, keys).alias("key"))
    order = F.desc("key") if descending else F.asc("key")
    if skip + size <= few:
        return narrow.orderBy(order).offset(skip).limit(size).select("key.id")
    part = page_range(narrow, skip, size, descending, few)
    if part.count == 0 or part.skip >= part.count:
        return narrow.where(F.lit(False)).select("key.id")
    inside = narrow.where(_inside(part, F.col("key")))
    return inside.orderBy(order).offset(part.skip).limit(size).select("key.id")
