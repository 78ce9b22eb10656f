"""Computing columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but later steps refer to the values and not to their
    expressions.

    The optimizer copies the expressions of a projection into the filters above
    it, so costly ones would run twice. It does not look into a generator: one
    that emits exactly one row per row keeps the values as they are. It stays in
    the same stage and in the generated code.
    """
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(made)))


SPREAD = 4096


def spread_null(key: Column, by: Column) -> Column:
    """Join key in which a NULL becomes one of many texts that match nothing, so
    that rows without a key do not meet in one task."""
    filler = F.concat(F.lit("none-"), F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("string"))
    return F.coalesce(key, filler)
