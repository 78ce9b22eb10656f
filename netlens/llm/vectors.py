"""Vectors of whole numbers, exact at any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    return vector.isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles: beyond 2^52 those are whole anyway,
    and no finite component is too large for one."""

    def floor(e: Column) -> Column:
        y = e.cast("double") * scale
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, floor)


def plain(vectors: np.ndarray) -> np.ndarray:
    """Which rows are small enough for floating point: sums of products of two of them stay
    below 2^53, so they are exact."""
    limit = np.sqrt((1 << 53) / max(1, vectors.shape[1]))
    return np.abs(vectors).max(axis=1, initial=0) < limit


def exact(vectors: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers, for products of any size."""
    out = np.empty(vectors.shape, object)
    out.flat = [int(x) for x in vectors.flat]
    return out


def exact_parts(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows of left, rows of right, whether both are plain): all pairs, in parts."""
    a, b = plain(left), plain(right)
    for x in (True, False):
        for y in (True, False):
            i, j = np.flatnonzero(a == x), np.flatnonzero(b == y)
            if len(i) and len(j):
                yield i, j, x and y


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def clamped(score) -> int:
    """A score as a long; one beyond is given its end. What is beyond below can only be in a
    result that lacks better ones, see ``fitting``."""
    return max(LEAST, min(MOST, int(score)))


def fitting(score: Column) -> Column:
    """The scores of a result: those that don't fit a long are an error."""
    wrong = F.raise_error(F.lit("a score does not fit a long: scale the vectors down")).cast("long")
    return F.when((score == LEAST) | (score == MOST), wrong).otherwise(score)
