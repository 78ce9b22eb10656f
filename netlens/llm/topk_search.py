"""Exact top-k inner product search: branch and bound over blocks of dimensions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import import_in_workers, saved
from netlens.llm.vectors import clamped, exact, exact_parts, fitting, usable, whole

K = 10
SCALE = 1024
QUERY_EVERY = 100
# Rows of a candidate chunk and of a block of queries: what one task holds at once.
# Larger chunks mean fewer copies of the queries on larger tables.
CHUNK_ROWS = 4096
BLOCK_ROWS = 8192
DIMENSIONS = 8
SEEDS = 32

FOUND = "query_id long, query_key long, vec_id long, score long"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): each component as floor(1024 * x), a whole number in a double. Vectors
    that are null, or hold a null or non-finite component, and rows without an id take no
    part; all others do, however large. A row that repeats as a whole counts once."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    rows = rows.where(usable(F.col("embedding")))
    return rows.select("vec_id", whole(F.col("embedding"), SCALE).alias("v")).dropDuplicates(["vec_id", "v"])


class Columns:
    """Candidates in vertical layout: one row of the matrix per dimension, those with the
    most mass first, in blocks, and the mass each candidate has left after each block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        squares = vectors**2
        self.order = np.argsort(-squares.sum(axis=0), kind="stable")
        self.matrix = np.ascontiguousarray(vectors[:, self.order].T)
        self.left = self.rest(squares[:, self.order])

    @staticmethod
    def rest(squares: np.ndarray) -> np.ndarray:
        """Norms of what comes after each block, rounded up."""
        sums = [squares[:, k:].sum(axis=1) for k in range(DIMENSIONS, squares.shape[1] + DIMENSIONS, DIMENSIONS)]
        return np.sqrt(np.array(sums).reshape(len(sums), len(squares))) * (1 + 1e-9)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to smaller ids."""
        query = query[self.order]
        query_left = self.rest(query[None, :] ** 2)[:, 0]
        alive = np.flatnonzero(self.ids != query_id)
        score = np.zeros(len(alive))
        least = None
        for block, first in enumerate(range(0, len(query), DIMENSIONS)):
            part = slice(first, first + DIMENSIONS)
            columns = self.matrix[part]
            score = score + query[part] @ (columns if len(alive) == columns.shape[1] else columns[:, alive])
            if len(alive) <= k:
                continue
            if least is None:
                # Full scores of the most promising so far: k of them are a bound for all.
                seeds = alive[np.argpartition(score, -min(SEEDS, len(alive)))[-SEEDS:]]
                full = np.sort(query @ self.matrix[:, seeds])
                least = full[-k] if len(full) >= k else None
            if least is not None:
                # Cauchy-Schwarz on the dimensions still to come.
                may = score + np.floor(query_left[block] * self.left[block][alive] + 1) >= least
                if not may.all():
                    alive, score = alive[may], score[may]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][best], score[best].astype(np.int64)


class AllScores:
    """The same for vectors too large for floating point: every score in full, by Python's
    integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.matrix = ids, exact(vectors)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        alive = np.flatnonzero(self.ids != query_id)
        scores = self.matrix[alive] @ exact(query[None, :])[0] if len(query) else [0] * len(alive)
        best = sorted(zip((-s for s in scores), self.ids[alive].tolist(), strict=True))[:k]
        return np.array([i for _, i in best], np.int64), [clamped(-s) for s, _ in best]


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows["vec_id"].to_numpy(np.int64), np.array(rows["v"].tolist(), np.float64).reshape(len(rows), -1)


def search_block(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of each query among small candidates, and among those that need wide
    numbers."""
    out = []
    if len(candidates) and len(queries):
        ids, vectors = _matrix(candidates)
        query_ids, query_vectors = _matrix(queries)
        keys = queries["query_key"].to_numpy()
        for i, j, small in exact_parts(vectors, query_vectors):
            columns = (Columns if small else AllScores)(ids[i], vectors[i])
            for q in j:
                found, scores = columns.search(query_ids[q], query_vectors[q], k)
                out.append(pd.DataFrame({"query_id": query_ids[q], "query_key": keys[q], "vec_id": found, "score": scores}))
    names = ["query_id", "query_key", "vec_id", "score"]
    return pd.concat(out).astype("int64") if out else pd.DataFrame({n: pd.Series(dtype="int64") for n in names})


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k candidates with the highest
    inner product, all if there are fewer, ties to the smaller id. Both tables have
    (vec_id, v) with integer vectors; only vectors of equal length are compared, and
    never those with the query's own id. Scores are exact at any size; one that is to be
    returned and doesn't fit a long is an error. Without queries or candidates there
    are no rows; repeated rows count as often as they are given.

    Candidates are dealt into chunks and queries into blocks by hashes of their ids, so
    equal vectors spread; one task searches one block in one chunk, and the k best of
    each meet per query. Different vectors under one id are queries of their own.
    """
    import_in_workers(candidates.sparkSession)
    size = F.size("v").alias("n")
    chunks = max(1, math.ceil(candidates.count() / chunk_rows))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks))
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks))

    def numbers(n: int) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))

    left = candidates.select("vec_id", "v", size, chunk.alias("chunk"), F.explode(numbers(blocks)).alias("block"))
    right = queries.select(
        "vec_id", "v", F.xxhash64("v").alias("query_key"), size, F.explode(numbers(chunks)).alias("chunk"), block.alias("block")
    )
    keys = ["n", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda c, q: search_block(c, q, k), FOUND)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", fitting(F.col("score")).alias("score")
    )


def search_digest(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, candidates all rows."""
    vectors = saved(integer_vectors(embeddings.select("vec_id", "embedding")))
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))
