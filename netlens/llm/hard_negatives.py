"""Hard negatives by a GNAT-style multiway hyperplane tree.

Inner products become distances: with M the largest norm, x gets one more coordinate,
sqrt(M^2 - |x|^2), and a query q gets 0, so d(q, x)^2 = |q|^2 + M^2 - 2 q.x. A window of
scores is then an annulus around the query. A node of the tree has split points; a
vector belongs to the nearest. For each split point and each sibling subtree the node
keeps the range of distances from the one to the vectors of the other: a sibling whose
range can't meet the annulus is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import hash_unit, import_in_workers, join_checked, saved
from netlens.llm.vectors import LEAST, MOST, clamped, exact, exact_parts, fitting, usable, whole

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES, NEGATIVES = 5, 10
# A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
# Split points are chosen from a sample of about so many vectors (never more than twice).
# All vectors are then put into the tree, and ranges are taken over all of them.
SAMPLE = 20_000
FANOUT = 16
LEAF_ROWS = 2048
# A leaf with more rows than this is searched in chunks, requests in blocks.
CHUNK_ROWS = 4096
BLOCK_ROWS = 4096
SLACK = 1e-6

ROWS = "vec_id long, label long, v array<double>, leaf int"
RANGES = "node int, child int, split int, low double, high double"
REQUEST = ["anchor_id", "anchor_key", "place"]
FOUND = "anchor_id long, anchor_key long, place int, vec_id long, score long"


class Tree:
    """Split points of one number of dimensions. ``children`` of a node are leaves (below 0,
    ``-1 - number``) or nodes. ``norm`` is the largest of all vectors."""

    def __init__(self, sample: np.ndarray, rows: int, norm: float, first_leaf: int, seed: int = 7):
        self.norm, self.first_leaf, self.leaves = norm, first_leaf, 0
        self.splits: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.random = np.random.default_rng(seed)
        self.root = self._grow(self.lifted(sample), rows)

    def lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0))
        return np.column_stack([vectors, rest])

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, sample: np.ndarray, rows: float) -> int:
        fanout = min(FANOUT, int(np.ceil(rows / LEAF_ROWS)))
        if fanout < 2 or len(sample) < 2 * fanout:
            return self._leaf()
        # Far apart: each next one is the candidate that is farthest from those chosen.
        some = sample[self.random.choice(len(sample), min(len(sample), 3 * fanout), replace=False)]
        chosen = [some[0]]
        nearest = distances(some, some[:1])[:, 0]
        while len(chosen) < fanout and nearest.max() > SLACK * max(self.norm, 1):
            chosen.append(some[nearest.argmax()])
            nearest = np.minimum(nearest, distances(some, chosen[-1][None])[:, 0])
        if len(chosen) < 2:
            return self._leaf()
        node, splits = len(self.splits), np.array(chosen)
        self.splits.append(splits)
        self.children.append([])
        self.low.append(np.full((len(splits), len(splits)), np.inf))  # of split i and child j
        self.high.append(np.full((len(splits), len(splits)), -np.inf))
        child = distances(sample, splits).argmin(axis=1)
        for j in range(len(splits)):
            part = sample[child == j]
            self.children[node].append(self._grow(part, rows * len(part) / len(sample)))
        return node

    def walk(self, vectors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(node, child, rows, distances) for every child that vectors go through; leaves come
        as (-1, leaf, rows, none)."""
        todo = [(self.root, np.arange(len(vectors)))]
        points = self.lifted(vectors)
        while todo:
            node, rows = todo.pop()
            if node < 0:
                yield -1, self.first_leaf - 1 - node, rows, points[:0]
                continue
            far = distances(points[rows], self.splits[node])
            child = far.argmin(axis=1)
            for j, then in enumerate(self.children[node]):
                mine = child == j
                if mine.any():
                    yield node, j, rows[mine], far[mine]
                    todo.append((then, rows[mine]))

    def route(self, vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, bound) of all leaves that may hold a score from ``low`` to ``high``;
        the bound is a distance no vector of the leaf is nearer than."""
        points = self.lifted(vectors, query=True)
        square = (vectors**2).sum(axis=1) + self.norm**2
        slack = SLACK * np.sqrt(square)
        inner = np.sqrt(np.maximum(square - 2 * high, 0)) - slack
        outer = np.sqrt(np.maximum(square - 2 * low, 0)) + slack
        todo, out = [(self.root, np.arange(len(vectors)), np.zeros(len(vectors)))], []
        while todo:
            node, rows, bound = todo.pop()
            if node < 0:
                out.append((rows, np.full(len(rows), self.first_leaf - 1 - node), bound))
                continue
            far = distances(points[rows], self.splits[node])
            for j, then in enumerate(self.children[node]):
                low_j, high_j = self.low[node][:, j], self.high[node][:, j]
                if low_j[0] > high_j[0]:
                    continue  # nobody lives there
                nearest = np.maximum(bound, np.maximum(far - high_j, low_j - far).max(axis=1))
                farthest = (far + high_j).min(axis=1)
                meets = (nearest <= outer[rows]) & (farthest >= inner[rows])
                if meets.any():
                    todo.append((then, rows[meets], nearest[meets]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.empty((0, 0))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) of the vectors of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), at, matrix(column.take(pa.array(at)))


def built(rows: DataFrame) -> dict[int, Tree]:
    """A tree for each length of vectors of which the sample has some."""
    sizes = rows.groupBy(F.size("v").alias("n")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)).alias("square")
    )
    sizes = sizes.orderBy(F.col("rows").desc(), "n").limit(FANOUT).collect()
    trees, leaf = {}, 0
    for r in sizes:
        part = rows.where(F.size("v") == r["n"]).where(hash_unit(F.lit(11), F.col("vec_id"), F.col("v")) < SAMPLE / r["rows"]).limit(2 * SAMPLE)
        sample = matrix(part.select("v").toArrow().column("v"))
        if len(sample) and r["n"]:
            trees[r["n"]] = Tree(sample, r["rows"], float(np.sqrt(r["square"])) * (1 + 1e-9), leaf)
            leaf += trees[r["n"]].leaves
    return trees


def planted(rows: DataFrame, trees) -> DataFrame:
    """Every vector with its leaf. Lengths without a tree are one leaf each, below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.empty(batch.num_rows, np.int32)
            for n, at, vectors in by_length(batch.column("v")):
                if n in trees.value:
                    for node, number, mine, _ in trees.value[n].walk(vectors):
                        if node < 0:
                            leaf[at[mine]] = number
                else:
                    leaf[at] = -1 - n
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("vec_id", "label", "v")] + [pa.array(leaf)], names=["vec_id", "label", "v", "leaf"])

    return rows.mapInArrow(run, ROWS)


def with_ranges(rows: DataFrame, trees: dict[int, Tree], sent) -> None:
    """Takes the ranges of all nodes over all vectors: few numbers per task, then per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for batch in batches:
            for n, _, vectors in by_length(batch.column("v")):
                for node, child, _, far in sent.value[n].walk(vectors) if n in sent.value else ():
                    if node >= 0:
                        key = n, node, child
                        low[key] = np.minimum(low.get(key, np.inf), far.min(axis=0))
                        high[key] = np.maximum(high.get(key, -np.inf), far.max(axis=0))
        out = [(n, node, child, i, a, b) for (n, node, child), lows in low.items() for i, (a, b) in enumerate(zip(lows, high[n, node, child], strict=True))]
        names = ["n", "node", "child", "split", "low", "high"]
        kinds = [pa.int32()] * 4 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    # As many rows as the trees have split points times children, whatever the table's size.
    ranges = rows.select("v").mapInArrow(run, f"n int, {RANGES}").groupBy("n", "node", "child", "split").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in ranges.collect():
        trees[r["n"]].low[r["node"]][r["split"], r["child"]] = r["low"]
        trees[r["n"]].high[r["node"]][r["split"], r["child"]] = r["high"]


def routed(requests: DataFrame, trees, first: bool) -> DataFrame:
    """Adds ``leaf``: a row for every leaf that a request has to look into, or for the most
    promising one alone. A leaf named ``probed`` is left out."""
    names = [c for c in requests.columns if c != "probed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, vectors in by_length(batch.column("v")):
                low, high = (batch.column(c).to_numpy(zero_copy_only=False)[at].astype(np.float64) for c in ("low", "high"))
                if n in trees.value:
                    query, leaf, bound = trees.value[n].route(vectors, low, high)
                else:
                    query, leaf, bound = np.arange(len(at)), np.full(len(at), -1 - n), np.zeros(len(at))
                if first:
                    order = np.lexsort((leaf, bound, query))
                    query, leaf = query[order], leaf[order]
                    keep = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else query
                    query, leaf = query[keep], leaf[keep]
                else:
                    keep = leaf != batch.column("probed").to_numpy(zero_copy_only=False)[at[query]]
                    query, leaf = query[keep], leaf[keep]
                rows = batch.select(names).take(pa.array(at[query]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(leaf.astype(np.int32))], names=[*names, "leaf"])

    kinds = dict(requests.dtypes)
    return requests.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", leaf int")


def best_in(candidates: pd.DataFrame, requests: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The k best candidates of each request in a chunk of a leaf: of its label or of others,
    scores inside its window, never its own id."""
    out = []
    if len(candidates) and len(requests):
        ids, labels = candidates["vec_id"].to_numpy(np.int64), candidates["label"].to_numpy(np.int64)
        vectors = np.array(candidates["v"].tolist(), np.float64).reshape(len(candidates), -1)
        queries = np.array(requests["v"].tolist(), np.float64).reshape(len(requests), -1)
        fixed = [requests[c].to_numpy() for c in (*REQUEST, "label", "low", "high")]
        for i, j, small in exact_parts(vectors, queries):
            left = vectors[i].T if small else exact(vectors[i]).T
            for first in range(0, len(j), 256):
                block = j[first : first + 256]
                scores = (queries[block] if small else exact(queries[block])) @ left
                for q, row in zip(block, scores, strict=True):
                    anchor, key, place, label, low, high = (x[q] for x in fixed)
                    may = ((labels[i] == label) == same) & (ids[i] != anchor)
                    # The ends of a long stand for no limit.
                    may &= (row >= int(low)) if low > LEAST else True
                    may &= (row <= int(high)) if high < MOST else True
                    at = np.flatnonzero(may)
                    if len(at) > k:
                        at = at[row[at] >= np.sort(row[at])[-k]]
                    at = at[np.lexsort((ids[i][at], [-s for s in row[at]]))[:k]] if len(at) else at
                    out += [(anchor, key, place, ids[i][x], clamped(row[x])) for x in at]
    return pd.DataFrame(out, columns=[*REQUEST, "vec_id", "score"])


def looked_up(rows: DataFrame, leaves: DataFrame, requests: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best of each request in each chunk of the leaves it was sent to."""
    sizes = requests.groupBy("leaf").agg(F.count(F.lit(1)).alias("requests"))
    plan = leaves.join(sizes, "leaf").select(
        F.col("leaf").alias("at"), F.ceil(F.col("rows") / CHUNK_ROWS).cast("int").alias("chunks"), F.ceil(F.col("requests") / BLOCK_ROWS).cast("int").alias("blocks")
    )
    plan = saved(plan)

    def dealt(parts: str, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.col(parts)).cast("int")

    def numbers(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    here = F.col("leaf") == F.col("at")
    left = join_checked(rows, plan, here, "inner").withColumn("chunk", dealt("chunks", "vec_id")).withColumn("block", numbers("blocks")).drop(*plan.columns)
    right = join_checked(requests, plan, here, "inner").withColumn("block", dealt("blocks", *REQUEST)).withColumn("chunk", numbers("chunks")).drop(*plan.columns)
    keys = ["leaf", "chunk", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda c, q: best_in(c, q, k, same), FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy(*REQUEST).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(rows: DataFrame, leaves: DataFrame, trees, requests: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, anchor_key, place, rank, vec_id, score): the k best of each request. The most
    promising leaf is searched first; if it gives k, the worst of these narrows the
    annulus before all other leaves it meets are searched."""
    probes = saved(routed(requests, trees, first=True))
    near = saved(ranked(looked_up(rows, leaves, probes, k, same), k))
    worst = near.groupBy(*REQUEST).agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("least")).where(F.col("c") == k).drop("c")
    then = probes.withColumnRenamed("leaf", "probed").join(worst, REQUEST, "left").withColumn("low", F.greatest("low", "least")).drop("least")
    rest = saved(routed(then, trees, first=False))
    return ranked(near.drop("rank").unionByName(looked_up(rows, leaves, rest, k, same)), k).withColumn("score", fitting(F.col("score")))


def negatives(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows
    (vec_id, label, v) of ``labelled_vectors``: the ``positives`` best others of an anchor's
    label, and for each the ``k`` best of other labels whose score lies between ``low`` and
    ``high`` percent of the positive's.

    Rows with a null id, label or vector, or a null or non-finite component, take no
    part; other columns are ignored. A row that repeats as a whole counts once;
    different rows under one id are rows of their own, and none is another's positive
    or negative. Ties go to smaller ids. Vectors are compared with those of their own
    length, which may be 0 or very large. An empty table gives no rows. Scores are exact
    at any size; one that is to be returned and does not fit a long is an error.
    """
    import_in_workers(vectors.sparkSession)
    spark = vectors.sparkSession
    trees = built(vectors)
    sent = spark.sparkContext.broadcast(trees)
    rows = saved(planted(vectors, sent))
    with_ranges(rows, trees, sent)
    trees = spark.sparkContext.broadcast(trees)
    leaves = saved(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")))
    first = anchors.select(
        F.col("vec_id").alias("anchor_id"), F.xxhash64("v", "label").alias("anchor_key"), F.lit(0).alias("place"), "label", "v",
        F.lit(LEAST).cast("long").alias("low"), F.lit(MOST).cast("long").alias("high"),
    )
    first = saved(first)
    found = searched(rows, leaves, trees, first, positives, True)
    found = saved(found.select("anchor_id", "anchor_key", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    share = F.col("positive_score").cast("decimal(19,0)")
    window = {"low": F.ceil(share * low / 100).cast("long"), "high": F.floor(share * high / 100).cast("long")}
    second = found.withColumns(window).where("low <= high").join(first.select("anchor_id", "anchor_key", "label", "v"), ["anchor_id", "anchor_key"])
    second = saved(second.select(*REQUEST, "label", "v", "low", "high"))
    hard = searched(rows, leaves, trees, second, k, False)
    return found.join(hard, REQUEST).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def labelled_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, label, v) of ``embeddings`` (vec_id, embedding, label) for ``negatives``."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    return rows.select("vec_id", "label", whole(F.col("embedding"), scale).alias("v")).dropDuplicates(["vec_id", "label", "v"])


def negative_digest(embeddings: DataFrame) -> DataFrame:
    """Anchors are the rows whose id is divisible by ANCHOR_EVERY. Every seventh id has the
    next label: rows of a class that lie among those of another."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = saved(labelled_vectors(embeddings.select("vec_id", "embedding", moved.alias("label"))))
    return negatives(rows, rows.where(F.col("vec_id") % ANCHOR_EVERY == 0))
