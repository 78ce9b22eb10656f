"""Toxicity: a sparse logistic model that is held to equal scores when groups are swapped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import BROADCAST_ROWS, import_in_workers, small
from netlens.llm.sampling import per_class, remainder
from netlens.llm.wordhash import LOWER, NO_LETTER, SpanHashes, chunks, spans

# Bounds of the training sample: documents per label, characters of one.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000
# Beginnings of words, in bytes, that are features beside the word itself.
BEGINNINGS = (4, 5, 6)
LEAST_DOCS = 4
LEAST_Z = 3.5
FEATURES = 6000
L2, SWAP_PENALTY = 2e-4, 1.0
STEPS = 500
THRESHOLD = 0.7
SEED = 29

# Words for groups of people; those of one line are swapped for each other.
GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals", "tourists"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
)


def text_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes of its words and their beginnings, and for each the
    number of the text; parts of some MB at a time, counted from the first text."""
    for first, data, bounds in chunks(texts):
        data = LOWER[data]
        starts, ends = spans(data, bounds, NO_LETTER)
        hashes, owner = SpanHashes(data), first + np.searchsorted(bounds, starts, "right") - 1
        found, owners = [hashes(starts, ends)], [owner]
        for n in BEGINNINGS:
            longer = ends - starts > n
            found.append(hashes(starts[longer], starts[longer] + n) ^ np.uint64(n))
            owners.append(owner[longer])
        yield np.concatenate(found), np.concatenate(owners)


def _of_word(word: str) -> np.ndarray:
    return np.concatenate([f for f, _ in text_features(pa.array([word]))])


@dataclass
class Model:
    """Sorted hashes of features, their weights and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Each feature counts once per text."""
        total = np.full(len(texts), self.bias)
        # A bit per low end of a hash sorts out nearly all words before the search.
        low = np.zeros(1 << 22, bool)
        low[(self.features & np.uint64(len(low) - 1)).astype(np.int64)] = True
        for found, owner in text_features(texts):
            may = low[(found & np.uint64(len(low) - 1)).astype(np.int64)]
            found, owner = found[may], owner[may]
            at = np.searchsorted(self.features, found)
            at[at == len(self.features)] = 0
            hit = self.features[at] == found if len(self.features) else np.zeros(0, bool)
            pairs = np.unique(owner[hit] * len(self.features) + at[hit])
            total += np.bincount(pairs // max(1, len(self.features)), self.weights[pairs % max(1, len(self.features))], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def train(docs: list[np.ndarray], toxic: np.ndarray) -> Model:
    """Logistic regression on distinct features per document, plus a penalty on the
    change of the score when a group word of a document is swapped for others."""
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
    every, owner = np.concatenate([np.empty(0, np.uint64), *docs]), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    features, at, counts = np.unique(every, return_inverse=True, return_counts=True)
    with_toxic = np.bincount(at, toxic[owner], len(features)) if len(every) else np.zeros(0)
    # Features whose share of toxic documents is beyond chance, the surest first.
    share = toxic.mean() if len(toxic) else 0.0
    z = (with_toxic - counts * share) / np.sqrt(counts * share * (1 - share) + 1e-9)
    groups = [[_of_word(w) for w in group] for group in GROUPS]
    known = np.unique(np.concatenate([h for g in groups for h in g]))
    good = np.flatnonzero((counts >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))
    good = good[np.argsort(-np.abs(z[good]), kind="stable")][:FEATURES]
    chosen = np.union1d(features[good], known[np.isin(known, features)])
    column = np.searchsorted(chosen, every)
    column[column == len(chosen)] = 0
    hit = chosen[column] == every if len(chosen) else np.zeros(0, bool)
    column, row = column[hit], owner[hit]

    # One swap for each group word of a document: the difference in features, once per
    # pair of words, with the number of documents it occurs in.
    swaps: dict[tuple, int] = {}
    for doc in docs:
        for number, group in enumerate(groups):
            for k, word in enumerate(group):
                if len(word) and word[0] in doc:
                    for other in range(len(group)):
                        if other != k:
                            swaps[number, k, other] = swaps.get((number, k, other), 0) + 1
    differences = []
    for (number, k, other), times in swaps.items():
        d = np.zeros(len(chosen))
        for sign, word in ((1, groups[number][other]), (-1, groups[number][k])):
            place = np.searchsorted(chosen, word)
            place[place == len(chosen)] = 0
            d[place[chosen[place] == word]] += sign
        differences.append(d * np.sqrt(times / max(1, len(groups[number]) - 1)))
    change = np.array(differences).reshape(len(differences), len(chosen))

    weights, bias = np.zeros(len(chosen)), float(np.log(rate / (1 - rate)))
    if not len(chosen) or toxic.min() == toxic.max():
        return Model(chosen, weights, bias)
    # Accelerated gradient steps, shorter than the inverse of the curvature's trace.
    # Both labels weigh the same, however rare one is.
    weight = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum()))
    per_doc = np.bincount(row, minlength=len(docs)) + 1
    most = (change**2).sum() if len(change) else 0.0
    rate, bias = 1 / (0.25 * (weight * per_doc).sum() + L2 + SWAP_PENALTY * most / len(docs)), 0.0
    old, old_bias = weights.copy(), bias
    for step in range(STEPS):
        push = step / (step + 3)
        w, b = weights + push * (weights - old), bias + push * (bias - old_bias)
        old, old_bias = weights, bias
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[column], len(docs)), -500, 500)))
        error = (p - toxic) * weight
        slope = np.bincount(column, error[row], len(chosen)) + L2 * w
        if len(change):
            slope += SWAP_PENALTY * change.T @ (change @ w) / len(docs)
        weights, bias = w - rate * slope, b - rate * error.sum()
    return Model(chosen, weights, bias)


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """From a bounded sample of the labelled documents that are not held out: about
    ``SAMPLE_DOCS`` per label, of at most ``SAMPLE_CHARS`` characters each. A document
    with several labels is toxic if one says so; other labels than 0 and 1 are left out."""
    import_in_workers(documents.sparkSession)
    marks = labels.where(F.col("toxic").isin(0, 1)).where(remainder(F.col("doc_id"), 3) != 1)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("text", F.lit(""))
    marks = per_class(marks, "toxic", SAMPLE_DOCS, 2, SEED).drop("text")
    assert small(marks, BROADCAST_ROWS)  # per_class bounds it
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).where(F.char_length("text") <= SAMPLE_CHARS)
    rows = rows.join(F.broadcast(marks), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for hashes, owner in text_features(batch.column("text")):
                for k in np.unique(owner):
                    found[k].append(hashes[owner == k])
            sets = [np.unique(np.concatenate(f)).view(np.int64) if f else np.empty(0, np.int64) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "toxic", "features"]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {kind}, toxic int, features array<long>").toArrow().sort_by("doc_id")
    docs = [np.asarray(f, np.int64).view(np.uint64) for f in got.column("features").to_pylist()]
    return train(docs, np.array(got.column("toxic").to_pylist(), float))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): probability that a text is toxic, from whole texts. Null and
    empty texts get that of a text without any feature. Ids may be null or repeated;
    other columns are ignored."""
    import_in_workers(documents.sparkSession)
    given = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = given.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def toxicity_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    out = score(documents, fit(documents, labels))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
