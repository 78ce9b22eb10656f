"""Language identification of words by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import import_in_workers
from netlens.llm.sampling import per_class, remainder
from netlens.llm.wordhash import LOWER, NO_LETTER, SpanHashes, chunks, spans

# Bounds of the training sample: documents per language, languages, characters of one.
SAMPLE_DOCS = 120
LANGUAGES = 200
SAMPLE_CHARS = 20_000
FEATURES = 1 << 17
SEGMENT = 64
EPOCHS = 12
RATE, DECAY = 0.5, 1e-4
AFFIXES = (1, 2, 3, 4)
NGRAM = 3
SEED = 13
UNKNOWN = "und"

SPANS = "array<struct<first_word: int, n_words: int, lang: string>>"


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature numbers of words: one array for each affix and the whole word (the
    lexicon), and those of the inner n-grams with the word each belongs to. Lengths are
    in bytes of lower-cased UTF-8."""
    hashes, mask = SpanHashes(data), np.uint64(FEATURES - 1)
    columns = [hashes(starts, ends) & mask]
    for k, n in enumerate(AFFIXES):
        salt = np.uint64(0x9E37 * (2 * k + 1))
        columns.append((hashes(starts, np.minimum(starts + n, ends)) ^ salt) & mask)
        columns.append((hashes(np.maximum(ends - n, starts), ends) ^ (salt + np.uint64(0x5851))) & mask)
    counts = np.maximum(ends - starts - NGRAM + 1, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    at = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams = (hashes(at, at + NGRAM) ^ np.uint64(0xB5297)) & mask
    return [c.astype(np.int64) for c in columns], grams.astype(np.int64), owner


def sums_by_word(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of ``values`` per owner; owners come in order."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] = np.add.reduceat(values, first, axis=0)
    return out


@dataclass
class Model:
    """Weights of features per language, and of a language after another."""

    languages: list[str]
    weights: np.ndarray  # features x languages
    steps: np.ndarray  # languages x languages

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        columns, grams, owner = word_features(data, starts, ends)
        out = sums_by_word(self.weights[grams], owner, len(starts))
        for column in columns:
            out += self.weights[column]
        return out

    def marginals(self, scores: np.ndarray, first: np.ndarray, lengths: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Probability of each language for each word, by forward-backward over whole
        sequences: words first[k] to first[k] + lengths[k] are one. All sequences go in
        step, the longest first, so the ones still running are always in front.
        Expected numbers of steps between languages are added to ``pairs`` if it is given."""
        order = np.argsort(-lengths, kind="stable")
        first, lengths = first[order], lengths[order]
        local = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
        change = np.exp(self.steps - self.steps.max())
        ahead = np.empty_like(local)
        running = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
        message = None
        for t, k in enumerate(running):
            at = first[:k] + t
            message = local[at] if message is None else (message[:k] @ change) * local[at]
            message /= message.sum(axis=1, keepdims=True)
            ahead[at] = message
        message = np.empty((0, local.shape[1]), local.dtype)
        for t in range(len(running) - 1, -1, -1):
            k = running[t]
            # Sequences that end here begin with an even message.
            message = np.concatenate([message, np.ones((k - len(message), local.shape[1]), local.dtype)])
            at = first[:k] + t
            ahead[at] *= message
            message = message * local[at]
            if pairs is not None and t:
                both = ahead[at - 1][:, :, None] * change * message[:, None, :]
                pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            message = message @ change.T
            message /= message.sum(axis=1, keepdims=True)
        return ahead / ahead.sum(axis=1, keepdims=True) if len(ahead) else ahead


def train(texts: list[bytes], labels: list[str]) -> Model | None:
    """Maximum likelihood by AdaGrad over batches of segments of the texts' words, each
    word labelled with its text's language. None without a word to learn from."""
    languages = sorted(set(labels))
    data, bounds = LOWER[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum([0, *map(len, texts)])
    starts, ends = spans(data, bounds, NO_LETTER)
    if not len(starts):
        return None
    owner_text = np.searchsorted(bounds, starts, "right") - 1
    gold = np.searchsorted(languages, labels)[owner_text]
    columns, grams, gram_owner = word_features(data, starts, ends)
    number = np.arange(len(starts)) - np.searchsorted(starts, bounds)[owner_text]
    heads = np.flatnonzero(number % SEGMENT == 0)
    sizes = np.diff(np.append(heads, len(starts)))
    n = len(languages)
    model = Model(languages, np.zeros((FEATURES, n), np.float32), np.zeros((n, n), np.float32))
    past, past_steps = np.full(model.weights.shape, 1e-8, np.float32), np.full((n, n), 1e-8, np.float32)
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(heads)), max(1, len(heads) // 256)):
            part = np.sort(part)
            words = np.concatenate([np.arange(h, h + s) for h, s in zip(heads[part], sizes[part], strict=True)])
            lengths = sizes[part]
            first = np.cumsum(lengths) - lengths
            inside = np.zeros(len(starts), bool)
            inside[words] = True
            new = np.cumsum(inside) - 1
            g = np.flatnonzero(inside[gram_owner])
            mine = [*((c[words], np.arange(len(words))) for c in columns), (grams[g], new[gram_owner[g]])]
            scores = sums_by_word(model.weights[mine[-1][0]], mine[-1][1], len(words))
            for c, _rows in mine[:-1]:
                scores += model.weights[c]
            expected = np.zeros((n, n), np.float32)
            slope = model.marginals(scores, first, lengths, expected)
            follow = np.ones(len(words), bool)
            follow[first] = False
            at = np.flatnonzero(follow)
            seen = np.zeros((n, n), np.float32)
            np.add.at(seen, (gold[words[at - 1]], gold[words[at]]), 1)
            slope[np.arange(len(words)), gold[words]] -= 1
            feature = np.concatenate([f for f, _ in mine])
            row = np.concatenate([r for _, r in mine])
            for k in range(n):
                total = np.bincount(feature, slope[row, k], FEATURES).astype(np.float32) / len(part) + DECAY * model.weights[:, k]
                past[:, k] += total * total
                model.weights[:, k] -= RATE * total / np.sqrt(past[:, k])
            total = (expected - seen) / len(part) + DECAY * model.steps
            past_steps += total * total
            model.steps -= (RATE * total / np.sqrt(past_steps)).astype(np.float32)
    return model


def fit(documents: DataFrame) -> Model | None:
    """From a bounded sample of the rows with a text and a language that are not held
    out: about ``SAMPLE_DOCS`` for each of the ``LANGUAGES`` most frequent ones, of at
    most ``SAMPLE_CHARS`` characters each."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null").where(remainder(F.col("doc_id"), 4) != 2)
    rows = rows.where(F.char_length("text") <= SAMPLE_CHARS)
    sample = sorted((r["doc_id"], r["text"], r["lang"]) for r in per_class(rows, "lang", SAMPLE_DOCS, LANGUAGES, SEED).collect())
    return train([t.encode() for _, t, _ in sample], [x for *_, x in sample]) if sample else None


def label(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, spans): the language with the highest mean probability
    over the text's words (runs of letters, whole texts), that mean, and the runs of
    words in one language, which show where a text switches.

    Null texts and those without a letter, or all if there was nothing to learn from,
    are ``und`` with score 0 and no spans. Ties go to the first language in order. Ids
    may be null or repeated; other columns are ignored.
    """
    import_in_workers(documents.sparkSession)
    text = F.col("text").cast("string")
    rows = documents.select("doc_id", F.when(text.rlike(r"\p{L}"), text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(SPANS).alias("spans"))
    given = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        names = pa.array([*model.languages, UNKNOWN])
        for batch in batches:
            best, score, runs, heads, sizes, langs = [], [], [], [], [], []
            for _, data, bounds in chunks(batch.column("text")):
                data = LOWER[data]
                starts, ends = spans(data, bounds, NO_LETTER)
                first = np.searchsorted(starts, bounds)
                lengths = np.diff(first)
                chance = model.marginals(model.emissions(data, starts, ends), first[:-1], lengths)
                some = np.flatnonzero(lengths)
                mean = np.zeros((len(lengths), len(model.languages)))
                if len(some):
                    mean[some] = np.add.reduceat(chance.astype(np.float64), first[some], axis=0) / lengths[some, None]
                top = mean.argmax(axis=1)
                score.append(np.clip(mean[np.arange(len(top)), top], 0, 1))
                best.append(np.where(lengths > 0, top, len(model.languages)))
                word = chance.argmax(axis=1) if len(chance) else np.empty(0, np.int64)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])])) if len(word) else np.empty(0, np.int64)
                runs.append(np.bincount(owner[new], minlength=len(lengths)))
                heads.append(new - first[owner[new]])
                sizes.append(np.diff(np.append(new, len(word))))
                langs.append(word[new])
            if not best:
                continue
            each = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(heads), pa.int32()), pa.array(np.concatenate(sizes), pa.int32()), names.take(pa.array(np.concatenate(langs)))],
                names=["first_word", "n_words", "lang"],
            )
            ends = np.cumsum(np.concatenate(runs))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    names.take(pa.array(np.concatenate(best))),
                    pa.array(np.concatenate(score)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), each),
                ],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans {SPANS}")


def language_digest(documents: DataFrame) -> DataFrame:
    out = label(documents, fit(documents))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
