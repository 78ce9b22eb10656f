"""Packing documents into sequences: online, with few open windows per partition."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import arrow_batches, import_in_workers, saved
from netlens.llm.wordhash import LOWER, SpanHashes, chunks, spans

CAPACITY = 4096
OPEN_WINDOWS = 16
EOS = 2
# A window is closed with less padding than this instead of cutting a document for it.
MIN_CUT = 32
# Leftover windows of this many partitions are merged by one task.
MERGED_PARTITIONS = 16
# Texts come to a worker in batches of this size and are encoded in parts of this size, so
# what a worker holds doesn't grow with the texts of a partition. One text may be longer.
BATCH_BYTES = 4 << 20
PART_BYTES = 512 << 10
# The tokenizer gets so many texts at once: it gives some 100 bytes for each id.
ENCODED_AT_ONCE = 2_000
# Words whose ids a worker keeps; beyond it starts anew, the ids stay the same.
CACHED_WORDS = 1_000_000

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long"
WINDOW = "partition long, window long, offset long, open boolean"


class WordIds:
    """Ids of texts. The tokenizer never joins letters over a blank and treats A-Z like
    a-z, so a text's ids are those of its words one after the other. Words are found by
    byte masks and told apart by 64-bit hashes; only words not seen before are encoded.
    A text with a control word of the tokenizer, which may stand inside a word, is
    encoded as a whole.
    """

    def __init__(self, path: str):
        # Spark runs a task per core: threads of the tokenizer's own would only hold memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Control words that come from lower-casing are plain text.
        self.tokenizer.encode_special_tokens = True
        self.control = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        # Known words by hash in order: where their ids begin in the pool, and how many.
        self.known = np.empty(0, np.uint64)
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 20, np.uint32), 0

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words one after the other, and how many each has."""
        texts = [w.decode() for w in words]
        # Words of ASCII letters end with one id that says so: many are encoded as one text.
        if all(map(bytes.isalpha, words)):
            flat, _ = self.encoded([" ".join(texts[k : k + 500]) for k in range(0, len(texts), 500)], ENCODED_AT_ONCE // 500)
            ends = np.flatnonzero(self.last[flat])
            if len(ends) == len(words):
                return flat, np.diff(ends, prepend=-1)
        return self.encoded(texts, ENCODED_AT_ONCE)

    def encoded(self, texts: list[str], at_once: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after the other, and how many each has."""
        parts = [np.empty(0, np.uint32)]
        for k in range(0, len(texts), at_once):
            parts += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[k : k + at_once], add_special_tokens=False)]
        return np.concatenate(parts), np.fromiter(map(len, parts[1:]), np.int64, len(texts))

    def whole(self, text: str) -> list[int]:
        """Ids of a text whose control words count as such."""
        self.tokenizer.encode_special_tokens = False
        try:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        finally:
            self.tokenizer.encode_special_tokens = True

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        letters = np.fromiter(map(bytes.isalpha, words), bool, len(words))
        order = np.argsort(letters, kind="stable")
        words, other = [words[k] for k in order], int((~letters).sum())
        flat, lengths = (np.concatenate(x) for x in zip(*(self.ids_of(part) for part in (words[:other], words[other:])), strict=True))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.starts, self.lengths = np.insert(self.starts, at, starts[back]), np.insert(self.lengths, at, lengths[back])

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, the end included."""
        if len(self.known) > CACHED_WORDS:
            self.reset()
        raw = data.tobytes()
        special = [k for c in self.control for k in _places(raw, c)]
        special = {int(np.searchsorted(bounds, k, "right")) - 1 for k in special}
        data = LOWER[data]
        starts, ends = words_of(data, bounds)
        hashes, first, at = np.unique(SpanHashes(data)(starts, ends), return_index=True, return_inverse=True)
        known = np.zeros(len(hashes), bool)
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            known = self.known[place] == hashes
        if not known.all():
            lower = data.tobytes()
            new = first[~known]
            self.learn(hashes[~known], [lower[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        place = np.searchsorted(self.known, hashes)[at] if len(at) else at
        lengths = self.lengths[place]
        after = np.cumsum(lengths)
        total = int(after[-1]) if len(after) else 0
        ids = self.pool[np.repeat(self.starts[place] - after + lengths, lengths) + np.arange(total)]
        cuts = np.concatenate([[0], after])[np.searchsorted(starts, bounds)].tolist()
        end = np.array([EOS], np.uint32)
        out = [np.concatenate([ids[a:b], end]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in special:
            text = raw[bounds[k] : bounds[k + 1]].decode()
            out[k] = np.array([*self.whole(text), EOS], np.uint32)
        return out


def _places(data: bytes, part: bytes) -> Iterator[int]:
    at = data.find(part)
    while at >= 0:
        yield at
        at = data.find(part, at + 1)


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words. A full stop or comma between a letter and a blank is a
    token of its own either way, so it is a word of its own: fewer words are new."""
    starts, ends = spans(data, bounds)
    if not len(starts):
        return starts, ends
    cut = np.flatnonzero((ends - starts > 1) & _STOP[data[ends - 1]] & _LETTER[data[ends - 2]])
    more = np.insert(starts, cut + 1, ends[cut] - 1)
    ends = np.insert(ends, cut, ends[cut] - 1)
    return more, ends


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process, kept over its tasks."""
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


class Packer:
    """Bounded-space best fit. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.open: list[list] = []  # [gap, pieces]
        self.closed: list[list] = []  # pieces of each

    def place(self, pieces: list[tuple]) -> None:
        """Pieces that stay together if they fit somewhere. They come less full than a window."""
        size = sum(len(p[2]) for p in pieces)
        while size:
            fits = [w for w in self.open if w[0] >= size]
            if fits:
                window = min(fits, key=lambda w: w[0])
                window[0] -= size
                window[1] += pieces
                if not window[0]:
                    self.close(window)
                return
            if len(self.open) < self.windows:
                self.open.append([self.capacity, []])
                continue
            window = min(self.open, key=lambda w: w[0])
            if window[0] >= MIN_CUT:
                head, pieces = cut(pieces, window[0])
                window[1] += head
                size -= window[0]
            self.close(window)

    def close(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.closed.append(window[1])

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for k in range(0, whole, self.capacity):
            self.closed.append([(doc_id, k, ids[k : k + self.capacity], len(ids))])
        if whole < len(ids):
            self.place([(doc_id, whole, ids[whole:], len(ids))])


def cut(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``size`` ids of the pieces, and the rest."""
    head, k = [], 0
    while size:
        doc_id, start, ids, total = pieces[k]
        if len(ids) > size:
            head.append((doc_id, start, ids[:size], total))
            return head, [(doc_id, start + size, ids[size:], total), *pieces[k + 1 :]]
        head.append(pieces[k])
        size -= len(ids)
        k += 1
    return head, pieces[k:]


def table_of(windows: list[list], numbers: list[int], partition: int, is_open: bool) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "partition", "window", "offset", "open")}
    for number, pieces in zip(numbers, windows, strict=True):
        offset = 0
        for doc_id, start, ids, total in pieces:
            for name, value in zip(out, (doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, partition, number, offset, is_open), strict=True):
                out[name].append(value)
            offset += len(ids)
    return out


def pack_partitions(documents: DataFrame, tokenizer: str, capacity: int, windows: int) -> DataFrame:
    schema = pa.schema(
        [(k, pa.int64()) for k in ("doc_id", "start", "length")]
        + [("ids", pa.binary())]
        + [(k, pa.int64()) for k in ("doc_tokens", "partition", "window", "offset")]
        + [("open", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        encoder, packer = word_ids(tokenizer), Packer(capacity, windows)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, data, bounds in chunks(batch.column("text"), PART_BYTES):
                for k, tokens in enumerate(encoder.encode(data, bounds), first):
                    packer.add(ids[k], tokens)
                done, packer.closed = packer.closed, []
                yield pa.RecordBatch.from_pydict(table_of(done, range(number, number + len(done)), partition, False), schema)
                number += len(done)
        left = [pieces for _, pieces in packer.open]
        yield pa.RecordBatch.from_pydict(table_of(left, range(number, number + len(left)), partition, True), schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"{PIECE}, {WINDOW}")


def merge_windows(left: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Leftover windows of a few partitions, best fit in order of size; then those that
    are still not full are cut to full sequences. The rest is cut to powers of two,
    which need no padding."""
    old: dict[tuple, list] = {}
    for r in left.sort_values(["partition", "window", "offset"]).itertuples():
        doc_id = None if pd.isna(r.doc_id) else int(r.doc_id)
        old.setdefault((r.partition, r.window), []).append((doc_id, r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens))
    packer = Packer(capacity, len(old) + 1)
    for pieces in sorted(old.values(), key=lambda ps: -sum(len(p[2]) for p in ps)):
        packer.place(pieces)
    done, rest = packer.closed, []
    for gap, pieces in packer.open:
        if gap < MIN_CUT:
            done.append(pieces)
        else:
            rest += pieces
    size = sum(len(p[2]) for p in rest)
    while size:
        part = capacity if size >= capacity else 1 << (size.bit_length() - 1)
        head, rest = cut(rest, part)
        done.append(head)
        size -= part
    # New sequences keep to numbers of one partition, beyond those it has used itself.
    partition, number = int(left["partition"].min()), int(left["window"].max()) + (1 << 30)
    out = table_of(done, range(number, number + len(done)), partition, False)
    return pd.DataFrame(out).astype({"doc_id": "Int64"})


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all
    documents' ids; ``ids`` holds little-endian unsigned 32-bit numbers.

    Each partition keeps ``windows`` open windows. A document fills whole sequences
    first; what is left goes to the window it fits best. Where it fits none, the fullest
    is filled with its head and closed, or closed with less than ``MIN_CUT`` ids of
    padding. Leftover windows are merged, some partitions per task, so memory is
    bounded by windows and by the longest text, not by the number of documents. A sequence is padded to ``capacity`` unless
    its length is a power of two.

    A null text gives the end id alone; ids may be null or repeated, and a row that
    repeats has pieces of its own; other columns are ignored; an empty table gives no
    rows. Words are told apart by 64-bit hashes. Pieces are written before they are merged, so
    numbers stay the same when a task is run again.
    """
    import_in_workers(documents.sparkSession)
    with arrow_batches(documents.sparkSession, BATCH_BYTES):
        pieces = saved(pack_partitions(documents, tokenizer, capacity, windows))
    group = F.floor(F.col("partition") / MERGED_PARTITIONS)
    merged = pieces.where("open").groupBy(group).applyInPandas(lambda left: merge_windows(left, capacity), f"{PIECE}, {WINDOW}")
    sequence = F.shiftleft(F.col("partition"), 32) + F.col("window")
    return pieces.where("not open").unionByName(merged).select(
        "doc_id", "start", "length", "ids", "doc_tokens", sequence.alias("sequence_id"), "offset"
    )


def packing_digest(documents: DataFrame, tokenizer: str) -> DataFrame:
    out = pack(documents.select("doc_id", "text"), tokenizer)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
