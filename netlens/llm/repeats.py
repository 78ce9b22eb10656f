"""Repeated passages: merged Burrows-Wheeler transforms of shards.

A 200-byte string that starts twice is found in three steps. Anchors (the smallest hash
of a 64-byte gram in each window of 200 bytes) meet by their hash, which leaves only the
pieces of text around grams that occur twice. Pieces with one anchor but different bytes
go to buckets by anchor. A bucket sorts its pieces in shards, each shard gives its
Burrows-Wheeler transform, and the transforms are merged by refining their interleave:
round h orders all suffixes by their first h symbols from the order of round h - 1, and
what becomes distinct then has a common prefix of h - 1 symbols. Intervals that are still
one block after the last round are the repeated strings.

The transforms are over symbols of 50 bytes, so 4 rounds reach 200 bytes: a piece is 50
strings, one for each remainder of a position by 50, and has a suffix at every byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import discard, import_in_workers, saved
from netlens.llm.wordhash import SpanHashes, chunks, mix

LENGTH = 200
GRAM = 64
SYMBOL = 50
# Positions looked at in one go; longer texts come in parts that overlap.
PART = 1 << 19
# Bytes of a bucket, in the mean, and suffixes of a shard.
BUCKET_BYTES = 1 << 20
SHARD_ROWS = 1 << 18
# An anchor with more different pieces than this isn't given to one task: its windows
# are counted one by one.
HOT = 20_000

OCCURRENCES = "key long, doc_id long, anchor long, seg long, start int, len int"
RUNS = "anchor long, seg long, low int, high int"


def smallest_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    n = len(values) - width + 1
    pad = np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)
    blocks = np.concatenate([values, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, end, anchor, seg) of the pieces of some texts: runs of windows that
    choose the same anchor, with hashes of the anchor and of the piece. Equal windows
    choose the anchor at the same place, whatever is around them."""
    gram = min(GRAM, LENGTH)
    for first in range(0, len(data) - LENGTH + 1, PART):
        part = data[first : first + PART + LENGTH - 1]
        hashes = SpanHashes(part)
        at = np.arange(len(part) - gram + 1)
        grams = hashes(at, at + gram)
        place = np.uint64(2 * PART - 1)
        chosen = smallest_in_windows((grams & ~place) | at.astype(np.uint64), LENGTH - gram + 1)
        chosen = (chosen & place).astype(np.int64)
        window = np.arange(len(chosen))
        text = np.searchsorted(bounds, window + first, "right") - 1
        inside = np.flatnonzero(window + first + LENGTH <= bounds[text + 1])
        if not len(inside):
            continue
        chosen, text = chosen[inside], text[inside]
        new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]))
        last = np.append(new[1:], len(inside)) - 1
        start, end = inside[new], inside[last] + LENGTH
        yield text[new], start + first - bounds[text[new]], end + first - bounds[text[new]], grams[chosen[new]], hashes(start, end)


def occurrences(rows: DataFrame) -> DataFrame:
    """The pieces of all texts, see ``pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in chunks(batch.column("text")):
                for text, start, end, anchor, seg in pieces(data, bounds):
                    text = pa.array(text + first)
                    columns = [batch.column("key").take(text), batch.column("doc_id").take(text)]
                    columns += [pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64))]
                    columns += [pa.array(start.astype(np.int32)), pa.array((end - start).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "anchor", "seg", "start", "len"])

    return rows.mapInArrow(run, OCCURRENCES)


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable order of small numbers: one pass by 16 bits, or two."""
    if not len(values) or int(values.max()) < 1 << 16:
        return np.argsort(values.astype(np.uint16), kind="stable")
    low = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((values >> 16).astype(np.uint16)[low], kind="stable")]


def symbols_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rows): the number of the symbol that starts at each byte, from 1 in the order
    of hashes, 0 where less than a symbol is left. A text of m bytes has m + 1 rows, the
    last for its end; ``rows`` says where texts begin."""
    lengths = np.diff(bounds)
    rows = np.concatenate([[0], np.cumsum(lengths + 1)])
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    at = np.arange(rows[-1]) - rows[owner]
    whole = np.flatnonzero(at + SYMBOL <= lengths[owner])
    start = at[whole] + bounds[owner[whole]]
    hashes = SpanHashes(data)(start, start + SYMBOL)
    symbols = np.zeros(rows[-1], np.int64)
    symbols[whole] = np.unique(hashes, return_inverse=True)[1] + 1
    return symbols, rows


def ranked_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = stable_order(b)
    order = order[stable_order(a[order])]
    new = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    rank = np.empty(len(a), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(new)])
    return rank


def transform(symbols: np.ndarray, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(bwt, suffixes) of one shard: its suffixes in the order of their first ``depth``
    symbols, and the symbol before each (0 at the beginning of a string)."""
    end = np.repeat(rows[1:], np.diff(rows))
    at = np.arange(len(symbols))
    rank, known = symbols, 1
    while known < depth:
        step = min(known, depth - known) * SYMBOL
        then = at + step
        rank = ranked_pairs(rank, np.where(then < end, rank[np.minimum(then, len(rank) - 1)], 0))
        known += step // SYMBOL
    suffixes = stable_order(rank)
    before = suffixes - SYMBOL
    begin = np.repeat(rows[:-1], np.diff(rows))
    return np.where(before >= begin[suffixes], symbols[np.maximum(before, 0)], 0), suffixes


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, common): the rows of all transforms (numbered one transform after the other) in
    the order of their first ``depth`` symbols, and how many of these each has in common
    with the row before. Only the transforms are read: no suffix is compared.

    Row r of a block with a common prefix P gives its symbol c to the block cP; the
    order inside a transform is known, so a round has only to say which transform the
    next row of each place is from. Ends of strings stay one block.
    """
    bwt = np.concatenate(transforms)
    owner = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms])
    rows, common = np.arange(len(bwt)), np.full(len(bwt), depth, np.int64)
    block = np.zeros(len(bwt), np.int64)
    for known in range(depth):
        symbol = bwt[rows]
        order = stable_order(symbol)
        symbol, old = symbol[order], block[order]
        new = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | ((old[1:] != old[:-1]) & (symbol[1:] > 0))])
        common[new & (common == depth)] = known
        block = np.cumsum(new)
        # The interleave: a place takes the next row of its transform.
        interleave = owner[rows[order]]
        rows = stable_order(interleave)
        place = np.empty_like(rows)
        place[rows] = np.arange(len(rows))
        rows = place
    return rows, common


def repeated_windows(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of windows of LENGTH bytes that occur at another start in ``data``, too; no
    window goes over a bound."""
    depth = LENGTH // SYMBOL
    symbols, rows = symbols_of(data, bounds)
    cuts, transforms, suffixes = [0], [], []
    while cuts[-1] < len(bounds) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(rows, rows[cuts[-1]] + SHARD_ROWS, "right")) - 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        bwt, order = transform(symbols[rows[a] : rows[b]], rows[a : b + 1] - rows[a], depth)
        transforms.append(bwt)
        suffixes.append(order + rows[a])
    merged, common = merge(transforms, depth)
    same = np.append(common[1:] >= depth, False)
    same[1:] |= common[1:] >= depth
    at = np.concatenate(suffixes)[merged[same]]
    # From rows (one more per text) back to bytes; what runs into an end is no window.
    text = np.searchsorted(rows, at, "right") - 1
    at = at - text
    return np.sort(at[at + LENGTH <= bounds[text + 1]])


def runs_in_bucket(bucket: pd.DataFrame) -> pd.DataFrame:
    """Runs (anchor, seg, low, high) of repeated windows in the pieces of a bucket."""
    bucket = bucket.drop_duplicates(["anchor", "seg"])
    texts = bucket["bytes"].tolist()
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    at = repeated_windows(np.frombuffer(b"".join(texts), np.uint8), bounds)
    text = np.searchsorted(bounds, at, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(text) != 0)])) if len(at) else at
    last = np.append(new[1:], len(at)) - 1 if len(at) else at
    owner = text[new]
    return pd.DataFrame(
        {
            "anchor": bucket["anchor"].to_numpy()[owner], "seg": bucket["seg"].to_numpy()[owner],
            "low": (at[new] - bounds[owner]).astype(np.int32), "high": (at[last] - bounds[owner]).astype(np.int32),
        }
    )


def runs_of_hot(hot: DataFrame) -> DataFrame:
    """The same for pieces of anchors too frequent for a bucket: each window by itself, in
    128 bits, counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("bytes")
            for first, flat, bounds in chunks(data):
                at = np.arange(len(flat) - LENGTH + 1)
                text = np.searchsorted(bounds, at, "right") - 1
                keep = at + LENGTH <= bounds[text + 1]
                at, text = at[keep], text[keep]
                hashes = SpanHashes(flat)
                half = LENGTH // 2
                two = (hashes(at, at + LENGTH), mix(hashes(at, at + half) * np.uint64(3) + hashes(at + half, at + LENGTH)))
                rows = pa.array(text + first)
                columns = [batch.column("anchor").take(rows), batch.column("seg").take(rows), pa.array((at - bounds[text]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(h.view(np.int64)) for h in two)], names=["anchor", "seg", "low", "h1", "h2"])

    once = hot.dropDuplicates(["anchor", "seg"])
    windows = saved(once.mapInArrow(run, "anchor long, seg long, low int, h1 long, h2 long"))
    often = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return windows.join(often, ["h1", "h2"], "left_semi").select("anchor", "seg", "low", F.col("low").alias("high"))


def piece_bytes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, seg, d, bytes) of the wanted pieces (key, doc, start, len, anchor, seg, d), cut
    out of the texts that hold them."""
    lists = saved(wanted.groupBy("key", "doc").agg(F.collect_list(F.struct("start", "len", "anchor", "seg", "d")).alias("cuts")))
    lists = lists.withColumnsRenamed({"key": "k", "doc": "d"})
    texts = rows.join(lists, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, cuts in zip(batch.column("text"), batch.column("cuts"), strict=True):
                data = text.as_py().encode()
                found = cuts.values.flatten()
                cut = [data[a : a + n] for a, n in zip(found[0].to_pylist(), found[1].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*found[2:], pa.array(cut, pa.binary())], names=["anchor", "seg", "d", "bytes"])

    return texts.select("text", "cuts").mapInArrow(run, "anchor long, seg long, d long, bytes binary")


def repeated_runs(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(anchor, seg, low, high): the runs of repeated windows of every piece. ``found`` are
    the pieces whose anchors occur twice."""
    spark = rows.sparkSession
    # min and count of numbers: a hash aggregate that combines before the shuffle.
    segs = found.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("rep"), F.min("len").alias("len"))
    segs = saved(segs)
    whole = segs.where("c > 1").select("anchor", "seg", F.lit(0).alias("low"), (F.col("len") - LENGTH).alias("high"))
    kinds = saved(segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("d")).where("d > 1"))
    mixed = saved(segs.join(kinds, "anchor"))
    reps = mixed.select("anchor", "seg", "rep", "d")
    places = found.join(reps, (found["anchor"] == reps["anchor"]) & (found["seg"] == reps["seg"]) & (found["key"] == reps["rep"]))
    places = places.groupBy(found["anchor"], found["seg"]).agg(
        F.min_by(F.struct("key", F.col("doc_id").alias("doc"), "start", "len", "d"), F.struct(F.col("doc_id").isNull(), "doc_id", "start")).alias("p")
    )
    # A piece that occurs twice is repeated as a whole, but others may share windows with it.
    cut = saved(piece_bytes(rows, places.select("anchor", "seg", "p.*")))
    total = cut.agg(F.sum(F.length("bytes")).alias("n")).first()["n"] or 0
    buckets = F.pmod(F.xxhash64("anchor"), F.lit(int(total // BUCKET_BYTES) + 1))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cool = cut.where(F.col("d") <= HOT).withColumn("bucket", buckets).repartition(tasks, "bucket")
    runs = cool.groupBy("bucket").applyInPandas(runs_in_bucket, RUNS)
    if not mixed.where(F.col("d") > HOT).isEmpty():
        runs = runs.unionByName(runs_of_hot(cut.where(F.col("d") > HOT)))
    once = segs.where("c = 1").select("anchor", "seg")
    runs = saved(runs)
    runs = runs.join(once, ["anchor", "seg"], "left_semi").unionByName(whole)
    out = saved(runs)
    discard(mixed, cut, segs, kinds)
    return out


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(key, spans): per text the bytes covered by repeated strings, as (low, high) that may
    overlap. Texts without any are left out."""
    every = saved(occurrences(rows))
    # Saved, so that the join deals both sides anew and a frequent anchor can be split.
    twice = saved(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"))
    found = saved(every.join(twice, "anchor", "left_semi"))
    discard(every, twice)
    runs = repeated_runs(rows, found)
    spans = found.join(runs, ["anchor", "seg"]).select(
        "key", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") + LENGTH).alias("high")
    )
    # Copies of a text give the same spans: a set combines them before the shuffle.
    out = saved(spans.groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("spans")))
    discard(found, runs)
    return out


def without_spans(texts: pa.Array, spans: pa.Array) -> tuple[list[bytes], list[int], list[int]]:
    """Kept bytes, removed bytes and maximal removed runs of each text."""
    kept, removed, runs = [], [], []
    for text, of in zip(texts.cast(pa.binary()), spans, strict=True):
        data, n, count = text.as_py() or b"", 0, 0
        if of.is_valid:
            low, high = (x.to_numpy() for x in of.values.flatten())
            order = np.argsort(low, kind="stable")
            low, high = low[order], np.maximum.accumulate(high[order])
            new = np.concatenate([[True], low[1:] > high[:-1]])
            starts, ends = low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(high) - 1)]
            n, count = int((ends - starts).sum()), len(starts)
            data = b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))
        kept.append(data)
        removed.append(n)
        runs.append(count)
    return kept, removed, runs


def without_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): per document its UTF-8 bytes less every
    byte covered by a string of LENGTH bytes that starts anywhere else, too, in the same
    document or another; overlaps count. ``kept`` may end inside a character.

    A null text is empty; texts below LENGTH bytes keep all. Ids may be null or repeated
    and rows that repeat are documents of their own, so both lose what they share. Other
    columns are ignored; an empty table gives no rows. Strings are judged on the input.
    A document of any length is read in parts; pieces around rare grams never leave
    their task, equal pieces are counted, and only different pieces around one gram are
    sent on as bytes. Pieces are told apart by 128 bits, texts by 64.
    """
    import_in_workers(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.xxhash64(text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    spans = repeated_spans(rows)
    both = rows.join(spans.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            kept, removed, runs = without_spans(texts, batch.column("spans"))
            lengths = [len(k) + r for k, r in zip(kept, removed, strict=True)]
            columns = [batch.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (lengths, removed, runs))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return both.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def repeat_digest(documents: DataFrame) -> DataFrame:
    out = without_repeats(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
