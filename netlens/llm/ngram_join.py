"""N-gram Jaccard join: grouped prefix join over sets of word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm.common import discard, forget_shuffles, import_in_workers, join_checked, saved, small
from netlens.llm.components import components
from netlens.llm.wordhash import parities, set_key, shingle_sets

SHINGLE = 5
# Two sets link if 100 * shared >= PERCENT * all.
PERCENT = 80
# Frequent shingles come last in the order of the prefixes. It decides about work, never
# about links: a task counts exactly until it holds this many, then forgets the rarest.
COUNTED = 1_000_000
SEEN_IN_TASK = 3
SEEN = 5
ORDERED = 1_000_000
# Buckets up to this size give all their pairs; larger ones are searched in cells of at
# most so many rows a side, which give a forest of pairs.
SMALL = 8
CELL_ROWS = 2048
# Shingles of a side of a cell in which links are counted, in the mean.
CELL_SHINGLES = 2_000_000
# A pair is near the threshold if its sets, judged by their bitmaps, differ in more than
# this share of the hashes that sets that link may differ in. Each component gives so many of them in the first
# round and eight times as many in each further one, so that rounds stay few.
NEAR, NEAR_PAIRS = 0.95, 32
# Bits of the bitmaps that rule out pairs before sets are fetched. Pairs of sets that are
# not larger than the folded bitmap are compared on that one.
BITS, FOLDED = 4096, 1024
# The index is made in so many passes over the prefixes, one after the other: disk holds
# the shuffles of one only.
PASSES = 4

PARTS = [f"prefix_{k}" for k in range(PASSES)]
SETS = "doc_id long, text_hash long, n long, key long, gid long, bits array<long>, " + ", ".join(f"{p} array<struct<pos: int, bucket: long>>" for p in PARTS)


def _rows(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent shingles in order, and the magnitude of their counts.
    Every task counts all its distinct sets; what is frequent in one is summed up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        seen: set[int] = set()
        waiting: list[np.ndarray] = []

        def add(hashes, counts):
            fresh, times = np.unique(np.concatenate([hashes[:0], *waiting]), return_counts=True)
            every, weight = np.concatenate([hashes, fresh]), np.concatenate([counts, times])
            waiting.clear()
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
            every, weight = every[first], np.add.reduceat(weight, first) if len(first) else weight
            if len(every) > COUNTED:
                stay = weight > np.partition(weight, len(weight) - COUNTED)[len(weight) - COUNTED]
                every, weight = every[stay], weight[stay]
            return every, weight

        for batch in batches:
            for shingles in shingle_sets(batch.column("text"), SHINGLE):
                key = set_key(shingles)
                if key not in seen:
                    if len(seen) < COUNTED:
                        seen.add(key)
                    waiting.append(shingles)
                if sum(map(len, waiting[-1:])) and len(waiting) >= 2000:
                    hashes, counts = add(hashes, counts)
        hashes, counts = add(hashes, counts)
        often = counts >= SEEN_IN_TASK
        yield pa.RecordBatch.from_pydict({"h": hashes[often].view(np.int64), "c": counts[often]})

    found = rows.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= SEEN)
    top = found.orderBy(F.col("c").desc(), "h").limit(ORDERED).toPandas()
    hashes = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.log2(top["c"].to_numpy(np.float64).clip(1)).astype(np.int8)[order]


def dealt(prefixes: list[np.ndarray]) -> list[pa.Array]:
    """For each pass the (pos, bucket) that fall on it, per prefix."""
    lengths = [len(p) for p in prefixes]
    every = np.concatenate([np.empty(0, np.uint64), *prefixes])
    owner = np.repeat(np.arange(len(prefixes)), lengths)
    pos = np.arange(len(every)) - np.repeat(np.cumsum([0, *lengths])[:-1], lengths)
    out = []
    for k in range(PASSES):
        mine = every % np.uint64(PASSES) == k
        ends = np.cumsum(np.bincount(owner[mine], minlength=len(prefixes)))
        rows = pa.StructArray.from_arrays([pa.array(pos[mine], pa.int32()), pa.array(every[mine].view(np.int64))], names=["pos", "bucket"])
        out.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), rows))
    return out


def prefix_sets(rows: DataFrame) -> DataFrame:
    """Per document: size and key of its set, its first shingles in the order (rarest
    first, then by hash), and its group: sets of one size with the same prefix. Any set
    that links shares a shingle of the prefix, size - ceil(0.8 * size) + 1 long. The
    prefix itself is given with the first document of a group in a task, dealt out over
    the passes by hash, each shingle with its position."""
    spark = rows.sparkSession
    hot = spark.sparkContext.broadcast(frequent_shingles(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level = hot.value
        given: set[int] = set()
        for batch in batches:
            out: dict[str, list] = {"n": [], "key": [], "gid": [], "bits": []}
            given_now: list[np.ndarray] = []
            for shingles in shingle_sets(batch.column("text"), SHINGLE):
                n = len(shingles)
                size = n - (PERCENT * n + 99) // 100 + 1 if n else 0
                if len(often):
                    at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
                    levels = np.where(often[at] == shingles, level[at] + 1, 0)
                    prefix = shingles[np.lexsort((shingles, levels))[:size]] if levels[:size].any() or levels.any() else shingles[:size]
                else:
                    prefix = shingles[:size]
                gid = set_key(np.append(prefix, np.uint64(n)))
                out["n"].append(n)
                out["key"].append(set_key(shingles))
                out["gid"].append(gid)
                out["bits"].append(parities(shingles, BITS))
                given_now.append(prefix[:0] if gid in given else prefix)
                if len(given) < COUNTED:
                    given.add(gid)
            columns = [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(out[k], pa.int64()) for k in ("n", "key", "gid"))]
            columns += [pa.array(out["bits"], pa.list_(pa.int64())), *dealt(given_now)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", *out, *PARTS])

    return rows.mapInArrow(run, SETS)


def sets_of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, shingles) of the sets in ``keys`` (key, rep, rep_hash), made again from the
    texts of their representatives."""
    reps = keys.select(F.col("rep").alias("r"), F.col("rep_hash").alias("rh"))
    texts = join_checked(rows, reps, F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("text_hash") == F.col("rh")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()  # rows that repeat a representative
        for batch in batches:
            found = []
            for s in shingle_sets(batch.column("text"), SHINGLE):
                key = set_key(s)
                if key not in given:
                    found.append((key, s.view(np.int64)))
                    given.add(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))], names=["key", "shingles"]
            )

    return texts.select("text").mapInArrow(run, "key long, shingles array<long>")


def folded(bits: Column) -> Column:
    """A bitmap of FOLDED bits, the parities of the same set. One of that length stays."""
    words = FOLDED // 64
    parts = [F.slice(bits, k * words + 1, words) for k in range(BITS // FOLDED)]
    out = parts[0]
    for part in parts[1:]:
        out = F.zip_with(out, part, lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > words, out).otherwise(bits)


def possible(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of set keys those whose bitmaps leave enough in common. Sets
    far larger than the bitmap are hardly ruled out; no set that links is."""
    bits = members.select("key", "n", F.when(F.col("n") <= FOLDED, folded(F.col("bits"))).otherwise(F.col("bits")).alias("bits"))
    if small(pairs):
        # Later rounds have few pairs: don't shuffle the bitmaps of all sets for them.
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        bits = saved(bits.join(F.broadcast(keys), "key", "left_semi"))
    a = bits.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    b = bits.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")

    def differing(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, c: s + c)

    same = F.size("ba") == F.size("bb")
    differ = F.when(same, differing(F.col("ba"), F.col("bb"))).otherwise(differing(folded(F.col("ba")), folded(F.col("bb"))))
    total = F.col("na") + F.col("nb")
    # shared <= (total - differ) / 2 and union = total - shared
    return both.where(100 * (total - differ) >= PERCENT * (total + differ)).select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of set keys those whose sets link."""
    pairs = saved(possible(pairs, members))
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    keys = saved(keys.join(members.select("key", "rep", "rep_hash"), "key"))
    sets = saved(sets_of(rows, keys))
    a = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    found = both.where(100 * shared >= PERCENT * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct()
    found = saved(found)
    discard(pairs, keys, sets)
    return found


def _sizes_fit(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Adds ``comp`` to rows with a set ``key``: the component known so far."""
    if roots is None:
        return rows.withColumn("comp", F.col("key"))
    return rows.join(roots, F.col("key") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "key")).drop("node", "root")


def elsewhere(buckets: list[np.ndarray], bucket: int) -> np.ndarray:
    """Which pairs of a cell's sets meet in a bucket with a smaller number, too: they are
    compared there. ``buckets`` has the large buckets of each set."""
    lengths = [len(b) for b in buckets]
    every, owner = np.concatenate(buckets), np.repeat(np.arange(len(buckets)), lengths)
    smaller = every < bucket
    numbers, column, counts = np.unique(every[smaller], return_inverse=True, return_counts=True)
    owner, shared = owner[smaller], np.cumsum(counts > 1) - 1
    both = counts[column] > 1
    owner, column = owner[both], shared[column[both]]
    met = np.zeros((len(buckets), len(buckets)), bool)
    width = int((counts > 1).sum())
    for first in range(0, width, 1024):
        part = (column >= first) & (column < first + 1024)
        has = np.zeros((len(buckets), min(1024, width - first)), np.float32)
        has[owner[part], column[part] - first] = 1
        met |= has @ has.T > 0
    return met


def forest(cell: pd.DataFrame, near: int) -> pd.DataFrame:
    """Pairs (a, b) of a cell's sets that connect components, as far as bitmaps and sizes
    allow: a forest of those that are likely to link, the nearest first, and
    for each component left the ``near`` nearest that may just miss the threshold."""
    none = pd.DataFrame({"bucket": [], "a": [], "b": []}, dtype=np.int64)
    parts, comp = np.unique(cell["comp"].to_numpy(), return_inverse=True)
    if len(parts) == 1:
        return none
    key, n, chunk = (cell[c].to_numpy(np.int64) for c in ("key", "n", "chunk"))
    met = elsewhere(cell["buckets"].tolist(), cell["bucket"].iat[0])
    bits = np.array(cell["bits"].tolist(), np.int64).view(np.uint64)
    coarse = np.bitwise_xor.reduce(bits.reshape(len(bits), BITS // FOLDED, -1), axis=1)
    failed = cell["failed"].tolist()
    across = chunk.min() != chunk.max()
    found = []
    place = np.arange(len(key))
    for first in range(0, len(key), 256):
        block = slice(first, first + 256)
        may = ~met[block] & (comp[block, None] != comp) & (place[block, None] < place)
        if across:
            may &= chunk[block, None] != chunk
        for k in range(first, min(first + 256, len(key))):
            if failed[k] is not None:
                may[k - first] &= ~np.isin(key, failed[k])
        left, right = np.nonzero(may)
        left += first
        fits = 100 * np.minimum(n[left], n[right]) >= PERCENT * np.maximum(n[left], n[right])
        left, right = left[fits], right[fits]
        for part in (coarse, bits):
            differ = np.bitwise_count(part[left] ^ part[right]).sum(axis=1, dtype=np.int64)
            total = n[left] + n[right]
            good = 100 * (total - differ) >= PERCENT * (total + differ)
            if part is coarse:
                left, right = left[good], right[good]
        found.append(np.stack([left[good], right[good], differ[good]]))
    left, right, differ = np.concatenate(found, axis=1)
    if not len(left):
        return none
    # Hashes that fall on one bit hide each other: as many differ as this many bits mean.
    likely = np.log1p(-2 * np.minimum(differ, BITS // 2 - 1) / BITS) / np.log1p(-2 / BITS)
    share = likely * (100 + PERCENT) / ((100 - PERCENT) * (n[left] + n[right]))
    order = np.argsort(share, kind="stable")
    left, right, share = left[order], right[order], share[order]
    near_left, near_right = left[share > NEAR], right[share > NEAR]
    left, right = left[share <= NEAR], right[share <= NEAR]
    root = np.arange(len(parts))
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while len(left):
        # The nearest pair of each component joins it to another one.
        for k in np.unique(comp[left], return_index=True)[1]:
            x, y = find(comp[left[k]]), find(comp[right[k]])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((key[left[k]], key[right[k]]))
        comp = np.array([find(x) for x in range(len(parts))])[comp]
        apart = comp[left] != comp[right]
        left, right = left[apart], right[apart]
    apart = comp[near_left] != comp[near_right]
    near_left, near_right = near_left[apart], near_right[apart]
    ends = pd.Series(np.stack([comp[near_left], comp[near_right]], axis=1).ravel())
    chosen = (ends.groupby(ends).cumcount().to_numpy().reshape(-1, 2) < near).any(axis=1)
    out += zip(key[near_left[chosen]], key[near_right[chosen]], strict=True)
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pd.DataFrame({"bucket": cell["bucket"].iat[0], "a": pairs.min(axis=1), "b": pairs.max(axis=1)})


def _search(near: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda cell: forest(cell, near)


def _passes(spark: SparkSession) -> Iterator[int]:
    for k in range(PASSES):
        yield k
        forget_shuffles(spark)


def _index(sets: DataFrame, k: int) -> DataFrame:
    """(bucket, gid, pos): the shingles of pass ``k`` in the prefixes of two groups."""
    index = sets.select("gid", F.inline(PARTS[k]))
    buckets = index.groupBy("bucket").agg(F.min("gid").alias("g1"), F.max("gid").alias("g2")).where("g1 <> g2").select("bucket")
    # Two tasks may both give a group's prefix.
    return index.join(buckets, "bucket").select("bucket", "gid", "pos").distinct()


def set_links(rows: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) between different sets, enough of them to connect what is connected.

    Copies are one set, sets with one prefix and size one group. The index has a row per
    group and shingle of its prefix; only shingles of two groups are buckets, and a
    group of several sets is a bucket, too. Small buckets give all their pairs. A large
    one gives a forest: pairs that would connect its components if all that bitmaps
    allow links, and some near misses; sets that meet in several large buckets are
    compared in one of them. Whatever was given is compared exactly, what links joins
    components, what doesn't is remembered, and large buckets are searched again until
    none gives a pair. So what a bucket gives grows with its rows, whatever is in it,
    and in the end no two sets in different components can link.
    """
    spark = rows.sparkSession
    forget_shuffles(spark)
    indexes = [saved(_index(sets, k)) for k in _passes(spark)]
    index = reduce(DataFrame.unionByName, indexes)
    large = members.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gid")
    place = index.join(members.select("gid", "key", "n"), "gid").select("bucket", "key", "n", "pos")
    own = members.join(large, "gid").select(F.col("gid").alias("bucket"), "key", "n", F.lit(-1).alias("pos"))
    place = saved(place.unionByName(own))
    discard(*indexes)
    sizes = place.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    sized = saved(place.join(sizes, "bucket"))
    discard(place)
    forget_shuffles(spark)

    few = sized.where(F.col("c") <= SMALL)
    x = few.select("bucket", F.col("key").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    y = few.select("bucket", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = (F.col("pa") < 0) | (PERCENT * (F.col("na") + F.col("nb")) <= (100 + PERCENT) * room)
    meet = x.join(y, "bucket").where((F.col("a") < F.col("b")) & _sizes_fit(F.col("na"), F.col("nb")) & fits)
    pairs = saved(meet.select("a", "b").distinct())

    large = sized.where(F.col("c") > SMALL).select("bucket", "key", "n", "c")
    # A set has no more buckets than shingles in its prefix.
    lists = large.groupBy("key").agg(F.collect_list("bucket").alias("buckets")).join(members.select("key", "bits"), "key")
    many = saved(large.join(lists, "key"))
    chunks = F.ceil(F.col("c") / CELL_ROWS).cast("int")
    many = many.withColumn("chunk", F.pmod(F.xxhash64("key"), chunks).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    links, failed, roots, near = None, None, None, NEAR_PAIRS
    while True:
        found = verified(pairs, rows, members)
        wrong = pairs.join(found, ["a", "b"], "left_anti")
        links = found if links is None else saved(links.unionByName(found))
        failed = saved(wrong if failed is None else failed.unionByName(wrong))
        discard(pairs)
        roots = components(links)
        partners = failed.unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b")))
        partners = partners.groupBy(F.col("a").alias("key")).agg(F.collect_list("b").alias("failed"))
        now = _labelled(many, roots).join(partners, "key", "left")
        now = now.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
        # Few rows, much work: their number says nothing about how many tasks they need.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cells = now.repartition(tasks, "bucket", "i", "j").groupBy("bucket", "i", "j")
        given = saved(cells.applyInPandas(_search(near), "bucket long, a long, b long"))
        near *= 8
        # A bucket that gives nothing now gives nothing later: components only grow.
        busy = given.select(F.col("bucket").alias("busy")).distinct()
        many = join_checked(many, busy, F.col("bucket") == F.col("busy"), "left_semi")
        pairs = saved(given.select("a", "b").distinct())
        forget_shuffles(spark)
        if pairs.isEmpty():
            return links


def linked(cell: pd.DataFrame) -> pd.DataFrame:
    """(key, linked): for each set of a cell of one component the documents of the others
    that it links with; of a cell of two chunks only those of the other chunk."""
    key, n, chunk, copies = (cell[c].to_numpy(np.int64) for c in ("key", "n", "chunk", "copies"))
    shingles = cell["shingles"].tolist()
    owner = np.repeat(np.arange(len(key)), [len(x) for x in shingles])
    _, column, counts = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    both = counts[column] > 1
    owner, column = owner[both], (np.cumsum(counts > 1) - 1)[column[both]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    two = chunk.min() != chunk.max()
    left = np.flatnonzero(chunk == chunk.min())
    right = np.flatnonzero(chunk == chunk.max())
    shared = np.zeros((len(left), len(right)), np.float32)  # exact below 2^24
    width = int((counts > 1).sum())
    for first in range(0, width, 1024):
        part = slice(*np.searchsorted(column, [first, first + 1024]))
        has = np.zeros((len(key), min(1024, width - first)), np.float32)
        has[owner[part], column[part] - first] = 1
        shared += has[left] @ has[right].T
    of_left, of_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    for first in range(0, len(left), 256):
        block = slice(first, first + 256)
        same = shared[block].astype(np.int64)
        good = 100 * same >= PERCENT * (n[left[block], None] + n[right] - same)
        if not two:
            good &= left[block, None] != right
        of_left[block] = good @ copies[right]
        of_right += copies[left[block]] @ good
    if not two:
        return pd.DataFrame({"key": key, "linked": of_left})
    return pd.DataFrame({"key": np.concatenate([key[left], key[right]]), "linked": np.concatenate([of_left, of_right])})


def link_counts(rows: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, linked): for each set the documents of other sets that it links with. Links lie
    inside components, so all pairs of a component are compared exactly: those of small
    ones in a join, those of large ones in cells, which give counts, never pairs."""
    spark = rows.sparkSession
    comps = members.select("key", "n", "copies", "rep", "rep_hash").join(roots.select("key", "comp"), "key")
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("total")).where("c > 1")
    comps = saved(comps.join(sizes, "comp"))
    # Two tasks may both give a set.
    sets = sets_of(rows, comps.select("key", "rep", "rep_hash")).dropDuplicates(["key"])
    comps = saved(comps.drop("rep", "rep_hash").join(sets, "key"))
    forget_shuffles(spark)

    few = comps.where(F.col("c") <= SMALL)
    x = few.select("comp", *[F.col(c).alias(f"{c}_a") for c in ("key", "n", "copies", "shingles")])
    y = few.select("comp", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "copies", "shingles")])
    both = x.join(y, "comp").where((F.col("key_a") < F.col("key_b")) & _sizes_fit(F.col("n_a"), F.col("n_b")))
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    both = both.where(100 * shared >= PERCENT * (F.col("n_a") + F.col("n_b") - shared))
    ends = F.array(
        F.struct(F.col("key_a").alias("key"), F.col("copies_b").alias("linked")), F.struct(F.col("key_b").alias("key"), F.col("copies_a").alias("linked"))
    )
    of_few = both.select(F.inline(ends))

    chunks = F.greatest(F.ceil(F.col("c") / CELL_ROWS), F.ceil(F.col("total") / CELL_SHINGLES)).cast("int")
    many = comps.where(F.col("c") > SMALL).withColumn("chunk", F.pmod(F.xxhash64("key"), chunks).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    many = many.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    many = many.select("comp", "i", "j", "key", "n", "copies", "chunk", "shingles")

    def count(cell: pd.DataFrame) -> pd.DataFrame:
        # Of two chunks one may be empty.
        if cell["i"].iat[0] != cell["j"].iat[0] and cell["chunk"].nunique() == 1:
            return pd.DataFrame({"key": cell["key"], "linked": 0})
        return linked(cell)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = many.repartition(tasks, "comp", "i", "j").groupBy("comp", "i", "j").applyInPandas(count, "key long, linked long")
    found = saved(of_few.unionByName(large).groupBy("key").agg(F.sum("linked").alias("linked")))
    discard(comps)
    forget_shuffles(spark)
    return found


def classes(documents: DataFrame, counted: bool = True) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, n_links, key): per document the size of
    its set, the smallest doc_id it reaches over links, itself included, and how many
    other documents it links with directly, copies included (without ``counted``: 0).

    Null and empty texts, and those without words, have an empty set, link with nothing
    and are their own component. Null ids take part, and are a component's id only if
    there is no other. Repeated rows are copies. Two different sets get the same 64-bit
    key with a probability of sets^2 / 2^65 for the whole corpus.
    """
    import_in_workers(documents.sparkSession)
    rows = _rows(documents)
    sets = saved(prefix_sets(rows))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash", "bits")).alias("rep")
    members = saved(
        sets.where("n > 0")
        .groupBy("key", "gid", "n")
        .agg(rep, F.count(F.lit(1)).alias("copies"))
        .select("key", "gid", "copies", F.col("n").cast("int").alias("n"), F.col("rep.doc_id").alias("rep"), F.col("rep.text_hash").alias("rep_hash"), "rep.bits")
    )
    links = set_links(rows, sets, members)
    roots = saved(_labelled(members.select("key", "rep", "copies"), components(links)))
    least = roots.groupBy("comp").agg(F.min("rep").alias("component_id"))
    known = roots.join(least, "comp")
    n_links = F.lit(0).cast("long")
    if counted:
        known = known.join(link_counts(rows, members, roots), "key", "left")
        n_links = F.col("copies") - 1 + F.coalesce("linked", F.lit(0))
    known = known.select(F.col("key").alias("k"), "component_id", n_links.alias("n_links"))
    out = sets.drop(*PARTS, "gid", "bits").join(known, (F.col("key") == F.col("k")) & (F.col("n") > 0), "left")
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "key",
    )


def join_digest(documents: DataFrame) -> DataFrame:
    """The class of each document. Links are counted by ``classes`` alone."""
    return classes(documents.select("doc_id", "text"), counted=False).select("doc_id", "n_shingles", "component_id")


def one_per_class(documents: DataFrame) -> DataFrame:
    """``documents`` with its own columns, one row of each component: the one with the
    smallest id (null last), then the smallest hash of the text. Documents without a
    shingle all stay. Of rows equal in id and text one stays."""
    known = saved(classes(documents.select("doc_id", "text"), counted=False).select("doc_id", "text_hash", "n_shingles", "component_id", "key"))
    some = known.where("n_shingles > 0")
    # Components without an id are told apart by their sets.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("key")).alias("unnamed")]
    row = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    best = some.select(*group, row.alias("row")).groupBy("component_id", "unnamed").agg(F.min("row").alias("best"))
    best = best.select(F.col("best.doc_id").alias("i"), F.col("best.text_hash").alias("h"))
    gone = some.select("doc_id", "text_hash").distinct().join(best, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left_anti")
    twice = some.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    text = F.xxhash64(F.col("text").cast("string"))
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("th"))

    def without(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
        others = others.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
        return join_checked(rows, others, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), how)

    rows = without(rows, saved(gone), "left_anti")
    twice = saved(twice)
    if not twice.isEmpty():
        rows = without(rows, twice, "left_anti").unionByName(without(rows, twice, "left_semi").dropDuplicates(["id", "th"]))
    return rows.select("row.*")
