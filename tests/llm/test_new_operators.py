"""Operators 11 to 13 against brute force."""

import hashlib
import heapq
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens.llm import hard_negatives, repeats, turn_repair

# ---- 11: hard negatives -----------------------------------------------------


def plain_negatives(rows):
    whole = sorted({(i, (c + 1) % 10 if i % 7 == 0 else c, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, c in rows})
    out = Counter()

    def best(anchor, keep, k):
        scored = [(-sum(a * b for a, b in zip(anchor[2], r[2], strict=True)), r[0]) for r in whole if r[0] != anchor[0] and len(r[2]) == len(anchor[2]) and keep(r)]
        return sorted(x for x in scored if keep.score(-x[0]))[:k]

    class Rule:
        def __init__(self, row, score=lambda s: True):
            self.row, self.score = row, score

        def __call__(self, r):
            return self.row(r)

    for a in (r for r in whole if r[0] % 100 == 0):
        for p, positive in best(a, Rule(lambda r, a=a: r[1] == a[1]), 5):
            window = Rule(lambda r, a=a: r[1] != a[1], lambda s, p=-p: 30 * p <= 100 * s <= 90 * p)
            for rank, (s, i) in enumerate(best(a, window, 10), 1):
                out[a[0], positive, rank, i, -p, -s] += 1
    return out


def negatives_of(table):
    rows = hard_negatives.negative_digest(table).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(tuple(r) for r in rows.collect())


def test_hard_negatives_match_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=6) * rng.choice([0.2, 1, 3])).astype(np.float32).tolist(), int(rng.integers(0, 4))) for k in range(0, 1500, 4)]
    rows += [(2001 + k, rows[0][1], k % 3) for k in range(60)]  # many of one vector
    rows += [(2100, rows[0][1], 1), (2200, [0.0] * 6, 2), (2300, [1.0, 2.0], 1), (2301, [2.0, 1.0], 1), (2302, [1.0, 1.0], 2), (2400, [], 1), (2401, [], 1)]
    rows += [(2500, [3e5] * 6, 1), (2501, [2e5] * 6, 1), (2502, [1e5] * 6, 3), (2503, [3e5, -3e5, 0.0, 1e5, 1.0, 1.0], 3)]  # beyond 2^53
    bad = [(3000, None, 1), (3001, [1.0] * 6, None), (3100, [1.0, None], 1), (3200, [float("nan")] * 6, 1), (None, [1.0] * 6, 1)]
    schema = "vec_id long, embedding array<float>, label int"
    table = spark.createDataFrame([*rows, rows[5], *bad], schema).withColumn("v", F.lit(0)).repartition(3)
    want = plain_negatives(rows)
    assert sum(want.values()) > 500 and any(k[4] > 2**53 for k in want)
    assert negatives_of(table) == want
    for name, value in (("LEAF_ROWS", 20), ("CHUNK_ROWS", 7), ("BLOCK_ROWS", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert negatives_of(table) == want
    assert negatives_of(table.limit(0)) == Counter()


def test_siblings_outside_the_window_are_left_out(spark, monkeypatch):
    """Separate clusters: most leaves are never searched."""
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 8)) * 4
    rows = [(k, (centres[k % 10] + rng.normal(size=8) * 0.05).astype(np.float32).tolist(), k % 10) for k in range(1000)]
    vectors = hard_negatives.labelled_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    trees = hard_negatives.built(vectors)
    sent = spark.sparkContext.broadcast(trees)
    placed = hard_negatives.planted(vectors, sent)
    hard_negatives.with_ranges(placed, trees, sent)
    tree = trees[8]
    points = np.array([r["v"] for r in vectors.collect()])
    scores = points[:20] @ points.T
    high, low = scores.max(axis=1), np.sort(scores, axis=1)[:, -50]
    query, leaf, _ = tree.route(points[:20], low, high)
    assert tree.leaves > 8 and len(query) < 0.5 * 20 * tree.leaves
    home = {tuple(r["v"]): r["leaf"] for r in placed.collect()}
    met = set(zip(query.tolist(), leaf.tolist(), strict=True))
    for q in range(20):  # and none that holds a hit is left out
        assert {home[tuple(p)] for p, s in zip(points, scores[q], strict=True) if low[q] <= s <= high[q]} <= {n for k, n in met if k == q}


def test_scores_beyond_a_long_are_an_error(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1), (2, [1.0, 1.0], 2)]
    with pytest.raises(Exception, match="does not fit a long"):
        negatives_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


# ---- 12: turn repair --------------------------------------------------------


def cheapest(code):
    """(cost, audit) by a search over rows and states of the grammar."""
    heap, seen = [(0, "", 0, "")], {}
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(code) and last in ("", "a"):
            return cost, audit
        if seen.get((i, last), (cost + 1, "")) <= (cost, audit):
            continue
        seen[i, last] = cost, audit
        want = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, want))
        if i < len(code):
            c, extra = code[i].lower(), code[i].isupper()
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if c == "s" and last == "":
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, "s"))
            if c != "-":
                heapq.heappush(heap, (cost + extra + 2 * (c != want), audit + ("K" if c == want else "R"), i + 1, want))
    raise AssertionError


def test_alignment_is_cheapest_and_least(monkeypatch):
    rng = random.Random(2)
    for cells in (turn_repair.CELLS, 150):  # all rows of the table kept, or few
        monkeypatch.setattr(turn_repair, "CELLS", cells)
        for _ in range(1500):
            code = "".join(rng.choice(rng.choice(["suasuaSUAx-X", "uauauaUAs-", "ua"])) for _ in range(rng.randrange(14)))
            assert turn_repair.align(code) == cheapest(code), code


def plain_repair(rows):
    """The digest of rows (conv_id, turn, role, text), row by row."""
    kept = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        kept.setdefault(c, [])
        kept[c] += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for c, turns in kept.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, code, count = set(), "", Counter()
        for _, role, text in turns:
            bare = [x for x in text if x not in " \t\n\x0b\x0c\r"]
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            code += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns[:-1], turns[1:], strict=True))
        cost, audit = cheapest(code)
        lines, i, length = [], 0, sum(x != "D" for x in audit)
        for x in audit:
            role = ("user", "assistant")[(len(lines) + length % 2) % 2]
            if x in "KR":
                lines.append((turns[i][1] if x == "K" else role) + ":" + turns[i][2])
            elif x == "I":
                lines.append(role + ":")
            i += x != "I"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


def repairs_of(table):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in turn_repair.repair_digest(table).collect()}


def test_repairs_match_plain_python(spark):
    rng = random.Random(8)
    rows = [
        (c, t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "uncle", None]), rng.choice(["Yes.", "No", "a\nb?", "é!", " \t", "", None, "long " * 3000]))
        for c in range(150) for t in range(rng.randrange(1, 9))
    ]
    rows += [(None, 1, "user", "x."), (None, None, "assistant", "y."), (900, None, None, None), (900, None, "user", "b."), (901, 5, "user", "a."), (901, 5, "user", "a."), (901, 5, "assistant", "a.")]
    rows += [r for c in (902,) for r in ((c, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(400))]
    dropped = next(t for t in range(1000) if zlib.crc32(f"950:{t}".encode()) % 20 == 0)
    rows.append((950, dropped, "user", "gone."))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("x")).repartition(3)
    got = repairs_of(table)
    want = plain_repair(rows)
    assert got == want
    assert got[950] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repairs_of(table.limit(0)) == {}


def test_conversations_of_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert repairs_of(table) == plain_repair([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()])


# ---- 13: repeats ------------------------------------------------------------


def plain_repeats(texts):
    starts = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - 199):
            starts.setdefault(t[p : p + 200], []).append((k, p))
    gone = [bytearray(len(t)) for t in texts]
    for at in starts.values():
        for k, p in at if len(at) > 1 else ():
            gone[k][p : p + 200] = b"\1" * 200
    out = []
    for t, g in zip(texts, gone, strict=True):
        kept = bytes(c for c, x in zip(t, g, strict=True) if not x)
        out.append((len(t), sum(g), sum(x and not before for x, before in zip(g, [0, *g], strict=False)), hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).repartition(4)
    want = plain_repeats([(t or "").encode() for _, t in rows])
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeat_digest(table).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


def repeating_rows(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = word(700), word(230)
    rows = [(k, word(rng.randrange(0, 300)) + passage[rng.randrange(300) : 350 + rng.randrange(350)] + word(rng.randrange(0, 300))) for k in range(60)]
    rows += [(100 + k, word(150) + other + word(150)) for k in range(12)]
    base = word(900)
    for k in range(40):  # near copies
        at = rng.randrange(880)
        rows.append((200 + k, base[:at] + f"#{k}#" + base[at + 5 :]))
    rows += [(300, "a" * 450), (301, "a" * 199), (302, "ab" * 101), (303, "xyz" * 90 + "!" + "xyz" * 90), (304, None), (None, ""), (None, other), (305, other), (305, other), (306, "q" + other[:198] + "q")]
    return rows


def test_repeats_match_all_windows(spark, monkeypatch):
    check_repeats(spark, repeating_rows(1))
    monkeypatch.setattr(repeats, "PART", 256)  # long texts in parts
    monkeypatch.setattr(repeats, "SHARD_ROWS", 400)  # many shards
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 3000)
    check_repeats(spark, repeating_rows(2))
    monkeypatch.setattr(repeats, "HOT", 3)  # frequent anchors
    check_repeats(spark, repeating_rows(3))
    assert repeats.repeat_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_merged_transforms_are_the_transform_of_all():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(200, 420))) for _ in range(30)]
    bounds = np.cumsum([0, *map(len, texts)])
    symbols, rows = repeats.symbols_of(np.frombuffer("".join(texts).encode(), np.uint8), bounds)
    depth = 4
    whole, _ = repeats.transform(symbols, rows, depth)
    parts = [repeats.transform(symbols[rows[a] : rows[b]], rows[a : b + 1] - rows[a], depth)[0] for a, b in ((0, 7), (7, 8), (8, 30))]
    merged, common = repeats.merge(parts, depth)
    both = repeats.merge([whole], depth)
    assert (common == both[1]).all()  # the common prefixes of neighbours
    blocks = np.cumsum(common < depth)
    count = lambda bwt: Counter(zip(blocks.tolist(), bwt.tolist(), strict=True))
    assert count(np.concatenate(parts)[merged]) == count(whole[both[0]])  # and of each block the symbols before it
