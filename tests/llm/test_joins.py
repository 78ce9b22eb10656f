import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from netlens.llm import ngram_join, packing, topk_search
from netlens.llm.components import components
from netlens.llm.queries import tokenizer_file

from .plain import brute, shingles


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 40, 90, 150]))]
        for _ in range(rng.choice([1, 2, 15])):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text += passage
            rows.append((len(rows) * 3 + 1, " ".join(text).title() if rng.random() < 0.2 else " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_components_match_all_pairs(spark, documents, odd):
    rows = [*near_copies(1), *((100_000 + i, t) for i, t in near_copies(2)), *((r["doc_id"], r["text"]) for r in odd.collect())]
    rows = [(None if i is None else i, t) for i, t in rows]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("key", F.lit("x"))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_digest(table).collect())
    assert got == brute(rows)
    assert ngram_join.join_digest(table.limit(0)).collect() == []
    lone = table.where("text is null or text = ''")
    assert ngram_join.join_digest(lone).where("component_id <> doc_id or n_shingles > 0").isEmpty()


def test_large_buckets_in_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 4)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = near_copies(5)
    for k in range(60):  # a family in which many pairs are just below the threshold
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = f"x{k}y{rng.randrange(100)}"
        rows.append((10_000 + k, " ".join(text)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_digest(table).collect())
    assert got == brute(rows)


def test_link_counts_match_all_pairs(spark, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    rows = near_copies(6)
    for k in range(40):  # a family in which all pairs link, one whose pairs link in part, copies
        rows.append((10_000 + k, " ".join([f"a{x}" for x in base] + [f"x{k}"])))
        rows.append((20_000 + k, " ".join([*[f"x{k}y{j}" for j in range(k % 5)], *base, *[f"z{k}y{j}" for j in range(k % 7)]])))
        rows.append((30_000 + k, " ".join(base[k % 3 :])))
    sets = [shingles(t) for _, t in rows]
    want = {}
    for a, (i, _) in enumerate(rows):
        same = [100 * len(sets[a] & s) >= 80 * len(sets[a] | s) for s in sets]
        want[i] = sum(same) - 1 if sets[a] else 0
    assert want[10_000] == 39
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for cell in (2048, 7):
        monkeypatch.setattr(ngram_join, "CELL_ROWS", cell)
        assert {r["doc_id"]: r["n_links"] for r in ngram_join.classes(table).collect()} == want


def test_one_document_of_each_class_stays(spark, odd):
    rows = near_copies(3)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.one_per_class(table.withColumn("id", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "id"]
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute(rows)}
    # (4, 'a b') stands for its copy without an id; of equal rows one stays.
    left = Counter((r["doc_id"], (r["text"] or "")[:5]) for r in ngram_join.one_per_class(odd).collect())
    assert left == Counter({(1, ""): 1, (2, ""): 1, (3, " \t\n\n "): 1, (4, "a b"): 1, (5, "one t"): 1, (6, "ÉÀ ñ "): 1}) or (5, "anoth") in left


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(7, 7), (None, 3), (200, 199)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 180), 100), 199: 199, 200: 199}


def pieces_of(rows, **options):
    out = packing.pack(rows, tokenizer_file(), **options).toPandas()
    out["ids"] = [np.frombuffer(b, "<u4") for b in out["ids"]]
    return out


def test_packing_is_gapless_and_keeps_all_ids(spark, documents, odd):
    from tokenizers import Tokenizer

    strange = ["Don't. stop,, 'S a.B 1,2. İK ſ é́ <|endoftext|> x. y, z.", "WORLD'S, \x1c\x85 end.", "a" * 5000, "́x .", "...,,, ,"]
    strange += ["x <|endoftext|> y", "a.<|startoftext|>b, <|ENDOFTEXT|> <|endoftext|", "<|endoftext|><|endoftext|>.", "one. two, THREE.four ,."]
    rows = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + k, t) for k, t in enumerate(strange)], "doc_id long, text string"))
    rows = rows.where("doc_id <> 5").unionByName(odd.where("doc_id in (1, 2, 6)").selectExpr("doc_id + 50000 doc_id", "text")).repartition(4)
    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in rows.collect()}
    for capacity in (4096, 512):
        got = pieces_of(rows, capacity=capacity)
        for doc_id, part in got.groupby("doc_id"):
            part = part.sort_values("start")
            assert np.concatenate(part["ids"].tolist()).tolist() == want[doc_id]
            assert (part["start"] == part["length"].cumsum() - part["length"]).all() and set(part["doc_tokens"]) == {len(want[doc_id])}
        assert set(got["doc_id"]) == set(want)
        used = got.groupby("sequence_id")["length"].sum()
        for _, part in got.groupby("sequence_id"):
            part = part.sort_values("offset")
            assert (part["offset"] == part["length"].cumsum() - part["length"]).all()
        assert used.max() <= capacity
        padding = sum(capacity - n for n in used if n & (n - 1))
        assert padding < 0.03 * used.sum()
    crc = packing.packing_digest(rows, tokenizer_file()).where("doc_id = 9001").collect()
    assert [r["ids_crc32"] for r in crc] == [zlib.crc32(np.array(want[9001], "<u4").tobytes())]


def test_packing_gets_texts_in_small_batches(spark, monkeypatch):
    """A batch of 10 000 long texts, and the arrays made from it, once filled a worker's memory."""
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id", F.repeat(F.lit(" word"), 2000)).alias("text"))
    seen = [spark.sparkContext.accumulator(0) for _ in range(3)]
    key, chunks = "spark.sql.execution.arrow.maxBytesPerBatch", packing.chunks

    def watched(texts, *size):
        seen[0].add(len(texts))
        seen[1].add(int(texts.nbytes > 8 << 20))
        for part in chunks(texts, *size):
            seen[2].add(int(len(part[1]) > 1 << 20))
            yield part

    monkeypatch.setattr(packing, "chunks", watched)
    before = spark.conf.get(key, None)
    got = pieces_of(rows)
    assert [x.value for x in seen] == [3000, 0, 0] and spark.conf.get(key, None) == before
    assert got["doc_id"].nunique() == 3000 and got["length"].sum() == got.drop_duplicates("doc_id")["doc_tokens"].sum()


def test_packing_of_odd_tables(spark, odd):
    got = pieces_of(odd.withColumn("ids", F.lit(1)))
    assert got["length"].sum() == got.drop_duplicates(["doc_id", "doc_tokens", "sequence_id", "offset"])["length"].sum()
    assert got["doc_id"].isna().sum() == 1
    assert len(pieces_of(odd.limit(0))) == 0


def test_search_matches_all_scores(spark):
    rng = np.random.default_rng(5)
    vectors = [(k, rng.normal(size=24).round(2).astype(np.float32).tolist()) for k in range(0, 900, 3)]
    vectors += [(1000 + k, vectors[0][1]) for k in range(30)]  # ties
    vectors += [(5000, [float(x) for x in rng.normal(size=8)]), (5100, [0.5] * 8), (5200, [])]
    vectors += [(7000, [3e5, *[0.0] * 23]), (7001, [-1e11] * 24), (7002, [-2e11, 3.0] * 12), (7100, [9e5] * 24)]
    bad = [(6000, None), (6001, [1.0, None]), (6002, [float("nan")] * 24), (6003, [float("inf")] * 24), (None, [1.0] * 24)]
    table = spark.createDataFrame([*vectors, vectors[1], *bad], "vec_id long, embedding array<float>").withColumn("v", F.lit(0))
    got = {}
    for r in topk_search.search_digest(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in vectors}
    want = {}
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        if scores:
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert max(s for v in want.values() for _, _, s in v) > 2**53
    assert topk_search.search_digest(table.limit(0)).collect() == []


def test_blocks_and_chunks_do_not_change_the_result(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = topk_search.integer_vectors(vectors)
    queries = vectors.where("vec_id % 7 = 0")
    a = topk_search.top_k(vectors, queries).toPandas()
    b = topk_search.top_k(vectors, queries, chunk_rows=37, block_rows=5).toPandas()
    pd.testing.assert_frame_equal(*(x.sort_values(["query_id", "rank"]).reset_index(drop=True) for x in (a, b)))
