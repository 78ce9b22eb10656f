import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netlens.llm import language_id, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_of_held_out_documents(spark, corpus, odd):
    out = language_id.language_digest(corpus.withColumn("score", F.lit("x")))
    rows = out.join(corpus.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert out.where("score < 0 or score > 1").isEmpty() and out.count() == corpus.count()
    assert language_id.language_digest(odd).count() == odd.count()
    assert {r["lang_pred"] for r in language_id.language_digest(odd).where("doc_id in (1, 2, 3)").collect()} == {"und"}
    assert language_id.language_digest(odd.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language_id.language_digest(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_runs_show_where_a_text_switches(spark, corpus):
    model = language_id.fit(corpus)
    texts = {r["lang"]: r["text"].split() for r in corpus.where("lang in ('en', 'fr')").groupBy("lang").agg(F.max_by("text", "n_chars").alias("text")).collect()}
    mixed = " ".join(texts["en"][:40] + texts["fr"][:40])
    [row] = language_id.label(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).collect()
    assert [s["lang"] for s in row["spans"]] == ["en", "fr"]
    assert abs(row["spans"][0]["n_words"] - 40) <= 2
    assert sum(s["n_words"] for s in row["spans"]) >= 80


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)))
    lengths = np.array([4, 1, 3])
    scores = rng.normal(size=(8, 3))
    pairs = np.zeros((3, 3))
    got = model.marginals(scores, np.cumsum(lengths) - lengths, lengths, pairs)
    want, steps = np.zeros((8, 3)), np.zeros((3, 3))
    for first, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
        paths = np.indices((3,) * n).reshape(n, -1)
        total = scores[first + np.arange(n)[:, None], paths].sum(axis=0) + model.steps[paths[:-1], paths[1:]].sum(axis=0)
        weight = np.exp(total) / np.exp(total).sum()
        for t in range(n):
            want[first + t] = np.bincount(paths[t], weight, 3)
            if t:
                np.add.at(steps, (paths[t - 1], paths[t]), weight)
    assert np.allclose(got, want) and np.allclose(pairs, steps)


def test_toxicity_of_held_out_documents(spark, corpus, odd):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.toxicity_digest(big, labels)
    rows = out.join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.01
    assert out.where("score < 0 or score > 1 or predicted <> int(score >= 0.7)").isEmpty()
    few = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    assert toxicity.toxicity_digest(odd, few).count() == odd.count()
    assert toxicity.toxicity_digest(odd, few.limit(0)).count() == odd.count()
    assert toxicity.toxicity_digest(odd.limit(0), few).collect() == []


def test_swaps_take_blame_from_group_words():
    """Training texts name one group mostly in insults; its neutral mention stays clean."""
    rng = np.random.default_rng(3)
    texts, toxic = [], []
    for k in range(400):
        bad = k % 2
        words = [f"w{rng.integers(50)}" for _ in range(8)] + (["vermin"] if bad and k % 4 == 1 else [])
        words.append("muslims" if (bad and k % 8 != 3) or k % 16 == 0 else "christians" if k % 4 == 2 else "plain")
        texts.append(" ".join(words))
        toxic.append(bad)
    docs = []
    for t in texts:
        docs.append(np.unique(np.concatenate([f for f, _ in toxicity.text_features(pa.array([t]))])))
    model = toxicity.train(docs, np.array(toxic, float))
    free, toxicity.SWAP_PENALTY = toxicity.SWAP_PENALTY, 0.0
    try:
        without = toxicity.train(docs, np.array(toxic, float))
    finally:
        toxicity.SWAP_PENALTY = free
    ask = pa.array(["w1 w2 muslims w3", "w1 w2 christians w3", "w1 vermin w3"])
    fair, unfair = model.scores(ask), without.scores(ask)
    assert abs(fair[0] - fair[1]) < 0.5 * abs(unfair[0] - unfair[1])
    assert fair[2] > fair[0]
