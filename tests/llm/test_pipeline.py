"""The pipeline, stage by stage against plain Python, and as a whole."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from netlens.llm.common import BLANKS, saved
from netlens.llm.queries import LLM_QUERIES, tokenizer_file

from .plain import LOWER, WORD, brute, figures, targets

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_python(spark, documents):
    from tokenizers import Tokenizer

    docs = documents
    columns = documents.columns
    given = {r["doc_id"]: r.asDict() for r in documents.collect()}

    def after(k):
        nonlocal docs
        docs = saved(corpus_pipeline.STAGES[k][1](spark, docs, SF))
        return [r.asDict() for r in docs.collect()]

    def good(text):
        words, *_, repeated = figures(text)
        return words >= 50 and 100 * repeated <= 50 * words

    rows = after(0)
    assert docs.columns == columns
    assert sorted(r["doc_id"] for r in rows) == sorted(k for k, r in given.items() if good(r["text"]))
    assert all(r == given[r["doc_id"]] for r in rows)

    keys = {r["doc_id"]: [x.strip(BLANKS).translate(LOWER) for x in r["text"].split("\n")] for r in rows}
    often = Counter(k for lines in keys.values() for k in set(lines) if k)
    want = {
        r["doc_id"]: "\n".join(x for x, k in zip(r["text"].split("\n"), keys[r["doc_id"]], strict=True) if often.get(k, 0) < 10) for r in rows
    }
    rows = after(1)
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in rows} == want

    least = {c for _, _, c in brute(list(want.items()))}
    rows = after(2)
    assert docs.columns == columns and sorted(r["doc_id"] for r in rows) == sorted(least)
    assert all(r["text"] == want[r["doc_id"]] for r in rows)

    sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    per_source = Counter()
    for k, n in sizes.items():
        per_source[source[k]] += n
    rows = after(3)
    assert docs.columns == columns
    copies = Counter(r["doc_id"] for r in rows)
    assert max(copies.values()) <= 3 and set(copies) <= set(sizes)
    taken = Counter()
    for k, n in copies.items():
        taken[source[k]] += n * sizes[k]
    for s, target in targets(per_source).items():
        longest = max(n for k, n in sizes.items() if source[k] == s)
        assert taken[s] <= target + 1e-6 or taken[s] - target < longest / 2
    assert sum(taken.values()) > 0.85 * sum(per_source.values())

    tokenizer = Tokenizer.from_file(tokenizer_file())
    tokens = sum(n * (len(tokenizer.encode(want[k], add_special_tokens=False).ids) + 1) for k, n in copies.items())
    rows = after(4)
    assert sum(r["length"] for r in rows) == tokens
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
        assert len(np.frombuffer(r["ids"], "<u4")) == r["length"]
    assert max(used.values()) <= 4096


def test_a_source_without_words_goes_through(spark):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(1, good, "en", "a"), (2, "", "en", None), (3, good.upper().replace("W", "v"), "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {1, 3}
    assert corpus_pipeline.mixture(spark, docs.where("doc_id = 2"), SF).collect() == []


def test_run_and_registry(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.agg(F.sum("length")).first()[0] > 0
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
