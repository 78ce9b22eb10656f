import hashlib
import re

import numpy as np
from collections import Counter

from pyspark.sql import functions as F

from netlens.llm import licenses, line_dedup, mixing, ngram_join
from netlens.llm import quality_rules as Q
from netlens.llm.common import BLANKS

from .plain import LOWER, WORD, figures, targets


def test_figures_match_plain_python(spark, documents, odd):
    rows = documents.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    texts = Counter((r["doc_id"], *figures(r["text"])) for r in rows.collect())
    out = Q.quality_digest(rows)
    assert Counter((r["doc_id"], *[r[f] for f in Q.FIGURES]) for r in out.collect()) == texts
    assert out.where("base_failed <> (n_words < 50 or 100 * n_repeat_words > 50 * n_words)").isEmpty()
    assert Q.quality_digest(rows.limit(0)).collect() == []


def test_hosts_are_shrunk_to_the_common_rate(spark):
    bad = "x"
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(60)) if k % 20 else bad, f"h{k % 9}", 1) for k in range(1800)]
    rows += [(10_000 + k, bad if k < 180 else " ".join(f"v{k}x{j}" for j in range(60)), "spam", 1) for k in range(200)]
    rows += [(20_000, bad, "small", 1), (30_000, bad, None, 1), (30_001, " ".join(f"n{j}" for j in range(60)), None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, host int")
    hosts = {r["host"]: r for r in Q.host_verdicts(Q.base_rules(table)).collect()}
    assert hosts["spam"]["rejected"] and 0.5 < hosts["spam"]["rate"] < 0.9
    assert not any(r["rejected"] for h, r in hosts.items() if h.startswith("h"))
    assert hosts["small"]["rate"] < 1
    kept = Q.keep_good(table)
    assert kept.columns == table.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not any(10_000 <= k < 10_200 for k in ids) and 30_001 in ids and 30_000 not in ids
    assert len([k for k in ids if k < 1800]) == 1800 - 90


def test_lines_match_plain_python(spark, documents, odd):
    rows = documents.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    extra = [(1000 + k, f"own {k}\n Common É line\x0b\nÉ\n" + ("KELVIN K" if k % 2 else "kelvin K"), "s") for k in range(10)]
    rows = rows.unionByName(spark.createDataFrame(extra, rows.schema))
    table = [(r["doc_id"], r["text"]) for r in rows.collect()]
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    often = Counter(k for _, t in table for k in {key(x) for x in (t or "").split("\n")} if k)
    want = Counter()
    for doc_id, text in table:
        lines = (text or "").split("\n")
        kept = [x for x in lines if often.get(key(x), 0) < 10]
        want[doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in line_dedup.line_digest(rows).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == want
    out = line_dedup.without_common_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup.line_digest(odd.limit(0)).collect() == []


def test_mix_meets_its_targets(spark, documents, odd):
    rows = documents.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    rows = rows.withColumn("source", F.when(F.col("doc_id") < 60, "big").otherwise(F.col("source")))
    out = mixing.mixing_digest(rows)
    again = Counter(map(tuple, mixing.mixing_digest(rows.repartition(5)).collect()))
    assert Counter(map(tuple, out.collect())) == again
    sizes, taken, want, longest = Counter(), Counter(), {}, Counter()
    source = {(r["doc_id"], len(WORD.findall(r["text"] or ""))): r["source"] for r in rows.collect()}
    for r in out.collect():
        s = source[r["doc_id"], r["size"]]
        sizes[s] += r["size"]
        longest[s] = max(longest[s], r["size"])
        taken[s] += r["taken"]
        want[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    plain = targets(sizes)
    for s in sizes:
        assert abs(want[s] - plain[s]) < 1e-6 * max(1, plain[s])
        assert taken[s] < plain[s] + 1e-6 or taken[s] - plain[s] < longest[s] / 2
    assert sum(taken.values()) > 0.9 * sum(plain[s] for s in sizes)
    assert mixing.mixing_digest(rows.limit(0)).collect() == []
    copies = mixing.mixed(rows.where("source = 'big'").withColumn("size", F.lit("x")))
    assert copies.columns == ["doc_id", "text", "source", "size"]


def test_mix_goes_on_behind_a_long_text_until_nothing_fits(spark, monkeypatch):
    # Many short texts are needed after a long one that doesn't fit.
    rows = [(k, "w " * (400 + k % 7), "short") for k in range(600)] + [(900 + k, "w " * 100_000, "short") for k in range(3)]
    rows += [(2000 + k, "w " * (1 + k * k % 300), None) for k in range(300)] + [(5000 + k, "one more row", "c") for k in range(50)]
    rows += [(6000, "same text of five words", "c")] * 40
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {r[0]: r[2] for r in rows}
    for few in (64, 3):
        monkeypatch.setattr(mixing, "FILLERS", few)
        got = mixing.mixing_digest(table).collect()
        plan = mixing.mixing_plan(mixing.measured(table))
        odds = mixing.with_odds(mixing.measured(table), plan, mixing.MAX_COPIES).select("row.doc_id", "size", "whole", "v", "target").collect()
        by = {}
        for r in odds:
            by.setdefault(source[r["doc_id"]], []).append(r)
        for name, docs in by.items():
            rest = docs[0]["target"] - sum(r["whole"] * r["size"] for r in docs)
            want, ties, used = Counter(), {}, set()
            for r in docs:
                want[r["doc_id"]] += r["whole"] * r["size"]
                if r["v"] is not None:
                    ties.setdefault((r["v"], r["doc_id"]), []).append(r["size"])
            for (v, doc_id), sizes in sorted(ties.items()):
                if sum(sizes) <= rest:
                    used.add(v)
                    rest -= sum(sizes)
                    want[doc_id] += sum(sizes)
            # What ends nearer to the target by going beyond it.
            missed = sorted((sum(s), v, k) for (v, k), s in ties.items() if v not in used and sum(s) < 2 * rest)
            for size, _, doc_id in missed[:1]:
                want[doc_id] += size
            taken = Counter()
            for r in got:
                if source[r["doc_id"]] == name:
                    taken[r["doc_id"]] += r["taken"]
            assert taken == want


def test_sources_without_words_and_single_documents(spark):
    rows = [(1, "a b c", "a"), (2, "", None), (3, "d e", "b"), (4, None, "empty"), (5, " \n", "empty")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["source_size"], r["target"], r["taken"]) for r in mixing.mixing_digest(table).collect()}
    assert got[2] == got[4] == got[5] == (0, 0.0, 0) and set(got) == {1, 2, 3, 4, 5}
    assert {r["taken"] for r in mixing.mixing_digest(table.where("doc_id in (2, 4, 5)")).collect()} == {0}
    assert mixing.mixed(table.where("doc_id in (2, 4, 5)")).collect() == []
    # One text of 1000 words and a target a little below: it is nearer than nothing.
    one = [(1, "w " * 1000, "a"), *((k, "x y z", "b") for k in range(2, 600))]
    got = mixing.mixing_digest(spark.createDataFrame(one, "doc_id long, text string, source string")).where("doc_id = 1").first()
    assert 500 < got["target"] < 1000 and got["taken"] == 1000


def test_unequal_weights_give_unequal_chances(spark):
    rows = spark.range(4000).selectExpr("id doc_id", "'w x y z' text", "if(id % 4 = 0, 'a', 'b') source", "if(id % 2 = 0, 3D, 1D) heavy")
    measured = mixing.measured(rows, F.col("heavy"))
    plan = mixing.mixing_plan(measured, weights=(1, 1))
    out = mixing.mix(measured, plan).where("source = 'b'").groupBy("row.heavy").agg(F.avg("copies").alias("c")).collect()
    by = {r["heavy"]: r["c"] for r in out}
    assert 2 < by[3.0] / by[1.0] < 4


def test_licence_families(spark, odd):
    texts = [("apache-2.0", "x\nLicensed under the Apache License, Version 2.0."), ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.\ny")]
    texts += [("mit", "a\nReleased under the MIT License.\nb"), ("cc-by-nc", "Licensed under CC BY-NC 4.0.")]
    texts += [("", "All rights reserved, says the license office."), ("", "plain words"), ("cc-by-nc,mit", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.")]
    rows = spark.createDataFrame([(100 + k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    every = rows.unionByName(odd.select("doc_id", "text"))
    got = {r["doc_id"]: r for r in licenses.licence_digest(every.withColumn("family", F.lit(1))).collect()}
    assert [got[100 + k]["families"] for k in range(len(texts))] == [f for f, _ in texts]
    assert licenses.licence_digest(every).count() == every.count()
    assert licenses.licence_digest(every.limit(0)).collect() == []
    for families in licenses.TEMPLATES.values():
        assert all(re.search(licenses.ANCHOR.replace("(?i)", ""), t, re.I) for t in families)


def test_licence_unknowns_are_learned_from_all_paragraphs(spark):
    says = "Ask Ms Smith, who keeps the old mit license of the tool in drawer {0} of room {0}, before noon"
    texts = [says.format(k) for k in range(2000)] + ["Released under the MIT License."]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert len(got) == len(texts)
    assert got.set_index("doc_id").loc[2000, "confirmed"]
    assert (got["family"] != licenses.UNKNOWN).sum() <= 1 + licenses.FALSE_SHARE * 2000


def test_licence_cut_counts_every_paragraph(spark):
    rows = [("mit", 0.60 + k / 100_000) for k in range(5000)] + [("unknown", 0.97)] * 5000 + [("gpl-3.0", 0.9)] * 4
    found = spark.createDataFrame(rows, "family string, probability double")
    cut = licenses.cut_of(found)
    assert sum(f != licenses.UNKNOWN and p >= cut for f, p in rows) <= licenses.FALSE_SHARE * len(rows)
    assert 0.649 < cut <= 0.65 and licenses.cut_of(found.limit(0)) == licenses.LEAST_CUT


def test_prefixes_are_dealt_out_over_the_passes_whole():
    prefixes = [np.arange(7, 907, 3, dtype=np.uint64), np.empty(0, np.uint64), np.array([2**64 - 1, 4, 5], np.uint64)]
    passes = [part.to_pylist() for part in ngram_join.dealt(prefixes)]
    for k, prefix in enumerate(prefixes):
        got = {r["pos"]: r["bucket"] for part in passes for r in part[k]}
        assert [got[i] for i in range(len(got))] == prefix.view(np.int64).tolist()
    assert all(r["bucket"] % ngram_join.PASSES == j for j, part in enumerate(passes) for rows in part for r in rows)
    assert all(part[0] for part in passes)
