import hashlib

from pyspark.sql import functions as F

from netlens.llm import chat_format as C

SF = "/root/testdata/sf0.001"

TREE = "tree long, node long, parent long, role string, text string, score double"


def test_escape_is_reversible_and_breaks_every_control_string(spark):
    controls = [C.BOS, C.EOS, C.OPEN, C.CLOSE, C.BREAK, "[INST]", "[/INST]"]
    texts = [*controls, "<\\s>", "[\\\\INST]", "<<s>>", "[[INST]]", "a\\", "", "<", "plain", "<<|im_end|>", "".join(controls)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e")).withColumn("u", C.unescape(F.col("e")))
    for r in rows.collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in controls)


def test_best_branch_of_a_tree(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0),
        (1, 2, 1, "assistant", "bad", 1.0),
        (1, 3, 1, "assistant", "good", 2.0),
        (1, 4, 3, "user", "more", 0.0),
        (2, 1, 9, "user", "orphan", None),  # its parent is missing: a root
        (None, 1, None, None, None, 0.0),
        (3, 1, 2, "user", "a", 0.0),  # a cycle and what hangs on it have no root
        (3, 2, 1, "user", "b", 0.0),
        (3, 3, 1, "user", "c", 0.0),
        (4, 1, None, "user", "tie", 0.0),
        (4, 2, 1, "assistant", "x", 1.0),
        (4, 3, 1, "assistant", "y", 1.0),
    ]
    messages = spark.createDataFrame(rows, TREE)
    one = {r["tree"]: r for r in C.format_trees(messages, 1).withColumn("t", C.read_back(F.col("formatted"))).collect()}
    assert {k: [tuple(t) for t in r["t"]] for k, r in one.items()} == {
        1: [("user", "q"), ("assistant", "good"), ("user", "more")],
        2: [("user", "orphan")],
        None: [("", "")],
        4: [("user", "tie"), ("assistant", "x")],
    }
    [span] = one[1]["loss_spans"]
    assert one[1]["formatted"][span["start"] : span["end"]] == "good"
    every = C.format_trees(messages, None).groupBy("tree").count().collect()
    assert {r["tree"]: r["count"] for r in every} == {1: 2, 2: 1, None: 1, 4: 2}
    assert {(r["leaf"], r["rank"]) for r in C.format_trees(messages, 5).where("tree = 4").collect()} == {(2, 1), (3, 2)}


def test_long_chain_and_empty_table(spark):
    chain = spark.range(1, 301).select(F.lit(1).cast("long").alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    chain = chain.selectExpr("*", "'assistant' role", "string(node) text", "0D score")
    [row] = C.format_trees(chain).collect()
    assert row["n_turns"] == 300
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss_spans"]] == [str(k) for k in range(1, 301)]
    assert C.format_trees(chain.limit(0)).collect() == []


def test_digest_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    extra = spark.createDataFrame([(-1, 0, None, None, 1), (-1, 0, "user", "t", 1), (-2, None, "a\nb", "x", 1), (None, 0, "user", "t", 1)], "conv_id long, turn long, role string, text string, node int")
    rows = table.withColumn("node", F.lit(1)).unionByName(extra)
    want = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(rows.collect(), key=lambda r: (r["turn"] is not None, r["turn"], r["role"] or "", r["text"] or "")):
        want.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = {r["conv_id"]: r for r in C.chat_digest(rows).collect()}
    assert got.keys() == want.keys()
    for key, turns in want.items():
        mask = "".join(t for role, t in turns if role == "assistant")
        assert got[key]["n_turns"] == len(turns)
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[key]["loss_chars"], got[key]["loss_sha256"]) == (len(mask), hashlib.sha256(mask.encode()).hexdigest())
