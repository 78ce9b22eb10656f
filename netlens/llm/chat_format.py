"""Chat formatting: paths of reply trees, ranked by score, each written as one conversation.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import discard, saved

# Control strings of the template. Each starts with a character that no
# rest of another one holds, so one inserted character breaks exactly one of them.
BOS, EOS, OPEN, CLOSE, BREAK = "<s>", "</s>", "<|im_start|>", "<|im_end|>", "<|nl|>"
_RESTS = r"(?:/?s>|\|im_start\|>|\|im_end\|>|\|nl\|>|/?INST\])"
_ESCAPE = rf"(?<=[<\[])(?=\\*{_RESTS})"
_UNESCAPE = rf"(?<=[<\[])\\(?=\\*{_RESTS})"

# Ranking reads a tree's leaves in this many parts before it compares the best of each.
PARTS = 32


def escape(text: Column) -> Column:
    """No control string is left: each gets a backslash after its first character, and
    one that has backslashes there gets one more, which makes it reversible."""
    return F.regexp_replace(text, _ESCAPE, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "")


def reply_paths(messages: DataFrame) -> DataFrame:
    """Rows (tree, leaf, node, height) of all paths from a root to a leaf; height 0 is
    the leaf. ``messages`` has (tree, node, parent), nodes unique within their tree.

    Self-joins with doubled steps: after round k a path holds its last 2^k messages and
    every message knows its ancestor 2^k above, so depth d takes log2(d) rounds. A
    message whose parent is not in its tree is a root. Messages under a cycle have no
    root and are left out. A null tree is a tree of its own.
    """
    own = messages.select("tree", "node", "parent")
    parents = own.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    up = saved(
        own.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
        .select("tree", "node", F.col("n").alias("up"))
    )
    inner = up.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = up.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    paths = saved(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height")))
    step, most = 1, max(1, up.count())
    while step <= most and not up.where("up is not null").isEmpty():
        jump = up.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("to"))
        jump = jump.where(F.col("to").isNotNull())
        more = (
            paths.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
            .select("tree", "leaf", F.col("to").alias("node"), (F.col("height") + step).alias("height"))
        )
        longer = saved(paths.unionByName(more))
        higher = saved(
            up.where("up is not null")
            .join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")), "left")
            .select("tree", "node", F.col("to").alias("up"))
        )
        discard(paths, up)
        paths, up, step = longer, higher, step * 2
    if up.where("up is not null").isEmpty():
        return paths
    # What still climbs after more steps than there are messages is under a cycle.
    endless = up.where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    hit = paths.join(endless, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_semi")
    hit = hit.select(F.col("tree").alias("t"), F.col("leaf").alias("l")).distinct()
    return paths.join(hit, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")), "left_anti")


def best_paths(messages: DataFrame, keep: int | None) -> DataFrame:
    """Paths with their rank in the tree: highest sum of scores first, then smaller
    leaf. ``keep`` of them per tree stay, all if None; each tree's leaves are cut to
    ``keep`` in parts first, so a tree with very many branches isn't ranked by one task."""
    scores = messages.select(
        F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    )
    paths = reply_paths(messages)
    if keep is None:
        return paths.withColumn("rank", F.lit(None).cast("int"))
    sums = (
        paths.join(scores, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        .groupBy("tree", "leaf")
        .agg(F.sum("score").alias("score"))
    )
    order = [F.col("score").desc(), F.col("leaf")]
    part = F.pmod(F.xxhash64("leaf"), F.lit(PARTS))
    first = sums.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)))
    ranked = first.where(F.col("r") <= keep).withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= keep).select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "rank")
    return paths.join(ranked, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).drop("t", "l")


def format_trees(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """One row per chosen path of ``messages`` (tree, node, parent, role, text, score):
    (tree, leaf, rank, n_turns, formatted, loss_spans). Spans are code-point ranges
    [start, end) of ``formatted`` that hold assistant texts, in order.

    Null roles and texts are empty; a null score counts 0; other columns are ignored; an
    empty table gives no rows. Nodes must be unique in their tree. A path is one row of
    the result, so its messages meet in one task.
    """
    rows = messages.select(
        F.col("tree").alias("t"),
        F.col("node").alias("n"),
        F.coalesce("role", F.lit("")).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
    )
    head = F.concat(F.lit(OPEN), F.regexp_replace(escape(F.col("role")), "\n", BREAK), F.lit("\n"))
    turns = (
        best_paths(messages, keep)
        .join(rows, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        .withColumn("turn", F.concat(head, F.col("body"), F.lit(CLOSE + "\n")))
    )
    before = Window.partitionBy("tree", "leaf").orderBy(F.col("height").desc()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("turn").cast("long")).over(before), F.lit(0)) + F.char_length(head) + len(BOS)
    part = F.struct(
        (-F.col("height")).alias("at"),
        F.col("turn"),
        F.when(F.col("role") == "assistant", F.struct(F.col("start"), (F.col("start") + F.char_length("body")).alias("end"))).alias("span"),
    )
    done = turns.withColumn("start", start).groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.sort_array(F.collect_list(part)).alias("parts"))
    return done.select(
        "tree",
        "leaf",
        "rank",
        F.size("parts").cast("long").alias("n_turns"),
        F.concat(F.lit(BOS), F.array_join(F.col("parts.turn"), ""), F.lit(EOS)).alias("formatted"),
        F.filter(F.col("parts.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text), as they were before formatting."""
    inner = F.substring(formatted, F.lit(len(BOS) + 1), F.char_length(formatted) - len(BOS) - len(EOS))
    pieces = F.filter(F.split(inner, r"<\|im_start\|>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        at = F.char_length(role) + 2
        body = F.substring(piece, at, F.char_length(piece) - at + 1 - len(CLOSE) - 1)
        return F.struct(
            unescape(F.regexp_replace(role, r"<\|nl\|>", "\n")).alias("role"),
            unescape(body).alias("text"),
        )

    return F.transform(pieces, turn)


def chain(conversations: DataFrame) -> DataFrame:
    """Reply trees of a table (conv_id, turn, role, text): each row replies to the one
    before by turn, a null turn first. Equal turns go by role, then text; equal rows stay."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long")
    return conversations.select("conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("tree"),
        node.alias("node"),
        F.when(node > 1, node - 1).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Digest of the formatted conversations, read back from the output."""
    spark = conversations.sparkSession
    probe = "</s>[INST] ok [/INST]"
    schema = conversations.select("conv_id", "turn", "role", "text").schema
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], schema)
    # chain() numbers rows in a window: computed once, every self-join reads the result.
    trees = saved(chain(conversations.select("conv_id", "turn", "role", "text").unionByName(extra)))
    out = format_trees(trees, keep=1).withColumn("turns", read_back(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(
        F.transform(
            "loss_spans",
            lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        ),
        "",
    )
    return out.withColumn("masked", masked).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
