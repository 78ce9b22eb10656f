"""Conversation structure repair: turns aligned with the grammar of a dialogue.

A good conversation has the roles ``(s?(ua)+)?`` by their first letters. Edits turn rows
into one: Keep, Rerole, Delete and Insert. Which are cheapest is a Wagner-Fischer
alignment of the rows with the target string of each feasible length.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import BLANK, import_in_workers

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Cells of a table that are kept; of larger ones every so many rows, and the rows
# between them are made again when the backtrace comes there.
CELLS = 1 << 23
# Code strings whose alignment a worker remembers.
REMEMBERED = 50_000
FAR = np.int64(1) << 40

# First letter of a row's role (x: none of s, u, a; upper case: truncated), or - for a
# row that has to go.
PLAN = "cost long, audit string, plan array<struct<row: int, role: string>>"


class Band:
    """Costs ``S[i][r]`` of turning rows i.. into the last r letters of a target. Targets
    are (ua)* behind an optional s, so one table serves all lengths. Only cells are kept
    through which a path of at most ``most`` may go: r is at most most / INSERT above
    the rows left, or most / DELETE below. A row is indexed by r - (rows left)."""

    def __init__(self, code: str, most: int):
        n = len(code)
        self.n, self.below, self.above = n, most // DELETE, most // INSERT
        letters = np.frombuffer(code.encode(), np.uint8)
        lower = letters | 0x20
        gone = letters == ord("-")
        extra = np.where((letters >= 65) & (letters <= 90), TRUNCATED, 0)
        self.extra = extra.tolist()
        # Cost of giving the row to a letter: odd r takes a, even r takes u.
        self.match = np.stack([np.where(gone, FAR, extra + np.where(lower == ord(c), 0, REROLE)) for c in "ua"], axis=1)
        width = self.below + self.above + 1
        self.step = 1 if (n + 1) * width <= CELLS else math.isqrt(n) + 1
        self.offset = np.arange(-self.below, self.above + 1)
        row = self._closed(np.where(self.offset >= 0, 0 * self.offset + (self.offset > 0) * FAR, FAR), n)
        self.kept, self.part = {n: row}, {}
        for i in range(n - 1, -1, -1):
            row = self._before(row, i)
            if i % self.step == 0:
                self.kept[i] = row

    def _closed(self, row: np.ndarray, i: int) -> np.ndarray:
        """With insertions: the cheapest cell to the left, and INSERT for each step."""
        row = np.minimum.accumulate(row - INSERT * self.offset) + INSERT * self.offset
        row[self.offset + self.n - i < 0] = FAR
        return np.minimum(row, FAR)

    def _before(self, after: np.ndarray, i: int) -> np.ndarray:
        row = after + self.match[i][(self.offset + self.n - i) % 2]
        row[self.offset + self.n - i < 1] = FAR
        row[:-1] = np.minimum(row[:-1], after[1:] + DELETE)
        return self._closed(row, i)

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        if i not in self.part:
            last = min(i - i % self.step + self.step, self.n)
            self.part, row = {}, self.kept[last]
            for k in range(last - 1, i - 1, -1):
                row = self.part[k] = self._before(row, k)
        return self.part[i]

    def cost(self, i: int, r: int) -> int:
        k = r - (self.n - i) + self.below
        return int(self.row(i)[k]) if 0 <= k <= self.below + self.above and r >= 0 else int(FAR)

    def backtrace(self, targets: list[tuple[int, int]], cost: int) -> str:
        """The least of the cheapest audits, letters in the order D, I, K, R. A target is
        (length, row of the s or -1). Audits are compared as they grow: all that are left
        have the same letters so far, so they are at the same row."""
        out, i = [], 0
        # (letters of the target to come, row of the s, cost to come)
        left = {(length - (s >= 0), s, cost) for length, s in targets}
        while True:
            steps = [self._step(i, *state) for state in left]
            letter = min(c for c, _ in steps)
            if not letter:
                return "".join(out)
            left = {state for c, state in steps if c == letter}
            out.append(letter)
            i += letter != "I"

    def _step(self, i: int, r: int, s: int, now: int) -> tuple[str, tuple]:
        if i < s:
            return "D", (r, s, now - DELETE)
        if i == s:
            return "K", (r, -1, now - self.extra[i])
        if i == self.n and r == 0:
            return "", ()
        if i < self.n and DELETE + self.cost(i + 1, r) == now:
            return "D", (r, s, now - DELETE)
        if r > 0 and INSERT + self.cost(i, r - 1) == now:
            return "I", (r - 1, s, now - INSERT)
        price = int(self.match[i][r % 2])
        return "K" if price == self.extra[i] else "R", (r - 1, -1, now - price)


def _lengths(band: Band, code: str) -> list[tuple[int, int, int]]:
    """(cost, length, row of the s or -1) of every feasible length inside the band."""
    n = len(code)
    out = [(band.cost(0, r), r, -1) for r in range(max(0, n - band.below) // 2 * 2, n + band.above + 1, 2)]
    for i, c in enumerate(code):
        before = DELETE * i + band.extra[i]  # all rows in front of the s go
        if i > band.below:
            break
        if c in "sS":
            left = n - i - 1
            first = max(2, (left - band.below) // 2 * 2)
            out += [(before + band.cost(i + 1, r), r + 1, i) for r in range(first, left + band.above + 1, 2)]
    return [x for x in out if x[0] < FAR]


def align(code: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation, the ASCII-least of them.

    A narrow band gives an incumbent; a band as wide as its cost allows then holds every
    path that isn't dearer, so it has the cheapest and all that tie with it. Lengths
    that tie are told apart by their audits.
    """
    n = len(code)
    guess = DELETE * code.count("-") + 2 * INSERT
    # Deleting everything is always feasible.
    incumbent = min([DELETE * n, *(c for c, *_ in _lengths(Band(code, min(guess, DELETE * n)), code))])
    band = Band(code, incumbent)
    found = _lengths(band, code)
    cost = min(c for c, *_ in found)
    return cost, band.backtrace([(length, s) for c, length, s in found if c == cost], cost)


def plan_of(audit: str) -> list[tuple[int, str | None]]:
    """(row, role) of each repaired turn: row -1 is inserted, role None stays as it is."""
    length = sum(c != "D" for c in audit)
    out, row = [], 0
    for c in audit:
        if c != "D":
            role = ("user", "assistant")[(len(out) + length % 2) % 2]
            out.append((-1 if c == "I" else row, None if c == "K" else role))
        row += c != "I"
    return out


def faults(rows: DataFrame) -> DataFrame:
    """Adds to rows (conv_id, turn, role, text): ``pos``, the place by turn (nulls first,
    then role and text), ``fault`` (blank, duplicate, truncated or null, the first that
    holds), ``illegal`` (whether its role may not follow the one before), ``turns_new``
    (whether a turn number is seen first)."""
    bare = F.regexp_replace("text", BLANK, "")
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("pos")
    rows = rows.withColumn("pos", F.row_number().over(place) - 1)
    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(Window.partitionBy("conv_id").orderBy("pos"))
    turn_before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("pos"))
    rows = rows.withColumns(
        {
            "initial": initial,
            "illegal": (F.col("pos") > 0) & ~F.concat(before, initial).isin("su", "ua", "au"),
            "turns_new": F.col("turn").isNotNull() & (turn_before.isNull() | (turn_before != F.col("turn"))),
        }
    )
    rows = rows.withColumn("again", F.row_number().over(same) > 1)
    fault = (
        F.when(bare == "", "blank").when(F.col("again"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return rows.withColumn("fault", fault).drop("again")


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal (counts),
    cost, audit (the edits in order: K, R, D, I), turns (array of role, text, edit).

    Takes the columns conv_id, turn, role, text, and ``alive`` if there is one (rows for
    which it is false only keep their conversation in the result); others are ignored.
    Null roles and texts count as one space, a null id is a conversation of its own,
    null turns come first and are no gap. Repeated rows are duplicates. Rows equal in
    turn go by role and text. A conversation without rows gives an empty audit; an empty
    table gives no rows. A conversation is one row of the result, so it has to fit in
    one; only a letter per turn goes through the alignment, whose memory is bounded by
    ``CELLS`` and the square root of the number of turns times the width of the band.
    """
    import_in_workers(conversations.sparkSession)
    alive = F.coalesce(F.col("alive"), F.lit(True)) if "alive" in conversations.columns else F.lit(True)
    space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")}
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *space.values(), alive.alias("alive"))
    rows = rows.repartition("conv_id")  # windows and groups below need no other shuffle
    known = faults(rows.where("alive")).unionByName(rows.where("not alive"), allowMissingColumns=True)
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    item = F.when(F.col("alive"), F.struct("pos", "role", "text", letter.alias("letter")))

    def count(condition: Column) -> Column:
        return F.count_if(condition)

    turn = F.when(F.col("alive"), F.col("turn"))
    gaps = F.max(turn) - F.min(turn) + 1 - count(F.col("turns_new"))
    one = known.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
        F.array_sort(F.collect_list(item)).alias("given"),
    )
    one = one.withColumn("code", F.array_join(F.transform("given", lambda g: g["letter"]), ""))

    @F.pandas_udf(PLAN)
    def plans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        remember = functools.lru_cache(REMEMBERED)(lambda code: (*(x := align(code)), plan_of(x[1])))
        for codes in batches:
            found = [remember(code) for code in codes]
            yield pd.DataFrame(
                {
                    "cost": np.array([c for c, *_ in found], np.int64),
                    "audit": [a for _, a, _ in found],
                    "plan": [[{"row": r, "role": role} for r, role in p] for *_, p in found],
                }
            )

    def turn_of(p: Column) -> Column:
        row = F.get("given", p["row"])
        edit = F.when(p["row"] < 0, "I").when(p["role"].isNull(), "K").otherwise("R")
        return F.struct(F.coalesce(p["role"], row["role"]).alias("role"), F.coalesce(row["text"], F.lit("")).alias("text"), edit.alias("edit"))

    # The code alone goes to Python; the texts stay where they are.
    one = one.withColumn("p", plans("code"))
    return one.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "p.cost", "p.audit", F.transform("p.plan", turn_of).alias("turns")
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive): rows with faults set by crc32(``conv_id:turn``) % 20
    (nulls: one space): 0 drops the row, 1 empties its text, 2 removes its [.!?], 3
    repeats it, 4 makes its role user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("alive"), times.alias("time")).drop("time")


def repair_digest(conversations: DataFrame) -> DataFrame:
    out = repaired(damaged(conversations))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("turns")
