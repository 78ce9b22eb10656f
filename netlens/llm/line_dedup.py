"""Line dedup: lines found in many documents are dropped from every document.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import BLANKS, saved, small, text_of

MIN_CHARS = 1
MIN_DOCS = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else. ``lower`` does it in one pass wherever the text has
    no other upper-case letter; only those with one take the slow per-character way."""
    other = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only | ~other, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    """64-bit hash of the normalised line; null if shorter than ``MIN_CHARS``."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.when(F.char_length(key) >= MIN_CHARS, F.xxhash64(ascii_lower(key)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def frequent_lines(documents: DataFrame, min_docs: int) -> DataFrame:
    """Hashes of lines found in at least ``min_docs`` documents (rows of the table).

    A document's lines are made distinct inside its row, so counting needs one shuffle of
    partial counts; a line that all documents share arrives as one row per task.
    """
    keys = F.array_distinct(F.transform(lines_of(text_of("text")), line_key))
    return (
        documents.select(F.explode(keys).alias("h"))
        .where(F.col("h").isNotNull())
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs)
        .select("h")
    )


def drop_lines(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, n_lines, kept): the input row as a struct, its number of lines and the array
    of lines that stay, in order.

    Null and empty texts have one empty line, which has no key and stays. Repeated rows
    count as documents of their own; a null id is a value like others. Lines of a
    document meet again under (id, hash of the text): equal rows have equal lines, so
    they share one entry. Two different lines share a 64-bit hash with a probability of
    (frequent lines x lines) / 2^64 for the whole corpus.
    """
    frequent = saved(frequent_lines(documents, min_docs))
    rows = documents.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_of("text").alias("t")
    ).withColumn("th", F.xxhash64("t"))
    lines = documents.select(F.col("doc_id").alias("id"), text_of("text").alias("t")).select(
        "id", F.xxhash64("t").alias("th"), F.posexplode(lines_of(F.col("t"))).alias("pos", "line")
    )
    hits = lines.select("id", "th", "pos", line_key(F.col("line")).alias("h")).where(F.col("h").isNotNull())
    # Without a broadcast, a line of very many documents is one hot key of a shuffle
    # join, which adaptive execution splits.
    hits = hits.join(F.broadcast(frequent) if small(frequent) else frequent, "h", "left_semi")
    # collect_set: rows that repeat as a whole give their positions once.
    dropped = hits.groupBy("id", "th").agg(F.collect_set("pos").alias("dropped"))
    dropped = dropped.select(F.col("id").alias("did"), F.col("th").alias("dth"), "dropped").hint("shuffle_hash")
    joined = rows.join(dropped, F.col("id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("dth")), "left")
    n = F.size(lines_of(F.col("t")))
    # Positions are taken away as a set, in time linear to the lines.
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("dropped", F.array().cast("array<int>")))
    keep = F.transform(F.array(lines_of(F.col("t"))), lambda ls: F.transform(stay, lambda i: F.get(ls, i)))[0]
    return joined.select(
        "row", n.cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), lines_of(F.col("t"))).otherwise(keep).alias("kept")
    )


def line_digest(documents: DataFrame) -> DataFrame:
    out = drop_lines(documents.select("doc_id", "text"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


def without_common_lines(documents: DataFrame) -> DataFrame:
    """``documents`` with its own columns, less the frequent lines; texts that were null
    stay null."""
    out = drop_lines(documents)
    text = F.when(F.col("row.text").isNotNull(), F.array_join("kept", "\n"))
    return out.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
