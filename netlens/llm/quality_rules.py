"""Quality rules on documents, and a verdict on hosts from the rate of failures.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import BLANK, join_checked, saved, text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
# A host whose shrunk failure rate is above this is rejected with all its documents.
MAX_HOST_RATE = 0.5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row: an inner function sees it as
    a variable, so nothing is computed again per element."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text."""

    def from_hashes(hashes: Column) -> Column:
        def from_pairs(pairs: Column) -> Column:
            # Sorted by (hash, position), equal windows are neighbours.
            def again(pair: Column, k: Column) -> Column:
                before = F.get(pairs, k - 1)["h"] == pair["h"]
                after = F.get(pairs, k + 1)["h"] == pair["h"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            at = F.transform(F.filter(pairs, again), lambda p: p["i"])
            return F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), from_pairs)
        )

    def from_words(w: Column) -> Column:
        n = F.size(w)
        starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
        return _let(F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), from_hashes)

    return from_words(words).cast("long")


def rule_figures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_rules(documents: DataFrame) -> DataFrame:
    """(row, host, figures, base_failed): ``row`` is the whole input row as a struct, so
    no column of the input can clash. A null text has no words and fails."""
    text = text_of("text")
    rows = documents.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("host"), text.alias("t"))

    # One inner function sees the words as a variable: the text is split once.
    def figures(words: Column) -> Column:
        lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(*[c.alias(k) for k, c in rule_figures(F.col("t"), words, lines).items()])

    words = F.filter(F.split(F.col("t"), BLANK + "+"), lambda w: w != "")
    rows = rows.withColumn("f", _let(words, figures)).select("row", "host", *[F.col(f"f.{k}").alias(k) for k in FIGURES])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_verdicts(figures: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate, rejected): the rate is the mean of the posterior
    under a beta prior fitted to all hosts by moments, so a host with few documents is
    judged near the common rate and one with many by its own.

    Rows without a host are left out. With one host, or where hosts differ no more than
    chance explains, the prior is as strong as all documents together and the rate is
    near the common one.
    """
    per_host = (
        figures.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )
    per_host = per_host.withColumn("raw", F.col("n_failed") / F.col("n_docs"))
    # Moments over hosts, all sums, so they combine before any shuffle: n, mean and the
    # spread between hosts that sampling does not explain.
    moments = per_host.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n_docs").cast("double").alias("n"),
        F.sum(F.col("n_docs").cast("double") ** 2).alias("n2"),
        F.sum("n_failed").cast("double").alias("k"),
        F.sum(F.col("n_docs") * F.col("raw") ** 2).alias("s2"),
    )
    mean = F.col("k") / F.col("n")
    between = F.col("s2") - F.col("n") * mean**2
    chance = mean * (1 - mean)
    explained = F.col("n") - F.col("n2") / F.col("n")
    spread = (between - chance * (F.col("hosts") - 1)) / explained
    strength = F.when((F.col("hosts") > 1) & (explained > 0) & (spread > 0), F.greatest(chance / spread - 1, F.lit(0.0))).otherwise(F.col("n"))
    prior = moments.select(mean.alias("mean"), F.least(strength, F.col("n")).alias("strength")).first()
    mean, strength = F.lit(prior["mean"]), F.lit(prior["strength"])
    rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return per_host.select("host", "n_docs", "n_failed", rate.alias("rate"), F.coalesce(rate > MAX_HOST_RATE, F.lit(False)).alias("rejected"))


def judge(documents: DataFrame) -> DataFrame:
    """``base_rules`` plus ``kept``: false if the document fails or its host is rejected.

    Documents without a source have no host and are judged by themselves. Repeated rows
    and rows without an id are rows like others; an empty table gives no rows. The
    figures are written once, and both the host aggregate and the join read them.
    """
    return with_verdict(saved(base_rules(documents)))


def with_verdict(figures: DataFrame) -> DataFrame:
    bad = host_verdicts(figures.select("host", "base_failed")).where("rejected").select(F.col("host").alias("bad_host"))
    out = join_checked(figures, bad, F.col("host") == F.col("bad_host"), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("bad_host").isNull()).drop("bad_host", "host")


def quality_digest(documents: DataFrame) -> DataFrame:
    out = judge(documents.select("doc_id", "text", "source"))
    return out.select(F.col("row.doc_id").alias("doc_id"), *FIGURES, "base_failed", "kept")


def keep_good(documents: DataFrame) -> DataFrame:
    """Rows of ``documents`` that pass, with their own columns."""
    return judge(documents).where("kept").select("row.*")
