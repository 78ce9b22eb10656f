"""Registered queries of the subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netlens.llm.chat_format import chat_digest
from netlens.llm.hard_negatives import negative_digest
from netlens.llm.language_id import language_digest
from netlens.llm.licenses import licence_digest
from netlens.llm.line_dedup import line_digest
from netlens.llm.mixing import mixing_digest
from netlens.llm.ngram_join import join_digest
from netlens.llm.packing import packing_digest
from netlens.llm.quality_rules import quality_digest
from netlens.llm.repeats import repeat_digest
from netlens.llm.topk_search import search_digest
from netlens.llm.toxicity import toxicity_digest
from netlens.llm.turn_repair import repair_digest

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """Public vocabulary that the packing query's contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def add(run):
        LLM_QUERIES[name] = run
        if sql:
            LLM_ORACLES[name] = sql
        return run

    return add


@query(
    "op1_chat_format",
    """
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    m AS (
      SELECT *, regexp_replace(text, '([<\\[])(\\\\*(?:/?s>|\\|im_start\\|>|\\|im_end\\|>|\\|nl\\|>|/?INST\\]))', '\\1\\\\\\2', 'g') AS safe FROM c)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(7 + sum(length('<|im_start|>' || role || chr(10) || safe || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
    FROM m GROUP BY conv_id
    """,
)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digest(table(spark, sf_dir, "conversations"))


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"))


@query(
    "op10_line_dedup",
    """
    WITH lines AS (
      SELECT doc_id, i, line, regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '') AS bare
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
              unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
    keyed AS (SELECT doc_id, i, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.key IS NULL), '')) AS kept_sha256
    FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY doc_id
    """,
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_digest(table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(table(spark, sf_dir, "documents"), tokenizer_file())


@query(
    "op4_topk_search",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r WHERE rank <= 10
    """,
)
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_digest(table(spark, sf_dir, "embeddings"))


@query("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_digest(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_digest(table(spark, sf_dir, "documents"))


@query(
    "op11_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (
      SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
      WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negative_digest(table(spark, sf_dir, "embeddings"))


@query("op12_turn_repair")
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(table(spark, sf_dir, "conversations"))


@query(
    "op13_repeats",
    """
    WITH t AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (
      SELECT k, p, hash(b[p + 1 : p + 200]) AS x
      FROM (SELECT k, b, unnest(range(0, CAST(len(h) / 2 - 199 AS BIGINT))) AS p FROM t WHERE len(h) >= 400)),
    r AS (SELECT k, p FROM w WHERE x IN (SELECT x FROM w GROUP BY x HAVING count(*) > 1)),
    g AS (SELECT k, p, CASE WHEN p - lag(p) OVER (PARTITION BY k ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM r),
    i AS (SELECT k, p, sum(fresh) OVER (PARTITION BY k ORDER BY p) AS span FROM g),
    s AS (SELECT k, min(p) AS low, max(p) + 200 AS high FROM i GROUP BY k, span),
    e AS (
      SELECT k, low, high, coalesce(lag(high) OVER (PARTITION BY k ORDER BY low), 0) AS past, lead(low) OVER (PARTITION BY k ORDER BY low) IS NULL AS final FROM s),
    c AS (
      SELECT t.k, count(*) AS n_spans, sum(high - low) AS n_removed,
        string_agg(substr(h, 2 * past + 1, 2 * (low - past)) || CASE WHEN final THEN substr(h, 2 * high + 1) ELSE '' END, '' ORDER BY low) AS kept
      FROM t JOIN e ON t.k = e.k GROUP BY t.k)
    SELECT doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM t LEFT JOIN c ON t.k = c.k
    """,
)
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"))
