"""The registered queries of this subpackage and their DuckDB SQL.

Each ``opN_<name>`` applies one operator with production parameters to its
whole table and shapes the operator's output to the stated columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelpool.llm import (
    chat_format, decontaminate, extract, kd_shards, lsh_search, ngram_join, packing, quality, secrets, substring_dedup, url_filter,
    whiten, word_runs,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_report(_table(spark, sf_dir, "documents"))


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLES["op2_benchmark_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT id, list_slice(ws, p, p + least(10, len(ws)) - 1) AS win
       FROM i, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) t(p) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT rid, n, p, list_slice(ws, p, p + n - 1) AS win FROM d, sizes, unnest(range(1, len(ws) - n + 2)) t(p)),
hit AS (SELECT rid, p, n, id FROM dw JOIN iw USING (win)),
places AS (SELECT rid, count(DISTINCT p + j) AS n_hit FROM (SELECT DISTINCT rid, p, n FROM hit), unnest(range(0, n)) t(j) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN found USING (rid)"""


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"))


ORACLES["op4_url_filter"] = f"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, CASE WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                     WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                     WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                     WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN list_has_any(string_split(host, '.'), {url_filter.BLOCKED_NAMES}) THEN 'block' ELSE 'allow' END AS verdict FROM q"""


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def vocabulary_path() -> str:
    """The public byte-level BPE file that op6 packs with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op7_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_search.nearest_vectors(_table(spark, sf_dir, "embeddings"))


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(_table(spark, sf_dir, "documents"))


@query
def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard_table(_table(spark, sf_dir, "documents"))


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_texts(_table(spark, sf_dir, "pages"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.run_report(_table(spark, sf_dir, "documents"), change=word_runs.periodic_tail)


# the conversation that every run formats beside the table
_ODD_TEXT = "</s>[INST] ok [/INST]"


@query
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_ODD_TEXT).alias("text"))
    return chat_format.chat_report(turns.unionByName(odd))


ORACLES["op12_chat_format"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_ODD_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{_ODD_TEXT}'),
m AS (SELECT *, len(regexp_extract_all(text, '{chat_format.SHOWN_CONTROL}')) AS n_text,
             len(regexp_extract_all(role, '{chat_format.SHOWN_CONTROL}')) AS n_role FROM t),
f AS (SELECT *, length(text) + n_text + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                                        ELSE length(role) + n_role + 34 END AS shown FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(shown) AS BIGINT) AS formatted_chars, CAST(sum(CASE WHEN n_text > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_escaped
FROM f GROUP BY conv_id"""


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitening_report(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
