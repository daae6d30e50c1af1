"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that, written and reread, is the next one's ``docs``. All but
the last return the columns of ``docs``.

* quality: documents that the classifier rejects (score under 0.3) go.
* near_duplicates: one document of each group of similar documents (Jaccard similarity
  of their 5-word shingles 0.8 or more) stays, the one with the smallest id.
  A group is a whole chain of such links, so a document that goes can be unlike the one kept.
* decontaminate: documents that hold a 10-word window of a benchmark item go.
* secrets: spans of secrets are replaced in the text; ``n_chars`` follows.
* packing: the remaining texts as pieces of sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelpool.llm import decontaminate, ngram_join, packing, quality, queries, secrets
from labelpool.llm.batches import checkpointed

KEEP_SCORE = 0.3
SIMILAR_PERCENT, SIMILAR_WORDS = 80, 5   # the stage's own; op8's are another contract
ORACLE_SQL = None   # two stages run trained models


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, trees, out="_score").filter(F.col("_score") >= KEEP_SCORE).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, percent=SIMILAR_PERCENT, width=SIMILAR_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.vocabulary_path())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", hide_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are checkpointed for the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
