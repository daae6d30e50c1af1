"""Fold answer files into an append-only answers table, exactly once.

``foreachBatch`` writes micro-batch ``b`` to ``<table>/batch_id=b`` with
overwrite semantics, so a batch replayed after a failure rewrites the same
folder instead of appending twice; the stream's progress lives in a
checkpoint location under the shared ``spark.checkpoint.dir``. The pool's
current state is then a pure function of that table
(:func:`pool_with_answers`): no mutable pool file is ever rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labelpool.operators.labels import apply_labels


def answers_stream(spark: SparkSession, source_dir: str, schema: T.StructType,
                   fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame over answer files ``(id[, label])`` landing in a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir)


def start_answer_sink(answers: DataFrame, table_path: str | None, id_col: str,
                      label_col: str | None = None, *, checkpoint_location: str,
                      available_now: bool = True, store=None) -> StreamingQuery:
    """Start the stream that appends each micro-batch of answers to the
    table at ``table_path``, or straight into a
    :class:`labelpool.plans.store.PoolState` (``store``), whose state groups
    labels by id, so a replayed micro-batch changes nothing. Every stream needs a
    ``checkpoint_location`` of its own that outlives the session."""
    cols = [F.col(id_col).cast("bigint").alias("answer_id")]
    if label_col:
        cols.append(F.col(label_col).cast("int").alias("answer_label"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*cols)   # of several answers in a batch, the largest label holds
        rows = rows.groupBy("answer_id").agg(F.max("answer_label").alias("answer_label")) if label_col else rows.distinct()
        if store is not None:
            store.add(rows, round_no=int(batch_id) + 1, id_col="answer_id",
                      answer_col="answer_label" if label_col else None)
            return
        rows.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")

    writer = answers.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def pool_with_answers(spark: SparkSession, pool: DataFrame, table_path: str,
                      id_col: str = "id_sample", with_labels: bool = False) -> DataFrame:
    """The pool with every answer received so far applied (latest batch wins
    for a relabelled id)."""
    answers = spark.read.parquet(table_path)
    if with_labels:
        return apply_labels(pool, answers, id_col=id_col, arrival_id="answer_id",
                            arrival_label="answer_label", arrival_order="batch_id")
    return apply_labels(pool, answers, id_col=id_col, arrival_id="answer_id")
