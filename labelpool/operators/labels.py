"""Folding answers into the pool: the U → L flip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.config import BROADCAST_MAX_ROWS
from labelpool.operators.pool import LABELED


def apply_labels(pool: DataFrame, arrivals: DataFrame, id_col: str = "id_sample",
                 arrival_id: str | None = None, arrival_label: str | None = None,
                 n_arrivals: int | None = None, state_col: str = "state",
                 label_col: str = "label", arrival_order: str | None = None) -> DataFrame:
    """Mark the rows named in ``arrivals`` as labelled.

    ``arrivals`` is any table of answers ``(id[, label])``; when it carries a
    label, that answer replaces the pool's label. Of several answers for an id
    the one with the largest ``arrival_order`` holds, and among equals (or without
    an order) the largest label, whatever the layout of the rows. There is one row
    per id first, so the left join never multiplies pool rows. The pool is not
    shuffled when the answer table is small: it is broadcast only when its row
    count (``n_arrivals``, or counted here) is under the configured bound;
    otherwise it is a shuffled join, and a pool already hash-partitioned on
    the id keeps its partitioning.
    """
    aid = arrival_id or id_col
    cols = [F.col(aid).alias("_lp_sel")]
    if arrival_label:
        cols.append(F.col(arrival_label).alias("_lp_ans"))
    if arrival_label:
        order = F.col(arrival_order) if arrival_order else F.lit(0)
        answers = arrivals.select(*cols, order.alias("_lp_ord")).groupBy("_lp_sel").agg(
            F.max(F.struct("_lp_ord", "_lp_ans"))["_lp_ans"].alias("_lp_ans"))
    else:
        answers = arrivals.select(*cols).distinct()
    if n_arrivals is None:
        n_arrivals = answers.count()
    if n_arrivals <= BROADCAST_MAX_ROWS:
        answers = F.broadcast(answers)
    joined = pool.join(answers, pool[id_col] == answers["_lp_sel"], "left")
    hit = F.col("_lp_sel").isNotNull()
    out = joined.withColumn(state_col, F.when(hit, F.lit(LABELED)).otherwise(F.col(state_col)))
    if arrival_label:
        out = out.withColumn(label_col, F.when(hit, F.col("_lp_ans").cast("int")).otherwise(F.col(label_col)))
        out = out.drop("_lp_ans")
    return out.drop("_lp_sel").select(*pool.columns)
