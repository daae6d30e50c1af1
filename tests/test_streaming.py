"""Answer files folded into the pool by a stream equal the batch flip."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from labelpool.operators import labels as Lb
from labelpool.plans import catalog
from labelpool.streaming import answers_stream, pool_with_answers, start_answer_sink


def test_stream_fold_equals_batch(spark, tmpdir_path):
    pool = catalog._order_train_state(spark, SF_SMALL).select("id_sample", "label", "state")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    answers = orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")
    src = os.path.join(tmpdir_path, "incoming")
    # two arrivals of files, replayed from the given table
    answers.filter(F.col("o_orderkey") % 2 == 0).write.parquet(os.path.join(src, "a"))
    answers.filter(F.col("o_orderkey") % 2 == 1).write.parquet(os.path.join(src, "b"))
    table = os.path.join(tmpdir_path, "answers_table")
    stream = answers_stream(spark, os.path.join(src, "*"), answers.schema, max_files_per_trigger=1)
    q = start_answer_sink(stream, table, "o_orderkey",
                          checkpoint_location=os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination()
    got = {tuple(r) for r in pool_with_answers(spark, pool, table).collect()}
    want = {tuple(r) for r in Lb.apply_labels(pool, answers, arrival_id="o_orderkey").collect()}
    assert got == want
    assert spark.read.parquet(table).select("batch_id").distinct().count() >= 2


def test_stream_into_pool_state_with_answers(spark, tmpdir_path):
    from labelpool.plans.store import PoolState
    pool = catalog._order_train_state(spark, SF_SMALL).select("id_sample", "label", "state")
    store = PoolState(spark, pool, n_buckets=4)
    u = pool.filter(F.col("state") == "U").select("id_sample", "label")
    ans = u.select(F.col("id_sample").alias("oid"), (1 - F.col("label")).alias("y"))  # flipped answers
    src = os.path.join(tmpdir_path, "incoming")
    ans.write.parquet(src)
    q = start_answer_sink(answers_stream(spark, src, ans.schema), None, "oid", label_col="y",
                          checkpoint_location=os.path.join(tmpdir_path, "ck2"), store=store)
    q.awaitTermination()
    fr = store.frame()
    assert fr.filter(F.col("state") == "U").count() == 0
    got = {r.id_sample: r.label for r in fr.collect()}
    want = {r.id_sample: 1 - r.label for r in u.collect()}
    assert all(got[i] == y for i, y in want.items())
    store.close()
