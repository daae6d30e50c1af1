"""Rounds and the loop on the order pool (P1): the invariants of the state."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from labelpool.operators import pool as P
from labelpool.plans import loop, prepare
from labelpool.plans.store import PoolState
from labelpool.sources import pools


@pytest.fixture(scope="module")
def prepared(spark):
    train, test = prepare.prepare_pool(pools.order_pool(spark, SF_SMALL))
    return loop.settle(train, None, False), loop.settle(test, None, False)


def ids(df):
    return {r[0] for r in df.select("id_sample").collect()}


@pytest.mark.parametrize("mode", ["table", "memory"])
@pytest.mark.parametrize("method", ["smart", "random"])
def test_round_invariants(spark, prepared, method, mode):
    train, test = prepared
    l0, u0 = ids(P.labeled_rows(train)), ids(P.unlabeled_rows(train))
    state = PoolState(spark, train) if mode == "table" else train
    res = loop.active_round(spark, state, test, method)
    new = res.pool
    l1, u1 = ids(P.labeled_rows(new)), ids(P.unlabeled_rows(new))
    picked = l1 - l0
    assert l1 | u1 == l0 | u0 and not (l1 & u1)        # L ∪ U = train, L ∩ U = ∅
    assert l0 <= l1 and picked <= u0                    # |L| never shrinks; picked ⊆ U
    assert 0 < len(picked) <= res.budget
    assert not (picked & ids(test))                     # test rows never picked
    assert new.count() == train.count()
    if method == "random":
        assert len(picked) == res.budget
    if mode == "table":
        state.close()
    else:
        # keep the module fixture usable
        new.unpersist()


@pytest.mark.parametrize("mode", ["table", "memory"])
def test_loop_curve(spark, prepared, mode):
    train, test = prepared
    _, curve = loop.active_loop(spark, train, test, "random", rounds=2, state=mode)
    rows = curve.orderBy("round").collect()
    assert [r.round for r in rows] == [0, 1, 2]
    assert [r.labeled_percentage for r in rows] == [5.0, 6.0, 7.0]
    assert rows[0].labeled_count < rows[1].labeled_count < rows[2].labeled_count
    assert rows[-1].accuracy >= rows[0].accuracy - 0.05


def test_unknown_strategy(spark, prepared):
    with pytest.raises(ValueError):
        loop.strategy("clever")


def test_empty_unlabelled_pool_unchanged(spark, prepared):
    train, test = prepared
    all_l = train.withColumn("state", F.lit("L"))
    res = loop.active_round(spark, all_l, test, "smart")
    assert res.budget == 0 and res.pool is all_l


def test_table_state_flip_has_no_exchange(spark, prepared):
    train, _ = prepared
    store = PoolState(spark, train)
    plan = store.frame()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan      # small labels: broadcast at most
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = store.frame()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan                   # large labels: co-bucketed, no shuffle
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    finally:
        spark.conf.set(key, before)
    store.close()


def test_duplicate_ids_rejected(spark, prepared):
    train, _ = prepared
    with pytest.raises(ValueError):
        PoolState(spark, train.unionByName(train.limit(3)))


def test_no_labelled_rows(spark, prepared):
    train, test = prepared
    none_l = train.withColumn("state", F.lit("U"))
    with pytest.raises(ValueError):
        loop.active_round(spark, none_l, test, "random")


def test_single_class_in_labelled(spark, prepared):
    train, test = prepared
    one = train.withColumn("state", F.when((F.col("label") == 1) & (F.col("state") == "L"), "L")
                           .otherwise("U"))
    res = loop.active_round(spark, one, test, "random", checkpoint=False)
    assert res.budget > 0 and 0.0 <= res.accuracy <= 1.0


def test_state_leaves_nothing_behind(spark, prepared):
    import os
    train, test = prepared
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    tables = len(spark.catalog.listTables())
    store = PoolState(spark, train, n_buckets=4)
    root = store.root.replace("file:", "")
    for t in (1, 2):
        loop.active_round(spark, store, test, "random", round_no=t)
        files = [f for _, _, names in os.walk(f"{root}/labels") for f in names if f.startswith("part-")]
        assert len(files) <= 4 * (t + 1)                # at most one file a bucket and append
    store.compact()
    assert not os.path.exists(f"{root}/labels")         # the superseded version is gone
    store.close()
    assert not os.path.exists(root)
    final, curve = loop.active_loop(spark, train, test, "random", rounds=2)
    assert curve.count() == 3 and final.count() == train.count()
    assert len(spark.catalog.listTables()) == tables
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= cached + 1


def test_fit_keeps_the_scan_parallel(spark, prepared):
    train, _ = prepared
    rows = P.labeled_rows(train)
    plan = rows.select("label", "features").repartition(loop.fit_partitions(rows, 100))._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "Exchange" in plan
    assert loop.fit_partitions(rows, 100) == 1 < loop.fit_partitions(rows, 10_000_000)


def test_plan_stays_flat_over_rounds(spark, prepared):
    train, test = prepared
    store = PoolState(spark, train)
    sizes = []
    for t in (1, 2, 3):
        res = loop.active_round(spark, store, test, "random", round_no=t)
        sizes.append(len(res.pool._jdf.queryExecution().logical().toString()))
    assert max(sizes) - min(sizes) < 200      # two file scans and a join, whatever the round
    store.close()


@pytest.mark.parametrize("method", ["smart", "random"])
def test_learning_curve_does_not_degrade(spark, method):
    from conftest import SF_MID
    train, test = prepare.prepare_pool(pools.order_pool(spark, SF_MID))
    _, curve = loop.active_loop(spark, train, test, method, rounds=3)
    acc = [r.accuracy for r in curve.orderBy("round").collect()]
    assert acc[-1] >= acc[0] - 0.01


def test_compaction_keeps_state(spark, prepared):
    train, test = prepared
    store = PoolState(spark, train, n_buckets=4)
    for t in (1, 2):
        loop.active_round(spark, store, test, "random", round_no=t)
    before = sorted(map(tuple, store.frame().select("id_sample", "state", "label").collect()))
    store.compact()
    after = sorted(map(tuple, store.frame().select("id_sample", "state", "label").collect()))
    assert before == after
    assert spark.table(store.labels_table).count() == spark.table(store.labels_table).select("id_sample").distinct().count()
    store.close()


def test_topk_candidate_mode(spark, prepared):
    train, test = prepared
    store = PoolState(spark, train)
    res = loop.active_round(spark, store, test, "smart", params=loop.Params(candidates="topk"))
    assert 0 < res.labeled - P.labeled_rows(train).count() <= res.budget
    store.close()


def test_a_stopped_loop_goes_on_to_the_same_curve(spark, prepared):
    train, test = prepared
    _, whole = loop.active_loop(spark, train, test, "smart", rounds=3, run_id="r")
    loop.active_loop(spark, train, test, "smart", rounds=1, run_id="r", tag="stopped", keep_state=True)
    with pytest.raises(ValueError):
        PoolState(spark, train, tag="stopped")
    with pytest.raises(ValueError):
        PoolState.open(spark, "unknown")
    state = PoolState.open(spark, "stopped")
    assert [r["round"] for r in state.records()] == [0, 1]
    state.add(state.frame().filter("state = 'U'").select("id_sample"), 2)   # a round that isn't committed
    state = PoolState.open(spark, "stopped")
    with pytest.raises(ValueError):
        loop.active_loop(spark, state, test, "random", rounds=3)
    final, curve = loop.active_loop(spark, state, test, "smart", rounds=3)
    state.close()
    assert sorted(map(tuple, curve.collect())) == sorted(map(tuple, whole.collect()))
    assert final.count() == train.count()


def test_state_join_sends_no_labels_through_the_driver(spark):
    train = spark.range(300).selectExpr("id as id_sample", "cast(id % 2 as int) as label", "array(cast(id as double)) as features",
                                        "if(id % 10 = 0, 'L', 'U') as state")
    store = PoolState(spark, train, n_buckets=4)
    frame = store.frame()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan     # under the broadcast threshold, too
    assert sorted(r.id_sample for r in frame.filter("state = 'L'").collect()) == list(range(0, 300, 10))
    store.add(spark.createDataFrame([(1,), (1,), (10,)], "id_sample long"), 1)
    assert (frame.count(), store.frame().filter("state = 'L'").count()) == (300, 31)
    store.close()
