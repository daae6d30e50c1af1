"""Seeded sampling: split, state, strata, ids, subsets, random batches."""

import pytest
from pyspark.sql import functions as F

from labelpool.operators import pool as P
from labelpool.operators import sampling as S


@pytest.fixture(scope="module")
def base(spark):
    df = spark.range(5000).select(F.col("id").alias("id_sample"),
                                  (F.col("id") % 7 == 0).cast("int").alias("label"))
    return df


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_split_and_state_layout_independent(spark, base, parts):
    ref_train, _ = S.train_test_split(base)
    train, test = S.train_test_split(base.repartition(parts))
    assert sorted(r[0] for r in train.select("id_sample").collect()) == \
        sorted(r[0] for r in ref_train.select("id_sample").collect())
    assert train.count() + test.count() == 5000
    assert train.join(test, "id_sample").count() == 0
    st = P.init_state(train)
    c = P.state_counts(st).first()
    assert c.labeled + c.unlabeled == c.total == train.count()


def test_stratified_exact_quota(spark, base):
    out = S.stratified_sample(base, 1000)
    got = {r.label: r.n for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1 = 5000 // 7 + 1
    assert got[1] == round(1000 * n1 / 5000) and got[0] == round(1000 * (5000 - n1) / 5000)


def test_sample_larger_than_data_raises(spark, base):
    with pytest.raises(ValueError):
        S.stratified_sample(base, 6000)


def test_dense_ids_and_nested(spark, base):
    ids = S.assign_dense_ids(base.withColumnRenamed("id_sample", "src"), "src", "id_sample")
    vals = sorted(r[0] for r in ids.select("id_sample").collect())
    assert vals == list(range(5000))
    nest = S.nested_subsets(ids, 5000)
    sets = {p: {r.src for r in nest.filter(F.col("percentage_set") == p).collect()} for p in (10, 20, 40, 80, 100)}
    assert [len(sets[p]) for p in (10, 20, 40, 80, 100)] == [500, 1000, 2000, 4000, 5000]
    assert sets[10] <= sets[20] <= sets[40] <= sets[80] <= sets[100]


@pytest.mark.parametrize("budget", [0, 1, 37, 10_000])
def test_random_selection_invariants(spark, base, budget):
    st = P.init_state(base, 0.05).persist()
    u0 = {r[0] for r in P.unlabeled_rows(st).select("id_sample").collect()}
    l0 = {r[0] for r in P.labeled_rows(st).select("id_sample").collect()}
    new = S.random_selection(st, budget, round_no=3)
    l1 = {r[0] for r in P.labeled_rows(new).select("id_sample").collect()}
    assert new.count() == st.count()
    assert l0 <= l1
    assert len(l1 - l0) == min(budget, len(u0))
    assert (l1 - l0) <= u0


def test_random_rounds_differ(spark, base):
    st = P.init_state(base, 0.05)
    a = {r[0] for r in S.random_batch(st, 50, round_no=1).collect()}
    b = {r[0] for r in S.random_batch(st, 50, round_no=2).collect()}
    assert a != b


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_strata_and_batches_layout_independent(spark, base, parts):
    ref = {r[0] for r in S.stratified_sample(base, 800).select("id_sample").collect()}
    got = {r[0] for r in S.stratified_sample(base.repartition(parts), 800).select("id_sample").collect()}
    assert got == ref
    st = P.init_state(base, 0.05)
    ref_b = {r[0] for r in S.random_batch(st, 40, round_no=2).collect()}
    got_b = {r[0] for r in S.random_batch(st.repartition(parts), 40, round_no=2).collect()}
    assert got_b == ref_b


def test_strata_by_shuffled_join(spark, monkeypatch):
    from labelpool.operators import sampling as S_
    df = spark.range(500).selectExpr("id AS id_sample", "cast(id % 7 AS int) AS label")
    want = sorted(map(tuple, S_.stratified_sample(df, 100).collect()))
    monkeypatch.setattr(S_, "BROADCAST_MAX_ROWS", 1)
    assert sorted(map(tuple, S_.stratified_sample(df, 100).collect())) == want


def test_answers_do_not_depend_on_layout(spark):
    from labelpool.operators.labels import apply_labels
    pool = spark.range(50).selectExpr("id AS id_sample", "0 AS label", "'U' AS state")
    ans = spark.createDataFrame([(i % 20, (i * 7) % 3 % 2, i) for i in range(200)], "oid long, y int, at int")
    got = {n: sorted(map(tuple, apply_labels(pool, ans.repartition(n), arrival_id="oid", arrival_label="y", arrival_order="at").collect()))
           for n in (1, 4, 17)}
    assert got[1] == got[4] == got[17]
    last = {i % 20: (i * 7) % 3 % 2 for i in range(200)}
    assert all(r[1] == last[r[0]] for r in got[1] if r[2] == "L")
