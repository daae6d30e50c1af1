"""Physical-plan shape: pruned scans, pushed filters, bounded broadcasts."""

from conftest import SF_SMALL
from labelpool.plans import catalog
from labelpool.sources import pools


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pool_scan_prunes_columns(spark):
    p = plan(pools.order_pool(spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double>" in p


def test_answers_filter_pushed_down(spark):
    p = plan(catalog.q_apply_labels(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)" in p
    assert "BroadcastExchange" in p


def test_no_python_udf_in_sql_checked_plans(spark):
    for key in ["uncertainty_score", "stratified_sample", "speed_up", "classification_metrics"]:
        p = plan(catalog.QUERIES[key](spark, SF_SMALL))
        assert "EvalPython" not in p, key


def test_one_scan_per_source(spark):
    spark.catalog.clearCache()   # earlier queries may have cached the same pool
    p = plan(catalog.q_class_distribution(spark, SF_SMALL))
    assert p.count("FileScan parquet") == 1
    p = plan(catalog.q_apply_labels(spark, SF_SMALL))
    assert p.count("FileScan parquet") == 2          # lineitem once, orders once


def test_pool_partitions_fit_the_rows(spark):
    from labelpool.config import MAX_BUCKETS
    from labelpool.plans import prepare, store
    cores = spark.sparkContext.defaultParallelism
    assert prepare.pool_partitions(spark, 1, 4) == 1
    assert prepare.pool_partitions(spark, 147_000, 4) <= cores           # 12 MB: the cores, not the estimate of a join
    assert prepare.pool_partitions(spark, 10 ** 9, 28) == -(-10 ** 9 * 272 // (64 << 20))
    one = spark.createDataFrame([(1, 0)], "id_sample long, label int")
    assert store.state_buckets(one) == 1
    assert store.state_buckets(spark.range(100_000), rows_per_bucket=1) == MAX_BUCKETS


def test_subsets_read_their_source_once(spark):
    p = plan(catalog.q_prepare_subsets(spark, SF_SMALL))
    assert "FileScan" not in p            # the sample was kept in the shared folder


def test_all_subsets_in_one_write(spark, tmpdir_path):
    import os
    from labelpool.plans import prepare
    prepare.write_subsets(catalog.q_prepare_subsets(spark, SF_SMALL), tmpdir_path + "/sets")
    assert sorted(d for d in os.listdir(tmpdir_path + "/sets") if "=" in d) == sorted(f"percentage_set={p}" for p in (10, 20, 40, 80, 100))
