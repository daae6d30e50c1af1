"""Clustering, nearest-to-centroid, quotas, diverse batches."""

import random

import numpy as np

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelpool.operators import bisect, diversity as D
from labelpool.operators.bisect import bisect_cells, split_tree

CENTERS = "cluster_id int, center array<double>"


def test_nearest_to_centroid_brute_force_and_ties(spark):
    rnd = random.Random(5)
    pts = [(i, i % 3, [float(rnd.randint(0, 4)), float(rnd.randint(0, 4))]) for i in range(300)]
    df = spark.createDataFrame(pts, "id_sample long, cluster_id int, features array<double>")
    cen = {0: [1.0, 1.0], 1: [2.0, 3.0], 2: [0.5, 4.0]}
    centers = spark.createDataFrame(list(cen.items()), CENTERS)
    got = {r.cluster_id: (r.id_sample, r.distance) for r in D.nearest_to_centroid(df, centers).collect()}
    for c, ctr in cen.items():
        cand = [(sum((a - b) ** 2 for a, b in zip(v, ctr)), i) for i, cc, v in pts if cc == c]
        d, i = min(cand)  # equal distances → smaller id
        assert got[c] == (i, d)


def test_no_python_in_nearest_plan(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0])], "id_sample long, cluster_id int, features array<double>")
    centers = spark.createDataFrame([(0, [0.0, 0.0])], CENTERS)
    plan = D.nearest_to_centroid(df, centers)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def _cands(spark, n, distinct=None, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        j = rnd.randrange(distinct) if distinct else None
        v = [float(j), float(j * 2 % 5)] if distinct else [rnd.random(), rnd.random()]
        rows.append((i, Vectors.dense(v)))
    return spark.createDataFrame(rows, ["id_sample", "features"])


def test_fewer_distinct_vectors_than_budget(spark):
    cands = _cands(spark, 200, distinct=3)
    picked = D.diverse_batch(spark, cands, 50).collect()
    assert 1 <= len(picked) <= 50
    assert len(picked) == 3


def test_one_row_per_cluster_at_any_budget(spark):
    cands = _cands(spark, 400)
    clustered = D.cluster_candidates(cands, 40)
    assert clustered.select("cluster_id").distinct().count() == 40 and clustered.count() == 400
    by_cell = {r.id_sample: r.cluster_id for r in clustered.collect()}
    ids = [r.id_sample for r in D.diverse_batch(spark, cands, 40).collect()]
    assert len(ids) == 40 and len({by_cell[i] for i in ids}) == 40


def test_clusters_do_not_depend_on_layout(spark):
    cands = _cands(spark, 300)
    groups = []
    for n in (1, 7):
        cells = {}
        for r in D.cluster_candidates(cands.repartition(n), 12).collect():
            cells.setdefault(r.cluster_id, set()).add(r.id_sample)
        groups.append(sorted(map(sorted, cells.values())))
    assert groups[0] == groups[1]


def test_budget_of_all_rows_takes_distinct_vectors(spark):
    cands = _cands(spark, 12, distinct=3)
    n = cands.select("features").distinct().count()
    assert D.diverse_batch(spark, cands, 11).count() == D.diverse_batch(spark, cands, 12).count() == n


def test_budget_one_and_all(spark):
    cands = _cands(spark, 30)
    assert D.diverse_batch(spark, cands, 1).count() == 1
    assert D.diverse_batch(spark, cands, 30).count() == 30
    assert D.diverse_batch(spark, cands, 0).count() == 0


def test_wide_centers_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_MAX_BYTES", 8)
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [0.0, 0.0])],
                               "id_sample long, cluster_id int, features array<double>")
    centers = spark.createDataFrame([(0, [0.0, 0.1])], CENTERS)
    out = D.nearest_to_centroid(df, centers)
    assert [(r.cluster_id, r.id_sample) for r in out.collect()] == [(0, 2)]


def test_vector_pool_batch(spark):
    from conftest import SF_SMALL
    from labelpool.plans import catalog
    picked = [r.id_sample for r in catalog.q_vector_diversity(spark, SF_SMALL).collect()]
    ids = {r.vec_id for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id").collect()}
    n = len(ids)
    assert 1 <= len(picked) <= max(1, int(n * 0.01)) and set(picked) <= ids


def _groups(cells):
    out = {}
    for r in cells.select("id_sample", "cell").collect():
        out.setdefault(r.cell, set()).add(r.id_sample)
    return sorted(map(sorted, out.values()))


def test_cells_split_in_a_task_equal_those_of_common_passes(spark):
    cands = _cands(spark, 120).repartition(2)
    whole = _groups(bisect_cells(cands, 11, max_iter=3))
    assert len(whole) == 11
    assert _groups(bisect_cells(cands, 11, max_iter=3, task_rows=40)) == whole     # two levels of passes, then tasks
    assert _groups(bisect_cells(cands, 3, max_iter=3, task_rows=2)) == _groups(bisect_cells(cands, 3, max_iter=3))


def test_common_passes_write_rows_once_a_level(spark, monkeypatch):
    """A pass over few cells is one aggregate: no checkpoint but the rows' own, once a level."""
    cands = _cands(spark, 120).repartition(2)
    whole = _groups(bisect_cells(cands, 11, max_iter=4))
    made = []
    plain = type(cands).checkpoint
    monkeypatch.setattr(type(cands), "checkpoint", lambda df, *a, **k: made.append(df.columns) or plain(df, *a, **k))
    assert _groups(bisect_cells(cands, 11, max_iter=4, task_rows=70)) == whole     # one level of passes, then tasks
    assert sum("x" in c for c in made) <= 4 and len(made) <= 5      # the points, the level's rows, paths and their counts, the result
    monkeypatch.setattr(bisect, "CELLS_LOCAL_BYTES", 0)             # large tables of cells stay in Spark
    assert _groups(bisect_cells(cands, 11, max_iter=4, task_rows=70)) == whole


def test_split_tree_of_repeated_points():
    x = np.repeat(np.random.default_rng(3).standard_normal((7, 2)), 4, axis=0)
    nodes, lengths = split_tree(x, 10, 20, 1e-2)
    ends = nodes[np.cumsum(lengths) - 1]
    assert len(set(ends.tolist())) == 7 and all(len(set(ends[i:i + 4].tolist())) == 1 for i in range(0, 28, 4))
