"""Scalability experiments: one timed round per (cores, dataset %) setting.

Each setting runs in its own ``local[cores]`` process (the core count of a
local session is fixed at start-up), times one round the way the published
experiments did (fit + test evaluation + select + flip + recount; load and
scaling excluded), and appends ``(method, percentage_set, cores, time)`` to
a run table with :func:`labelpool.sources.append_results`. The speed-up,
size-up and scale-up tables are then the run-analysis operators over it.

    python -m labelpool.plans.experiment --sf-dir /root/testdata/sf0.1 \\
        --out /shared/runs --cores 1,2,4,8 --sizes 10,40,100 --reps 3
"""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
import time

from pyspark.sql import functions as F


def one_round(sf_dir: str, out: str, cores: int, pct: int, method: str, rep: int = 1) -> None:
    from labelpool.operators import sampling
    from labelpool.plans import loop, prepare
    from labelpool.plans.store import PoolState
    from labelpool.session import ensure_checkpoint_dir, local_session
    from labelpool.sources import files, pools

    spark = local_session(cores, shuffle_partitions=max(1, cores), app=f"labelpool-{cores}c-{pct}pct")
    ensure_checkpoint_dir(spark)
    pool_all = pools.order_pool(spark, sf_dir)
    if pct < 100:
        pool_all = pool_all.persist()
        n = pool_all.count()
        ranked = sampling.assign_dense_ids(pool_all, "id_sample", "_dense", n_rows=n)
        pool_all = ranked.filter(F.col("_dense") < sampling.subset_cut(n, pct)).drop("_dense")
    train, test = prepare.prepare_pool(pool_all)
    test = loop.settle(test, None, checkpoint=False)
    store = PoolState(spark, train)
    labeled, unlabeled = loop.counts(store.frame())
    t0 = time.time()
    loop.active_round(spark, store, test, method, labeled=labeled, unlabeled=unlabeled)
    seconds = time.time() - t0
    row = spark.range(1).select(F.lit(method).alias("method"), F.lit(pct).cast("int").alias("percentage_set"),
                                F.lit(cores).cast("int").alias("cores"), F.lit(seconds).alias("time"))
    files.append_results(row.coalesce(1), out, run_id=f"{method}-{pct}pct-{cores}c-{rep}")   # a retried setting replaces its row
    store.close()
    spark.stop()


def summarize(out: str) -> None:
    from labelpool.operators import runs
    from labelpool.session import local_session
    from labelpool.sources import files

    spark = local_session(2, 2, app="labelpool-runs")
    means = runs.mean_runs(files.read_results(spark, out)).persist()
    for name, table in (("speed_up", runs.speed_up(means)), ("size_up", runs.size_up(means)),
                        ("scale_up", runs.scale_up(means))):
        print(f"== {name}")
        table.orderBy("method", "cores", "percentage_set").show(100, truncate=False)
    spark.stop()


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--out", required=True)
    ap.add_argument("--cores", default="1,2,4,8")
    ap.add_argument("--sizes", default="10,40,100")
    ap.add_argument("--reps", type=int, default=1)
    ap.add_argument("--method", default="smart")
    ap.add_argument("--single", action="store_true", help=argparse.SUPPRESS)
    a = ap.parse_args(argv)
    if a.single:
        one_round(a.sf_dir, a.out, int(a.cores), int(a.sizes), a.method, a.reps)
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for rep in range(1, a.reps + 1):
        for c in [int(x) for x in a.cores.split(",")]:
            for p in [int(x) for x in a.sizes.split(",")]:
                subprocess.run([sys.executable, "-m", "labelpool.plans.experiment", "--single",
                                "--sf-dir", a.sf_dir, "--out", a.out, "--cores", str(c), "--sizes", str(p),
                                "--method", a.method, "--reps", str(rep)], check=True, cwd=root)
    summarize(a.out)


if __name__ == "__main__":
    main()
