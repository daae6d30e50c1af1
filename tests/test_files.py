"""Sources and sinks round-trip."""

import os

from pyspark.sql import functions as F

from labelpool.sources import files


def test_pool_csv_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(0, 1, 0.5, 2.0), (1, 0, 1.5, 3.0)],
                               "id_sample long, label int, feature_1 double, feature_2 double")
    path = os.path.join(tmpdir_path, "pool")
    files.write_table(df, path)
    back = files.load_pool(spark, path)
    assert back.columns == df.columns
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_append_results_header_once(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "runs")
    a = spark.createDataFrame([("smart", 10, 4, 20.5)], files.RUN_SCHEMA)
    files.append_results(a, path)
    files.append_results(a, path)
    back = files.read_results(spark, path)
    assert back.count() == 2 and back.filter(F.col("method") == "method").count() == 0


def test_headerless_csv(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "raw.csv")
    with open(path, "w") as fh:
        fh.write("1.0,0.5,0.25\n0.0,1.5,2.5\n")
    df = files.read_headerless_csv(spark, path, 2, partitions=2)
    assert df.columns == ["label", "feature_1", "feature_2"] and df.count() == 2


def test_staged_headerless_gzip(spark, tmpdir_path):
    import gzip
    import pyarrow.parquet as pq
    with gzip.open(os.path.join(tmpdir_path, "raw.csv.gz"), "wt") as fh:
        fh.writelines(f"{i % 2}.0,{i}.5,{'' if i == 7 else 'x' if i == 8 else i}\n" for i in range(2500))
    for n in (2500, 10):   # a second call replaces what the first has written
        out = files.stage_headerless_csv(spark, f"{tmpdir_path}/raw.csv.gz", f"{tmpdir_path}/staged", 2, rows_per_file=n)
    parts = [f for f in os.listdir(f"{tmpdir_path}/staged") if f.endswith(".parquet")]
    assert len(parts) == 250 and max(pq.read_metadata(f"{tmpdir_path}/staged/{f}").num_rows for f in parts) == 10
    assert sorted((r.feature_1, r.label, r.feature_2) for r in out.filter("feature_2 is not null").collect()) == [
        (i + 0.5, float(i % 2), float(i)) for i in range(2500) if i not in (7, 8)]
    assert out.count() == 2500
    with open(os.path.join(tmpdir_path, "empty.csv"), "w"):
        pass
    empty = files.stage_headerless_csv(spark, f"{tmpdir_path}/empty.csv", f"{tmpdir_path}/none", 2)
    assert empty.columns == ["label", "feature_1", "feature_2"] and empty.count() == 0


def test_experiment_summary_over_appended_runs(spark, tmpdir_path):
    import subprocess
    import sys as _sys
    path = os.path.join(tmpdir_path, "runs")
    rows = [("smart", 10, 1, 20.0), ("smart", 10, 4, 10.0), ("smart", 100, 1, 80.0), ("smart", 100, 4, 25.0)]
    for r in rows:   # one append per run, as the runner does
        files.append_results(spark.createDataFrame([r], files.RUN_SCHEMA), path)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([_sys.executable, "-c",
                          f"from labelpool.plans.experiment import summarize; summarize({path!r})"],
                         cwd=root, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "== speed_up" in out.stdout and "3.2" in out.stdout       # 80 / 25
    assert "10C" not in out.stdout and "4C / 100%" in out.stdout


def test_pool_csv_columns_by_name(spark, tmpdir_path):
    import gzip
    os.makedirs(f"{tmpdir_path}/p")
    with gzip.open(f"{tmpdir_path}/p/a.csv.gz", "wt") as fh:
        fh.write("label,id_sample,feature_1,note,feature_2\n1,77,0.5,x,2.5\n")
    r = files.load_pool(spark, f"{tmpdir_path}/p").first()
    assert (r.id_sample, r.label, r.feature_1, r.feature_2, r.note) == (77, 1, 0.5, 2.5, "x")
    assert files.load_pool(spark, f"{tmpdir_path}/p", n_features=1).columns == ["label", "id_sample", "feature_1", "note"]


def test_curve_round_trip(spark, tmpdir_path):
    rows = [("r1", "smart", 0, 5.0, 10, 0.5, 100), ("r1", "smart", 1, 6.0, 12, 0.75, 100)]
    for r in rows:
        files.append_results(spark.createDataFrame([r], files.CURVE_SCHEMA), f"{tmpdir_path}/curve")
    back = files.read_results(spark, f"{tmpdir_path}/curve", files.CURVE_SCHEMA)
    assert sorted(map(tuple, back.collect())) == rows
