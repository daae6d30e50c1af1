"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "labelpool") -> SparkSession:
    """Local session for tests and the bench; a cluster caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LABELPOOL_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_frame(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A DataFrame of a few driver-side result rows (learning-curve points,
    centres), sent as one Arrow table: a local relation, no Python worker."""
    import pyarrow as pa

    names = [f.name for f in schema.fields]
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    return spark.createDataFrame(table, schema)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where unset.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; we never
    invent a machine-local one there. In local mode (tests, bench) an unset
    folder is replaced by a fresh temporary directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a shared folder so "
            "round state survives executor loss")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="labelpool-ckpt-"))
    return sc.getCheckpointDir()
