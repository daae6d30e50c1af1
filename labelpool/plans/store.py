"""Round state as two bucketed tables in the shared checkpoint folder.

* ``pool``   — ``id, label, features``: written once, bucketed by id.
* ``labels`` — ``id, round``: the labelled ids, appended B rows per round,
  bucketed by id with the same bucket count.

The current state is ``pool ⟕ labels``. Both sides carry the same hash
partitioning from their bucket specs, so the join (and the ``groupBy`` that
guards against an id appended twice) plans with no exchange at all: a round
moves no pool rows through a shuffle, writes only its B new ids, and the
lineage of the state is two file scans, whatever the round. A lost executor
re-reads files; nothing is replayed.

* ``rounds`` — one committed record a round (number, budget, counts, metric, the
  labels' folder). ``PoolState.open(spark, tag)`` takes the state up after a lost
  driver, as of the last committed round.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelpool.config import MAX_BUCKETS
from labelpool.operators.pool import LABELED, UNLABELED, duplicate_ids
from labelpool.session import ensure_checkpoint_dir, small_frame


def state_buckets(pool: DataFrame, rows_per_bucket: int = 1_000_000) -> int:
    """Buckets by the pool's row count, at least one per 10,000 rows while the
    cluster has free cores, and never more than MAX_BUCKETS."""
    n = pool.count()
    few = min(pool.sparkSession.sparkContext.defaultParallelism, -(-n // 10_000))
    return max(1, min(MAX_BUCKETS, max(few, -(-n // rows_per_bucket))))


# one row a committed round; a loop that stopped goes on from the last one
RECORD_SCHEMA = T.StructType([
    T.StructField("round", T.IntegerType()), T.StructField("run_id", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("budget", T.LongType()), T.StructField("labeled", T.LongType()), T.StructField("unlabeled", T.LongType()),
    T.StructField("nominal", T.DoubleType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("dataset_percentage", T.IntegerType()), T.StructField("labels_path", T.StringType())])
STATE_SCHEMA = T.StructType([
    T.StructField("n_buckets", T.IntegerType()), T.StructField("id_col", T.StringType()), T.StructField("label_col", T.StringType()),
    T.StructField("state_col", T.StringType()), T.StructField("pool_ddl", T.StringType()), T.StructField("vectors", T.StringType())])


class PoolState:
    def __init__(self, spark: SparkSession, pool: DataFrame, n_buckets: int | None = None,
                 root: str | None = None, id_col: str = "id_sample", state_col: str = "state",
                 cache: bool = True, check_unique: bool = True, label_col: str = "label", tag: str | None = None):
        self.spark = spark
        self.id_col = id_col
        self.label_col = label_col
        self.state_col = state_col
        self._named(tag or uuid.uuid4().hex[:12], root)
        if self._exists(""):
            raise ValueError(f"there is a state {self.tag!r} already; PoolState.open goes on with it")
        self.labels_table, self.labels_path = f"labelpool_{self.tag}_labels", "labels"
        self.n_buckets = n_buckets or state_buckets(pool)
        body = pool.drop(state_col)
        # vectors are stored as arrays, so that plain DDL can name the table's columns again
        self.vectors = [f.name for f in body.schema.fields if f.dataType.simpleString() == "vector"]
        body = body.select(*(vector_to_array(c).alias(c) if c in self.vectors else F.col(c) for c in body.columns))
        self._write(body, self.pool_table, "pool", "overwrite", sort=True)
        first = pool.filter(F.col(state_col) == F.lit(LABELED)).select(
            F.col(id_col), F.lit(0).alias("round"), F.lit(None).cast("int").alias("answer"))
        self._write(first, self.labels_table, self.labels_path, "overwrite")
        if check_unique:
            dup = duplicate_ids(spark.table(self.pool_table), id_col)
            if dup:
                self.close()
                raise ValueError(f"{dup} ids occur more than once; the flip needs unique ids")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema.fields)
        self._record("state", (self.n_buckets, id_col, label_col, state_col, ddl, ",".join(self.vectors)), STATE_SCHEMA)
        self._load(cache)

    def _named(self, tag: str, root: str | None) -> None:
        self.tag = tag
        self.root = (root or ensure_checkpoint_dir(self.spark)).rstrip("/") + f"/labelpool-state-{tag}"
        self.pool_table = f"labelpool_{tag}_pool"
        self._superseded: list[str] = []

    def _load(self, cache: bool) -> None:
        pool = self.spark.table(self.pool_table)
        for c in self.vectors:
            pool = pool.withColumn(c, array_to_vector(F.col(c)))
        self._pool = pool
        if cache:
            # a cached bucketed scan keeps its hash partitioning
            self._pool = pool.persist(StorageLevel.MEMORY_AND_DISK)
            self._pool.count()

    @classmethod
    def open(cls, spark: SparkSession, tag: str, root: str | None = None, cache: bool = True) -> PoolState:
        """The state ``tag`` as of its last committed round, after its driver was lost.

        The tables are found again by their folders; labels of a round that wasn't
        committed are left behind, since the labels are written anew up to that round."""
        self = cls.__new__(cls)
        self.spark = spark
        self._named(tag, root)
        if not self._exists("state/_SUCCESS"):
            raise ValueError(f"no state {tag!r} in {self.root}")
        row = spark.read.schema(STATE_SCHEMA).json(f"{self.root}/state").first()
        self.n_buckets, self.id_col, self.label_col, self.state_col = row["n_buckets"], row["id_col"], row["label_col"], row["state_col"]
        self.vectors = [v for v in (row["vectors"] or "").split(",") if v]
        done = self.records()
        last = done[-1] if done else None
        path = last["labels_path"] if last else "labels"
        self.labels_table, self.labels_path = f"labelpool_{tag}_found", path
        self._register(self.pool_table, row["pool_ddl"], "pool", sort=True)
        kind = spark.table(self.pool_table).schema[self.id_col].dataType.simpleString()
        self._register(self.labels_table, f"`{self.id_col}` {kind}, round int, answer int", path)
        self._load(cache)
        self.compact(last["round"] if last else 0)
        return self

    def _register(self, table: str, ddl: str, sub: str, sort: bool = False) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")   # the name only: the files are outside the warehouse
        order = f"SORTED BY (`{self.id_col}`) " if sort else ""
        self.spark.sql(f"CREATE TABLE {table} ({ddl}) USING parquet CLUSTERED BY (`{self.id_col}`) {order}"
                       f"INTO {self.n_buckets} BUCKETS LOCATION '{self.root}/{sub}'")

    # ------------------------------------------------------------ committed rounds
    def _fs(self, sub: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{sub}" if sub else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, sub: str) -> bool:
        path, fs = self._fs(sub)
        return fs.exists(path)

    def _record(self, sub: str, row: tuple, schema: T.StructType) -> None:
        """A written row counts once its folder holds the mark of a finished job."""
        small_frame(self.spark, [row], schema).coalesce(1).write.mode("overwrite").json(f"{self.root}/{sub}")

    def commit(self, **record) -> None:
        """Record a finished round: its number, counts, metric, and the labels' folder."""
        record["labels_path"] = self.labels_path
        self._record(f"rounds/{record['round']:06d}", tuple(record.get(f.name) for f in RECORD_SCHEMA.fields), RECORD_SCHEMA)
        self._clear_superseded()

    def records(self) -> list[dict]:
        """The committed rounds, in order: one small row each."""
        path, fs = self._fs("rounds")
        if not fs.exists(path):
            return []
        names = sorted(str(f.getPath().getName()) for f in fs.listStatus(path))
        done = [f"{self.root}/rounds/{n}" for n in names if self._exists(f"rounds/{n}/_SUCCESS")]
        if not done:
            return []
        return sorted((r.asDict() for r in self.spark.read.schema(RECORD_SCHEMA).json(done).collect()), key=lambda r: r["round"])

    def _write(self, df: DataFrame, table: str, sub: str, mode: str, sort: bool = False) -> None:
        # one task a bucket, so a write makes at most one file a bucket, or several of a bounded size
        w = df.repartition(self.n_buckets, self.id_col).write.mode(mode).bucketBy(self.n_buckets, self.id_col) \
            .option("maxRecordsPerFile", 5_000_000)
        if sort:
            w = w.sortBy(self.id_col)
        w.option("path", f"{self.root}/{sub}").saveAsTable(table)

    def labels(self) -> DataFrame:
        """``id, labeled_round, answer``: one row per labelled id (first
        round wins; the answer is the latest non-null one). Grouping makes a
        repeated append harmless, so appends may be retried."""
        t = self.spark.table(self.labels_table)
        answered = F.when(F.col("answer").isNotNull(), F.struct(F.col("round"), F.col("answer")))
        return t.groupBy(self.id_col).agg(F.min("round").alias("labeled_round"),
                                          F.max(answered).alias("_lp_last"))

    def frame(self) -> DataFrame:
        """The pool with its current ``state`` column (and answered labels)."""
        # bucket by bucket also while the labels are few: broadcast, they went through the driver at every read
        joined = self._pool.join(self.labels().hint("shuffle_hash"), self.id_col, "left")
        state = F.when(F.col("labeled_round").isNotNull(), F.lit(LABELED)).otherwise(F.lit(UNLABELED))
        cols = [F.coalesce(F.col("_lp_last.answer"), F.col(c)).alias(c) if c == self.label_col
                else F.col(c) for c in self._pool.columns]
        return joined.select(*cols, state.alias(self.state_col))

    def add(self, ids: DataFrame, round_no: int, id_col: str | None = None,
            answer_col: str | None = None) -> None:
        """Append a round's labelled ids (and, for a real annotator, their
        answers, which then replace the pool's label) to the labels table."""
        src = id_col or self.id_col
        answer = F.col(answer_col).cast("int") if answer_col else F.lit(None).cast("int")
        batch = ids.select(F.col(src).cast("bigint").alias(self.id_col),
                           F.lit(int(round_no)).alias("round"), answer.alias("answer"))
        self._write(batch, self.labels_table, self.labels_path, "append")
        self.spark.catalog.refreshTable(self.labels_table)

    def compact(self, last_round: int | None = None) -> None:
        """Rewrite the labels table as one row per id into a new version, up to ``last_round``.

        Every append adds up to one small file per bucket; compacting every
        few rounds keeps the file count bounded. The rewrite is O(|L|), a
        small share of the pool, and goes to a fresh folder (a table cannot
        be overwritten while it is read). Where rounds are committed, the old
        folder stays until the next one is, as the last record names it."""
        t = self.spark.table(self.labels_table)
        if last_round is not None:
            t = t.filter(F.col("round") <= last_round)
        answered = F.when(F.col("answer").isNotNull(), F.struct(F.col("round"), F.col("answer")))
        one = (t.groupBy(self.id_col)
               .agg(F.min("round").alias("round"), F.max(answered).alias("_lp_last"))
               .select(self.id_col, "round", F.col("_lp_last.answer").alias("answer")))
        version = uuid.uuid4().hex[:8]
        old, old_path = self.labels_table, self.labels_path
        self.labels_table = f"labelpool_{self.tag}_labels_{version}"
        self.labels_path = f"labels_{version}"
        self._write(one, self.labels_table, self.labels_path, "overwrite")
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        self._superseded.append(old_path)
        if not self._exists("rounds"):
            self._clear_superseded()   # no record names it

    def _clear_superseded(self) -> None:
        for sub in self._superseded:
            self._delete(sub)
        self._superseded = []

    def _delete(self, sub: str) -> None:
        """Delete a superseded part of this state's own folder, or all of it."""
        path, fs = self._fs(sub)
        fs.delete(path, True)

    def close(self) -> None:
        """Release the cache, the catalog names and this state's own folder.
        Frames of the state can't be read any more."""
        if hasattr(self, "_pool"):
            self._pool.unpersist()
        for t in (self.pool_table, self.labels_table):
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._delete("")
