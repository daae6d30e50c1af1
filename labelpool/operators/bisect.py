"""Bisecting k-means with exactly k cells at any size.

Level by level, all divisible cells are split in two by 2-means; on the last level the
largest cells are split first, so that k result. A cell's split depends on its own points
only: its start is its mean, moved by one standard deviation either way along its widest
dimension, and its passes end by its own centres.

* While a cell is too large for a task, the cells of a level are split in the same jobs. A
  pass joins each point with the plane between the two child centres of its cell and sums
  count and coordinates per cell and side; the sums are the new centres. Cells whose
  centres rest take no part in further passes. The centre table holds a row per cell. Up
  to ``CELLS_LOCAL_BYTES`` it is a local relation, so that a pass is one aggregate over the
  rows; a larger one stays in Spark, broadcast under a byte check and joined by cell beyond it.
* Once no cell is too large, each is split on in one grouped Arrow task, as many levels as
  can be needed, and every point gets its path of cells. Counting the cells of each level
  over all paths shows the level on which k is reached and how many cells are split there.

The rows of every level, the paths and large centre tables are checkpointed in the shared
folder. Points are summed in
the order of their ids within a task, so cells don't depend on the layout of the rows, but
for the order of floating-point sums in the first phase.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelpool.config import (
    BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, CELL_TASK_BYTES, CELL_TASK_ROWS, CELLS_LOCAL_BYTES, KMEANS_MAX_ITER,
)
from labelpool.operators.cutoff import select_smallest
from labelpool.session import ensure_checkpoint_dir


DEPTH_SLACK = 6   # levels that a task splits beyond those of a balanced tree


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _side(x: Column) -> Column:
    """True where a point is nearer to its cell's right child centre."""
    return _dot(x, F.col("normal")) > F.col("offset")


def _gap(a: str, b: str) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def _named(cell: Column, node: Column) -> Column:
    """A positive 63-bit id of a node in the tree below a cell; node 0 is the cell itself."""
    return F.when(node == 0, cell).otherwise(F.shiftrightunsigned(F.xxhash64(cell, node.cast("long")), 1))


def _plane(cells: DataFrame) -> DataFrame:
    """Add ``normal, offset``: the plane between the child centres."""
    return (cells.withColumn("normal", F.zip_with("right", "left", lambda r, l: r - l))
            .withColumn("offset", (_dot(F.col("right"), F.col("right")) - _dot(F.col("left"), F.col("left"))) / 2))


def _with_cells(rows: DataFrame, cells: DataFrame, n_cells: int, width: int, how: str = "inner") -> DataFrame:
    small = n_cells * width * 8 * 3 <= BROADCAST_MAX_BYTES
    return rows.join(F.broadcast(cells) if small else cells, "cell", how)


def _kept(cells: DataFrame, n_cells: int, width: int) -> DataFrame:
    """A table of at most ``n_cells`` cells, computed now: a local relation under a byte
    check, else checkpointed."""
    if n_cells * (4 * width + 4) * 8 <= CELLS_LOCAL_BYTES:
        return cells.sparkSession.createDataFrame(cells.toArrow(), cells.schema)
    return cells.checkpoint()


def _sums(width: int, *weights: tuple[str, Column | None]) -> list[Column]:
    """Per coordinate of ``x`` the sum (times a weight): plain numbers in the aggregate's buffer."""
    return [F.array(*(F.sum(F.col("x")[i] if w is None else F.when(w, F.col("x")[i])) for i in range(width))).alias(name)
            for name, w in weights]


def _divided(sums: str, n: str) -> Column:
    return F.transform(sums, lambda v: v / F.col(n))


def _stats(rows: DataFrame, n_cells: int, width: int) -> DataFrame:
    """(cell, n, mean, var): sample variances, from sums centred on the cell's first pass of means."""
    means = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *_sums(width, ("mean", None)))
    means = _kept(means.withColumn("mean", _divided("mean", "n")), n_cells, width)
    centred = _with_cells(rows, means, n_cells, width).withColumn("x", F.zip_with("x", "mean", lambda v, m: (v - m) * (v - m)))
    squares = centred.groupBy("cell").agg(*_sums(width, ("squares", None)))
    return means.join(squares, "cell").withColumn("var", F.transform("squares", lambda v: F.when(F.col("n") > 1, v / (F.col("n") - 1)).otherwise(0.0))).drop("squares")


def bisect_cells(points: DataFrame, k: int, id_col: str = "id_sample", features: str = "features",
                 max_iter: int = KMEANS_MAX_ITER, tol: float = 1e-2, task_rows: int = CELL_TASK_ROWS) -> DataFrame:
    """``(id, cell, features)``: the points in at most ``k`` cells.

    There are fewer cells than ``k`` only when there are fewer distinct points. A cell's
    passes end after ``max_iter`` or when the squared moves of its two centres are together
    at most ``tol`` of its largest variance. Cells of up to ``task_rows`` rows, and of
    ``CELL_TASK_BYTES``, are split to the end in one task.
    """
    ensure_checkpoint_dir(points.sparkSession)
    is_vector = points.schema[features].dataType.simpleString() == "vector"
    x = vector_to_array(F.col(features)) if is_vector else F.col(features).cast("array<double>")
    rows = points.select(F.col(id_col).alias("id"), F.lit(0).cast("bigint").alias("cell"), x.alias("x")).checkpoint()
    first = rows.first()
    width = len(first["x"]) if first else 0
    task_rows = max(2, min(task_rows, CELL_TASK_BYTES // (8 * max(width, 1))))
    stuck = rows.select("cell").limit(0)
    leaves = 1
    while first and leaves < k:
        sizes = rows.groupBy("cell").count()
        if sizes.join(stuck, "cell", "left_anti").agg(F.max("count")).first()[0] > task_rows:
            more, rows, stuck = _split_level(rows, stuck, leaves, k - leaves, width, max_iter, tol)
        else:
            more, rows = _split_in_tasks(rows, k, leaves, width, max_iter, tol)
        if more == 0:
            break
        leaves += more
    out = rows.select(F.col("id").alias(id_col), "cell", (array_to_vector("x") if is_vector else F.col("x")).alias(features))
    return out


def _split_level(rows: DataFrame, stuck: DataFrame, n_cells: int, missing: int, width: int, max_iter: int,
                 tol: float) -> tuple[int, DataFrame, DataFrame]:
    """Split every divisible one of the ``n_cells`` cells, the largest ones if there are more
    than ``missing``, in common passes over all rows. Returns the number of new cells, the
    rows, and the cells that can't be split."""
    stats = _kept(_stats(rows, n_cells, width).withColumn("widest", F.array_max("var")).join(stuck, "cell", "left_anti"), n_cells, width)
    open_cells = stats.filter("widest > 0")
    closed = stats.filter("not widest > 0").select("cell")
    divisible = open_cells.count()
    n_split = min(divisible, missing)
    if n_split == 0:
        return 0, rows, stuck
    if n_split < divisible:
        open_cells = select_smallest(open_cells, -F.col("n"), F.col("cell"), n_split)
    # the start: one standard deviation along the first widest dimension
    shift = F.transform("var", lambda v, i: F.when(i == F.array_position("var", F.col("widest")) - 1, F.sqrt(v)).otherwise(0.0))
    cells = _kept(_plane(open_cells.select(
        "cell", "widest", F.zip_with("mean", shift, lambda m, s: m - s).alias("left"),
        F.zip_with("mean", shift, lambda m, s: m + s).alias("right"), F.lit(float("inf")).alias("moved"))), n_split, width)
    for _ in range(max_iter):
        moving = cells.filter(F.col("moved") > tol)
        if moving.isEmpty():
            break
        right = F.col("is_right")
        sides = _with_cells(rows, moving.select("cell", "normal", "offset"), n_split, width).withColumn("is_right", _side(F.col("x")))
        sums = sides.groupBy("cell").agg(F.count_if(~right).alias("n_l"), F.count_if(right).alias("n_r"), *_sums(width, ("l", ~right), ("r", right)))
        new = moving.select("cell", "widest", "left", "right").join(sums, "cell")
        for side, total, n in (("left", "l", "n_l"), ("right", "r", "n_r")):   # a side without points stays
            new = new.withColumn(total, F.when(F.col(n) > 0, _divided(total, n)).otherwise(F.col(side)))
        new = new.withColumn("moved", (_gap("l", "left") + _gap("r", "right")) / F.col("widest"))
        new = _plane(new.select("cell", "widest", F.col("l").alias("left"), F.col("r").alias("right"), "moved"))
        cells = _kept(cells.filter(~(F.col("moved") > tol)).unionByName(new), n_split, width)
    split = _with_cells(rows, cells.select("cell", "normal", "offset"), n_split, width, "left")
    split = split.withColumn("node", F.when(F.col("normal").isNull(), 0).when(_side(F.col("x")), 2).otherwise(1)).select("id", "cell", "x", "node")
    # equal but for rounding: all points of a cell on one side, which then keeps its id
    both = _kept(split.filter("node > 0").groupBy("cell").agg((F.lit(1) + (F.min("node") < F.max("node")).cast("int")).alias("sides")), n_split, width)
    one_sided = both.filter("sides = 1").select("cell")
    n_new = both.filter("sides = 2").count()
    keep = one_sided.withColumn("keep", F.lit(True))
    small = n_split <= BROADCAST_MAX_ROWS
    rows = split.join(F.broadcast(keep) if small else keep, "cell", "left").select(
        "id", _named(F.col("cell"), F.when(F.col("keep"), 0).otherwise(F.col("node"))).alias("cell"), "x").checkpoint()
    return n_new, rows, _kept(stuck.union(closed).union(one_sided), n_cells, width)


def _split_in_tasks(rows: DataFrame, k: int, leaves: int, width: int, max_iter: int, tol: float) -> tuple[int, DataFrame]:
    """Split every cell on within one task, up to the level where ``k`` cells are reached."""
    depth = (-(-k // leaves) - 1).bit_length() + DEPTH_SLACK

    def paths(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        x = np.asarray(table["x"].combine_chunks().flatten()).reshape(-1, width)
        nodes, lengths = split_tree(x, depth, max_iter, tol)
        path = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(nodes, pa.int32()))
        return pa.Table.from_arrays([table["id"], table["cell"], table["x"].cast(pa.list_(pa.float64())), path], names=["id", "cell", "x", "path"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.groupBy("cell").applyInArrow(paths, f"id {kind}, cell bigint, x array<double>, path array<int>").checkpoint()
    steps = found.select("cell", F.size("path").alias("steps"), F.posexplode("path").alias("level", "node"))
    nodes = steps.groupBy("cell", "level", "node").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("steps") > F.col("level") + 1).alias("splits")).checkpoint()
    split_at = {r["level"]: r["splits"] for r in nodes.groupBy("level").agg(F.count_if("splits").alias("splits")).collect()}   # a row a level
    new, level = 0, 0
    while split_at.get(level, 0) and leaves + new + split_at[level] < k:
        new += split_at[level]
        level += 1
    node = F.element_at("path", F.least(F.size("path"), F.lit(level + 1)))
    n_split = min(split_at.get(level, 0), k - leaves - new)
    if n_split:
        largest = nodes.filter((F.col("level") == level) & F.col("splits")).withColumn("at", _named(F.col("cell"), F.col("node"))).select("at", "n")
        if n_split < split_at[level]:
            largest = select_smallest(largest, -F.col("n"), F.col("at"), n_split)
        chosen = largest.select("at", F.lit(True).alias("chosen"))
        found = found.withColumn("at", _named(F.col("cell"), node)).join(F.broadcast(chosen) if n_split <= BROADCAST_MAX_ROWS else chosen, "at", "left")
        node = F.when(F.col("chosen"), F.element_at("path", level + 2)).otherwise(node)
    return new + n_split, found.select("id", _named(F.col("cell"), node).alias("cell"), "x").checkpoint()


def split_tree(x: np.ndarray, depth: int, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """The tree of cells of the rows of ``x`` down to ``depth`` levels, all cells of a level
    at once: every row's nodes from the root 0 on, one after the other, and their number."""
    n = len(x)
    cell = np.zeros(n, np.int64)          # the node that a row is in
    steps = [cell]
    last = np.ones(n, np.int64)
    open_rows = np.arange(n)              # rows of cells that may be split
    n_nodes = 1
    for _ in range(depth):
        order = open_rows[np.argsort(cell[open_rows], kind="stable")]
        if not len(order):
            break
        begin = np.flatnonzero(np.diff(cell[order], prepend=-1))
        right, splits = _bisect(x[order], begin, max_iter, tol)
        sizes = np.diff(begin, append=len(order))
        number = np.cumsum(splits) - 1
        child = n_nodes + 2 * np.repeat(number, sizes) + right
        moves = np.repeat(splits, sizes)
        cell = cell.copy()
        cell[order[moves]] = child[moves]
        last[order[moves]] += 1
        steps.append(cell)
        open_rows = np.sort(order[moves])
        n_nodes += 2 * int(splits.sum())
    grid = np.stack(steps, axis=1)
    return grid[np.arange(grid.shape[1]) < last[:, None]], last


def _bisect(x: np.ndarray, begin: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """2-means in each of the cells that begin at ``begin``: each row's side, and which cells
    have points on both sides."""
    sizes = np.diff(begin, append=len(x))
    cell = np.repeat(np.arange(len(begin)), sizes)
    mean = np.add.reduceat(x, begin, axis=0) / sizes[:, None]
    var = np.add.reduceat((x - mean[cell]) ** 2, begin, axis=0) / np.maximum(sizes - 1, 1)[:, None]
    widest = var.max(axis=1, initial=0.0)
    shift = np.zeros_like(mean)
    if x.shape[1]:
        wide = var.argmax(axis=1)
        shift[np.arange(len(begin)), wide] = np.sqrt(var[np.arange(len(begin)), wide])
    centre = np.stack([mean - shift, mean + shift])
    active = widest > 0
    divisible = active.copy()
    for _ in range(max_iter):
        rows = np.flatnonzero(active[cell])
        if not len(rows):
            break
        of = cell[rows]
        right = _nearer_right(x[rows], centre, of)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        which = of[starts]
        new = centre[:, which].copy()
        for side, mine in enumerate((~right, right)):
            count = np.add.reduceat(mine.astype(np.int64), starts)
            total = np.add.reduceat(np.where(mine[:, None], x[rows], 0.0), starts, axis=0)
            some = count > 0                          # a side without points stays
            new[side, some] = total[some] / count[some, None]
        moved = ((new - centre[:, which]) ** 2).sum(axis=(0, 2)) / widest[which]
        centre[:, which] = new
        active[which] = moved > tol
    right = _nearer_right(x, centre, cell)
    n_right = np.add.reduceat(right.astype(np.int64), begin)
    return right, divisible & (n_right > 0) & (n_right < sizes)


def _nearer_right(x: np.ndarray, centre: np.ndarray, cell: np.ndarray) -> np.ndarray:
    normal = centre[1] - centre[0]
    offset = ((centre[1] ** 2).sum(axis=1) - (centre[0] ** 2).sum(axis=1)) / 2
    return (x * normal[cell]).sum(axis=1) > offset[cell]


def cell_centers(cells: DataFrame, features: str = "features") -> DataFrame:
    """``(cluster_id, center)``: the mean of each cell's points."""
    x = vector_to_array(F.col(features)) if dict(cells.dtypes)[features] == "vector" else F.col(features)
    first = cells.select(F.size(x)).first()
    rows = cells.select(F.col("cell").alias("cluster_id"), x.alias("x"))
    sums = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *_sums(first[0] if first else 0, ("center", None)))
    return sums.select("cluster_id", _divided("center", "n").alias("center"))
