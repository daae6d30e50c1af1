"""Default parameters of the active-learning workflow.

Fixed values (must equal the published workflow for comparable results):
seed 42; train/test split 0.7 / 0.3; initial labelled fraction 0.05;
query batch fraction 0.01 of the training set; candidate factor alpha 10;
quantile relative error 0.001; dataset percentages 10, 20, 40, 80, 100;
bisecting k-means maxIter 20.
"""

RANDOM_SEED = 42
TRAIN_FRACTION = 0.7
INITIAL_LABELED_FRACTION = 0.05
QUERY_BATCH_FRACTION = 0.01
UNCERTAINTY_CANDIDATE_FACTOR = 10.0
UNCERTAINTY_QUANTILE_EPSILON = 0.001
DATA_PERCENTAGES = (10, 20, 40, 80, 100)
KMEANS_MAX_ITER = 20

# Our own scale guards (not from the published workflow).
# Largest number of rows (of ids and a few numbers) we broadcast for a checked-size join side.
BROADCAST_MAX_ROWS = 2_000_000
# Bytes of labelled rows in one partition of a fit's input.
FIT_PARTITION_BYTES = 4 * 1024 * 1024
# Buckets of a state table at most (Spark allows 100,000).
MAX_BUCKETS = 65_536
# Largest centre table (k x d doubles) we broadcast.
BROADCAST_MAX_BYTES = 256 * 1024 * 1024
# Rows and bytes of a cell that bisecting k-means splits to the end in one task.
CELL_TASK_ROWS = 262_144
CELL_TASK_BYTES = 64 * 1024 * 1024
# Largest table of cells with their centres that a common pass keeps as a local relation.
CELLS_LOCAL_BYTES = 1024 * 1024
# Reweighted least squares: passes of a fit, the step that ends it, largest entry of a step,
# and what is added to the Gram matrix' diagonal, times the number of rows.
IRLS_PASSES = 12
IRLS_TOLERANCE = 1e-10
IRLS_MAX_STEP = 8.0
IRLS_DAMPING = 1e-9
# Rows of the quantile's sample times the squared relative rank error: with 4, the error is four
# standard deviations at the median and more at other quantiles.
SKETCH_ROWS_FACTOR = 4.0
