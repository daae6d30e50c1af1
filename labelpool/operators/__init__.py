"""DataFrame → DataFrame operators of the active-learning workflow."""

from labelpool.operators.cutoff import dense_ids, exact_quantile, kth_smallest, select_smallest
from labelpool.operators.diversity import (
    cluster_candidates, diverse_batch, diversity_selection, nearest_to_centroid,
)
from labelpool.operators.labels import apply_labels
from labelpool.operators.metrics import accuracy, classification_metrics, confusion
from labelpool.operators.pool import (
    assemble_features, cast_pool, class_distribution, duplicate_ids, init_state, labeled_rows,
    standardize, state_counts, unlabeled_rows, vector_entries,
)
from labelpool.operators.runs import (
    learning_curve_pivot, mean_runs, ratio_to_reference, scale_up, size_up, speed_up,
)
from labelpool.operators.sampling import (
    assign_dense_ids, nested_subsets, random_batch, random_selection, stratified_sample,
    train_test_split,
)
from labelpool.operators.uncertainty import (
    get_uncertainty_candidates, score_pool, topk_uncertain, uncertainty_candidates,
    uncertainty_threshold,
)

__all__ = [
    "accuracy", "apply_labels", "assemble_features", "assign_dense_ids", "cast_pool",
    "class_distribution", "classification_metrics", "cluster_candidates", "confusion",
    "dense_ids", "diverse_batch", "diversity_selection", "duplicate_ids", "exact_quantile",
    "get_uncertainty_candidates", "init_state", "kth_smallest", "labeled_rows",
    "learning_curve_pivot", "mean_runs", "nearest_to_centroid", "nested_subsets",
    "random_batch", "random_selection", "ratio_to_reference", "scale_up",
    "score_pool", "select_smallest", "size_up", "speed_up", "standardize", "state_counts",
    "stratified_sample", "topk_uncertain", "train_test_split", "uncertainty_candidates",
    "uncertainty_threshold", "unlabeled_rows", "vector_entries",
]
