"""Scans and sinks: pools built from the given tables, CSV/Parquet files."""

from labelpool.sources.files import (
    append_results, feature_names, load_pool, read_headerless_csv, read_results,
    stage_headerless_csv, write_table,
)
from labelpool.sources.pools import event_pool, order_pool, run_table, vector_pool

__all__ = [
    "append_results", "event_pool", "feature_names", "load_pool", "order_pool",
    "read_headerless_csv", "read_results", "run_table", "stage_headerless_csv",
    "vector_pool", "write_table",
]
