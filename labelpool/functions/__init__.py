"""Column expressions (JVM-side, codegen-friendly) shared by the operators."""

from labelpool.functions.hashing import hash_below, seeded_hash, HASH_SPACE
from labelpool.functions.scoring import binary_uncertainty, squared_distance, logistic

__all__ = [
    "HASH_SPACE",
    "binary_uncertainty",
    "hash_below",
    "logistic",
    "seeded_hash",
    "squared_distance",
]
