"""Column expressions shared by the operators; all of them stay inside the JVM."""
from driftgauge.functions.arrays import (
    argmax_index,
    entropy,
    max_abs_diff,
    normalized_label,
    within_tolerance,
)
from driftgauge.functions.hashing import hash60, hash_uniform, row_digest, set_digest

__all__ = [
    "argmax_index",
    "entropy",
    "hash60",
    "hash_uniform",
    "max_abs_diff",
    "normalized_label",
    "row_digest",
    "set_digest",
    "within_tolerance",
]
