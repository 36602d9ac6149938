"""Expressions over labels and short arrays (class probabilities, spacings, affines)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: largest accepted distance of a label from its nearest integer (closed bound).
LABEL_TOLERANCE = 1e-5


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def array_total(values: Column | str) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda acc, x: acc + x)


def entropy(probabilities: Column | str) -> Column:
    """Shannon entropy in nats; a zero probability contributes zero."""
    return F.aggregate(
        _col(probabilities),
        F.lit(0.0),
        lambda acc, p: acc - F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0)),
    )


def argmax_index(values: Column | str) -> Column:
    """Zero-based position of the maximum; the lowest position wins ties."""
    values = _col(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def normalized_label(value: Column | str, tolerance: float = LABEL_TOLERANCE) -> Column:
    """Nearest integer (half to even), or null when further away than the tolerance or not finite."""
    value = _col(value).cast("double")
    nearest = F.rint(value)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite & (F.abs(value - nearest) <= F.lit(tolerance)), nearest.cast("bigint"))


def within_tolerance(left: Column | str, right: Column | str, tolerance: float) -> Column:
    """Arrays of equal length whose elements differ by at most the tolerance."""
    left, right = _col(left), _col(right)
    close = F.forall(F.zip_with(left, right, lambda a, b: F.abs(a - b) <= F.lit(tolerance)), lambda ok: ok)
    return F.coalesce((F.size(left) == F.size(right)) & close, F.lit(False))


def max_abs_diff(left: Column | str, right: Column | str) -> Column:
    return F.array_max(F.zip_with(_col(left), _col(right), lambda a, b: F.abs(a - b)))


def probability_violation(probabilities: Column | str, classes: int, atol: float = 1e-5, rtol: float = 1e-5) -> Column:
    """Null for a valid probability vector, else the first rule that fails."""
    p = _col(probabilities)
    bad = F.exists(p, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    out = F.exists(p, lambda v: (v < 0) | (v > 1))
    return (
        F.when(p.isNull() | (F.size(p) != F.lit(classes)), F.lit("shape"))
        .when(bad, F.lit("not_finite"))
        .when(out, F.lit("outside_unit_interval"))
        .when(F.abs(array_total(p) - 1.0) > F.lit(atol + rtol), F.lit("sum_not_one"))
    )
