"""Split-conformal calibration from absolute residuals."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.operators.contracts import violation
from driftgauge.operators.ranks import needs_blocks, order_statistics, quantiles

# Miscoverage levels.
ALPHA = 0.10
ALPHA_LEVELS = (0.20, 0.10, 0.05)


def finite_sample_rank(n: Column, alpha: float) -> Column:
    """One-based rank ``ceil((n + 1) * (1 - alpha))`` in double arithmetic."""
    return F.ceil((n + 1) * F.lit(1.0 - float(alpha))).cast("bigint")


def absolute_residuals(df: DataFrame, target: str, prediction: str, name: str = "residual") -> DataFrame:
    return df.withColumn(name, F.abs(F.col(target) - F.col(prediction)))


def residual_thresholds(
    calibration: DataFrame, group_cols: Sequence[str], residual: str, alphas: Sequence[float] = ALPHA_LEVELS
) -> DataFrame:
    """``(group…, alpha, n, rank, threshold)``; a rank above n leaves the threshold null."""
    names = {f"t{i}": float(a) for i, a in enumerate(alphas)}
    found = order_statistics(
        calibration, group_cols, residual, {name: (lambda n, a=a: finite_sample_rank(n, a)) for name, a in names.items()}
    )
    entries = [
        F.struct(F.lit(a).alias("alpha"), F.col(f"{name}_rank").alias("rank"), F.col(name).alias("threshold")) for name, a in names.items()
    ]
    return found.select(*group_cols, "n", F.explode(F.array(*entries)).alias("e")).select(*group_cols, "e.alpha", "n", "e.rank", "e.threshold")


def threshold_violations(thresholds: DataFrame) -> DataFrame:
    """Levels that the calibration set is too small for."""
    return thresholds.where(F.col("threshold").isNull()).select(
        *violation("conformal_rank", F.col("alpha"), F.concat(F.lit("rank "), F.col("rank"), F.lit(" of "), F.col("n")))
    )


def intervals(df: DataFrame, point: str, threshold: Column, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Raw interval and the one whose ends are each clipped to the bounds, plus its width.

    An interval that lies outside the bounds collapses to the nearer bound.
    """
    clip = lambda c: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    raw = df.withColumns({"lower_raw": F.col(point) - threshold, "upper_raw": F.col(point) + threshold})
    return raw.withColumns({"lower": clip(F.col("lower_raw")), "upper": clip(F.col("upper_raw"))}).withColumn(
        "width", F.col("upper") - F.col("lower")
    )


def interval_hit(target: str, lower: str = "lower", upper: str = "upper") -> Column:
    """Inclusive membership."""
    return F.col(target).between(F.col(lower), F.col(upper))


def interval_metrics(df: DataFrame, group_cols: Sequence[str], hit: str, width: str, nominal: Column | float) -> DataFrame:
    """Coverage, its distance from nominal, mean and median width."""
    group_cols = list(group_cols)
    blocks = needs_blocks(df, group_cols)
    nominal = nominal if isinstance(nominal, Column) else F.lit(float(nominal))
    measures = [F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("double")).alias("coverage"), F.avg(width).alias("mean_width")]
    if blocks:
        medians = quantiles(df, group_cols, width, {"median_width": 0.5}, blocks=True)
        out = df.groupBy(*group_cols).agg(*measures).join(medians, group_cols)
    else:
        out = df.groupBy(*group_cols).agg(*measures, F.percentile(width, F.lit(0.5)).alias("median_width"))
    return out.withColumn("coverage_error", F.abs(F.col("coverage") - nominal))


def apply_levels(points: DataFrame, point: str, thresholds: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Intervals at every level: thresholds of one group (or of each group) applied to all points.

    The thresholds are one row per group and level; they are folded into one array
    per group, so points are joined once and expanded by level.
    """
    level = F.sort_array(F.collect_list(F.struct("alpha", "threshold")))
    if group_cols:
        folded = thresholds.groupBy(*group_cols).agg(level.alias("__levels"))
        joined = points.join(folded, list(group_cols))
    else:
        levels = [(r["alpha"], r["threshold"]) for r in thresholds.select("alpha", "threshold").orderBy("alpha").collect()]
        literal = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(t).cast("double").alias("threshold")) for a, t in levels])
        joined = points.withColumn("__levels", literal)
    expanded = joined.withColumn("__l", F.explode("__levels")).select(
        *points.columns, F.col("__l.alpha").alias("alpha"), F.col("__l.threshold").alias("threshold")
    )
    return intervals(expanded, point, F.col("threshold"))


def unconditional_intervals(calibration: DataFrame, group_cols: Sequence[str], target: str, alphas: Sequence[float] = ALPHA_LEVELS) -> DataFrame:
    """Interval that ignores the prediction: target quantiles alpha/2 and 1 - alpha/2, raw and clipped."""
    probs: dict[str, float] = {}
    for i, a in enumerate(alphas):
        probs[f"l{i}"], probs[f"u{i}"] = a / 2.0, 1.0 - a / 2.0
    found = quantiles(calibration, group_cols, target, probs)
    entries = [
        F.struct(F.lit(float(a)).alias("alpha"), F.col(f"l{i}").alias("lower_raw"), F.col(f"u{i}").alias("upper_raw"))
        for i, a in enumerate(alphas)
    ]
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    return found.select(*group_cols, F.explode(F.array(*entries)).alias("e")).select(*group_cols, "e.*").withColumns(
        {"lower": clip("lower_raw"), "upper": clip("upper_raw")}
    )
