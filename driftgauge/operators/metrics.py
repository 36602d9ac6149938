"""Regression and rank metrics, cross-fitted medians and skill."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftgauge.operators.ranks import BLOCK, needs_blocks, range_blocks, with_average_rank
from driftgauge.operators.replicate_blocks import replicate_rank_correlations
from driftgauge.operators.resample import bootstrap, percentile_interval, place_units
from driftgauge.session import cut_lineage


def regression_metrics(df: DataFrame, group_cols: Sequence[str], target: str, prediction: str) -> DataFrame:
    residual = F.col(prediction) - F.col(target)
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(residual)).alias("mae"),
        F.sqrt(F.avg(residual * residual)).alias("rmse"),
    )


def _corr_struct(df: DataFrame, group_cols: Sequence[str], target: str, prediction: str, x: str, y: str, weight: Column) -> DataFrame:
    """Weighted correlation of two centred columns, with a reason when it is undefined.

    The built-in ``corr`` has no weights, hence the explicit weighted sums.
    """
    sums = df.groupBy(*group_cols).agg(
        F.sum(weight).cast("bigint").alias("n"),
        F.min(target).alias("t0"), F.max(target).alias("t1"),
        F.min(prediction).alias("p0"), F.max(prediction).alias("p1"),
        F.sum(weight * F.col(x)).alias("sx"), F.sum(weight * F.col(y)).alias("sy"),
        F.sum(weight * F.col(x) * F.col(y)).alias("sxy"),
        F.sum(weight * F.col(x) * F.col(x)).alias("sxx"), F.sum(weight * F.col(y) * F.col(y)).alias("syy"),
    )
    n = F.col("n")
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / n
    reason = (
        F.when(F.col("t0") == F.col("t1"), F.lit("constant_target"))
        .when(F.col("p0") == F.col("p1"), F.lit("constant_prediction"))
        .when(cxx * cyy <= 0, F.lit("zero_variance_after_transformation"))
    )
    return sums.select(
        *group_cols,
        "n",
        F.when(reason.isNull(), F.try_divide(cxy, F.sqrt(cxx * cyy))).alias("value"),
        reason.isNull().alias("defined"),
        reason.alias("reason"),
    )


def pearson(df: DataFrame, group_cols: Sequence[str], target: str, prediction: str) -> DataFrame:
    """Pearson correlation as ``value, defined, reason``."""
    reason = (
        F.when(F.col("t0") == F.col("t1"), F.lit("constant_target"))
        .when(F.col("p0") == F.col("p1"), F.lit("constant_prediction"))
        .when(F.col("value").isNull() | F.isnan("value"), F.lit("zero_variance_after_transformation"))
    )
    return (
        df.groupBy(*group_cols)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(target).alias("t0"), F.max(target).alias("t1"),
            F.min(prediction).alias("p0"), F.max(prediction).alias("p1"),
            F.try_divide(F.covar_pop(prediction, target), F.stddev_pop(prediction) * F.stddev_pop(target)).alias("value"),
        )
        .select(*group_cols, "n", F.when(reason.isNull(), F.col("value")).alias("value"), reason.isNull().alias("defined"), reason.alias("reason"))
    )


def spearman(
    df: DataFrame, group_cols: Sequence[str], target: str, prediction: str, weight_col: str | None = None, *, blocks: bool | None = None
) -> DataFrame:
    """Spearman correlation with average-tie ranks; weights count copies. Same undefined reasons as Pearson."""
    group_cols = list(group_cols)
    if blocks is None:
        blocks = needs_blocks(df, group_cols)
    ranked = with_average_rank(df, group_cols, target, "__rt", weight_col, blocks=blocks)
    ranked = with_average_rank(ranked, group_cols, prediction, "__rp", weight_col, blocks=blocks)
    weight = F.col(weight_col) if weight_col else F.lit(1)
    # Ranks are centred by the total weight before squaring, which keeps the sums well scaled.
    middle = (F.sum(weight).over(W.partitionBy(*group_cols)) + 1) / 2.0 if not blocks else None
    if middle is not None:
        ranked = ranked.withColumn("__m", middle)
    else:
        totals = df.groupBy(*group_cols).agg(((F.sum(weight) + 1) / 2.0).alias("__m"))
        ranked = ranked.join(totals, group_cols)
    ranked = ranked.withColumns({"__rt": F.col("__rt") - F.col("__m"), "__rp": F.col("__rp") - F.col("__m")})
    return _corr_struct(ranked, group_cols, target, prediction, "__rp", "__rt", weight)


def undefined_violations(correlations: DataFrame, key: Column) -> DataFrame:
    """The strict policy: an undefined correlation is a violation."""
    return correlations.where(~F.col("defined")).select(
        F.lit("correlation").alias("check"), key.cast("string").alias("key"), F.col("reason").alias("detail")
    )


def competence(
    units: DataFrame, group_cols: Sequence[str], id_col: str, target: str, prediction: str, *, resamples: int, seed: int
) -> DataFrame:
    """Spearman estimate, percentile interval over the unit bootstrap, and a verdict.

    ``RESOLVED`` only when the whole interval is above zero. ``n_undefined`` counts
    replicates without a defined correlation; a clean result has zero.
    """
    group_cols = list(group_cols)
    blocks = needs_blocks(units, group_cols)
    slim = units.select(*group_cols, id_col, target, prediction)
    if blocks:
        copies = cut_lineage(bootstrap(slim, group_cols, id_col, resamples=resamples, seed=seed, include_original=True, blocks=True))
        table = spearman(copies, [*group_cols, "replicate"], target, prediction, "multiplicity", blocks=True)
    else:
        placed = place_units(slim, group_cols, id_col, seed, blocks=False)
        table = replicate_rank_correlations(placed, group_cols, id_col, target, prediction, resamples=resamples, seed=seed)
    # a few numbers for each replicate, read three times
    table = cut_lineage(table)
    point = table.where("replicate = 0").select(*group_cols, "n", F.col("value").alias("rho"))
    drawn = table.where("replicate > 0")
    interval = percentile_interval(drawn, group_cols, "value")
    undefined = drawn.groupBy(*group_cols).agg(F.count_if(~F.col("defined")).alias("n_undefined"))
    return (
        point.join(interval, group_cols).join(undefined, group_cols)
        .withColumn("verdict", F.when((F.col("ci_low") > 0) & (F.col("n_undefined") == 0), F.lit("RESOLVED")).otherwise(F.lit("UNRESOLVED")))
    )


def absolute_errors(df: DataFrame, target: str, predictions: Sequence[str]) -> DataFrame:
    """One ``<prediction>_abs_error`` column per prediction."""
    return df.withColumns({f"{p}_abs_error": F.abs(F.col(p) - F.col(target)) for p in predictions})


def skill(model_mae: Column, comparator_mae: Column) -> Column:
    """``1 - MAE(model) / MAE(comparator)``; null when the comparator has no error to beat."""
    return F.when(comparator_mae > 0, 1.0 - F.try_divide(model_mae, comparator_mae))


def risk_coverage(df: DataFrame, group_cols: Sequence[str], risk: str, signal: str, id_col: str, *, blocks: bool | None = None) -> DataFrame:
    """Area under the risk-coverage curve, and its excess over the mean risk.

    Units enter by rising signal (ties by id); each place has the mean risk of the
    units up to it. In a large group the running sums restart in every range
    partition and the totals of the earlier partitions are added.
    """
    group_cols = list(group_cols)
    if blocks is None:
        blocks = needs_blocks(df, group_cols)
    if not blocks:
        running = F.avg(risk).over(W.partitionBy(*group_cols).orderBy(signal, id_col).rowsBetween(W.unboundedPreceding, 0))
        scored = df.withColumn("__run", running)
    else:
        pinned = range_blocks(df.select(*group_cols, signal, id_col, risk), [*group_cols, signal, id_col])
        totals = pinned.groupBy(*group_cols, BLOCK).agg(F.sum(risk).alias("s"), F.count(F.lit(1)).alias("c"))
        before = W.partitionBy(*group_cols).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
        offsets = totals.select(
            *group_cols, BLOCK,
            F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"),
        )
        inside = W.partitionBy(*group_cols, BLOCK).orderBy(signal, id_col).rowsBetween(W.unboundedPreceding, 0)
        scored = pinned.join(offsets, [*group_cols, BLOCK]).withColumn(
            "__run", (F.col("s0") + F.sum(risk).over(inside)) / (F.col("c0") + F.count(F.lit(1)).over(inside))
        )
    return scored.groupBy(*group_cols).agg(
        F.avg("__run").alias("aurc"), (F.avg("__run") - F.avg(risk)).alias("excess_aurc")
    )


def interval_score(df: DataFrame, group_cols: Sequence[str], target: str, lower: str, upper: str, alpha: float) -> DataFrame:
    """Mean interval score (width plus scaled miss distance), coverage and mean width."""
    y, lo, hi = F.col(target), F.col(lower), F.col(upper)
    miss = F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0))
    return df.groupBy(*group_cols).agg(
        F.avg((hi - lo) + F.lit(2.0 / alpha) * miss).alias("interval_score"),
        F.avg(y.between(lo, hi).cast("double")).alias("coverage"),
        F.avg(hi - lo).alias("mean_width"),
    )


def balanced_domain_mean(df: DataFrame, domain_col: str, group_col: str, value_col: str) -> DataFrame:
    """Domain mean in which every group counts equally."""
    return (
        df.groupBy(domain_col, group_col).agg(F.avg(value_col).alias("m"))
        .groupBy(domain_col).agg(F.count(F.lit(1)).alias("n_groups"), F.avg("m").alias("balanced_mean"))
    )
