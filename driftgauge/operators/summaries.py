"""Summaries over replicates and the result ledger."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.operators.contracts import violation
from driftgauge.operators.ranks import needs_blocks, quantiles


def replicate_summary(df: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample standard deviation and 2.5 / 50 / 97.5 percentiles."""
    group_cols = list(group_cols)
    probs = {"p2_5": 0.025, "p50": 0.5, "p97_5": 0.975}
    moments = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")]
    if needs_blocks(df, group_cols):
        return df.groupBy(*group_cols).agg(*moments).join(quantiles(df, group_cols, value, probs, blocks=True), group_cols)
    wanted = F.percentile(value, F.array(*[F.lit(p) for p in probs.values()])).alias("__q")
    found = df.groupBy(*group_cols).agg(*moments, wanted)
    return found.select(*group_cols, "n", "mean", "sd", *[F.col("__q")[i].alias(n) for i, n in enumerate(probs)])


def bias_vs_reference(summary: DataFrame, reference: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Bias of the mean and its Monte Carlo standard error; both inputs are replicate summaries."""
    r = reference.select(*key_cols, F.col("n").alias("n_ref"), F.col("mean").alias("mean_ref"), F.col("sd").alias("sd_ref"))
    joined = summary.join(r, list(key_cols))
    spread = F.col("sd") * F.col("sd") / F.col("n") + F.col("sd_ref") * F.col("sd_ref") / F.col("n_ref")
    return joined.select(
        *key_cols, "n", "n_ref", "mean", "mean_ref", (F.col("mean") - F.col("mean_ref")).alias("bias"), F.sqrt(spread).alias("mcse")
    )


def decision_rates(df: DataFrame, group_cols: Sequence[str], low: str, high: str, reference: Column) -> DataFrame:
    """Share of intervals below zero, above zero, covering the reference and covering zero, with binomial errors and mean width."""
    flags = {
        "below_zero": F.col(high) < 0,
        "above_zero": F.col(low) > 0,
        "covers_reference": reference.between(F.col(low), F.col(high)),
        "covers_zero": F.lit(0.0).between(F.col(low), F.col(high)),
    }
    aggregates = [F.count(F.lit(1)).alias("n"), F.avg(F.col(high) - F.col(low)).alias("mean_width")]
    aggregates += [F.avg(c.cast("double")).alias(n) for n, c in flags.items()]
    out = df.groupBy(*group_cols).agg(*aggregates)
    return out.withColumns({f"{n}_se": F.sqrt(F.col(n) * (1 - F.col(n)) / F.col("n")) for n in flags})


def ledger_lookup(ledger: DataFrame, keys: DataFrame, key_col: str = "result_id") -> DataFrame:
    """Ledger rows for the required keys only."""
    return keys.select(key_col).join(ledger, key_col)


def ledger_violations(ledger: DataFrame, keys: DataFrame, key_col: str = "result_id") -> DataFrame:
    """Required keys without a row, and rows without a display text or a finite value."""
    missing = keys.select(key_col).join(ledger, key_col, "left_anti").select(*violation("missing", F.col(key_col), F.lit("no row")))
    value = F.col("full_precision")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    empty = F.col("display").isNull() | (F.col("display") == "")
    problem = F.when(bad, F.lit("value")).when(empty, F.lit("display"))
    present = ledger.join(keys.select(key_col), key_col, "left_semi").select(*violation("content", F.col(key_col), problem)).where("detail is not null")
    return missing.unionByName(present)


def interval_display(low: Column, high: Column) -> Column:
    return F.concat(low, F.lit(" to "), high)


def integer_total(df: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    """Sum of counts; any negative or fractional part makes the total null and is counted."""
    bad = F.count_if(F.col(value).isNull() | (F.col(value) < 0) | (F.col(value) != F.floor(value)))
    return df.groupBy(*group_cols).agg(F.when(bad == 0, F.sum(value).cast("bigint")).alias("total"), bad.alias("n_bad"))


def endpoint_table(ledger: DataFrame, quantities: Sequence[str], value: str = "display") -> DataFrame:
    """One row per endpoint and dataset with a column per quantity."""
    return ledger.groupBy("endpoint", "dataset").pivot("quantity", list(quantities)).agg(F.first(value))
