"""Shift endpoints: skill per repeat, its difference between domains, and bootstrap verdicts."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.operators.contracts import ContractError, not_finite
from driftgauge.operators.metrics import skill
from driftgauge.operators.ranks import largest_group, with_order_block
from driftgauge.operators.recalibrate import affine_coefficients, crossfit_predictions, isotonic_predictions, leave_fold_out_medians, sample_center
from driftgauge.operators.replicate_blocks import replicate_skills
from driftgauge.operators.resample import (
    BOOTSTRAP_RESAMPLES,
    BOOTSTRAP_SEED,
    CROSSFIT_FOLDS,
    CROSSFIT_SEEDS,
    PLACE_COLUMNS,
    draw,
    place_units,
    repeated_folds,
)
from driftgauge.session import bounded_broadcast, compute_tasks, cut_lineage, pinned_if_small, task_rows


class Samples:
    """Units prepared for cross-fitting: folds, order blocks, and the replicates drawn from them.

    While a sample fits a task, skills are found by blocks of replicates and no copies are made. ``copies`` are built when asked for, or for
    larger samples; they have replicate 0 (the sample itself) and 1..B.
    """

    def __init__(
        self, units: DataFrame, domain: str, id_col: str, target: str, prediction: str, *,
        seeds: Sequence[int] = CROSSFIT_SEEDS, k: int = CROSSFIT_FOLDS, resamples: int = 0, bootstrap_seed: int = BOOTSTRAP_SEED,
        mode: str = "multinomial",
    ) -> None:
        self.domain, self.id_col, self.target, self.prediction = domain, id_col, target, prediction
        self.repeats, self.k, self.resamples, self.bootstrap_seed, self.mode = len(seeds), k, resamples, bootstrap_seed, mode
        # the source is read once: sizes, folds, blocks and places all start from what was read; hashing is spread over all cores
        slim = cut_lineage(units.select(domain, id_col, target, prediction).repartition(compute_tasks(units.sparkSession), id_col))
        self.largest = largest_group(slim, [domain])
        self.bounded = self.largest <= task_rows(units.sparkSession)
        folded = repeated_folds(slim, [domain], id_col, seeds, k, blocks=not self.bounded)
        # every later pass starts from the pinned table
        self.units = cut_lineage(self._with_blocks(folded) if resamples and not self.bounded else folded)
        self.keys = [domain, "replicate"]
        # Two domains are compared, so this is the number of samples.
        self.n_samples = 2 * (resamples + 1)

    def _with_blocks(self, table: DataFrame) -> DataFrame:
        # About sqrt(n) blocks: the counting pass and the inspected block are then of similar size.
        return with_order_block(table, [self.domain], self.target, max(16, math.isqrt(self.largest)), blocks=not self.bounded)

    @cached_property
    def placed(self) -> DataFrame:
        """Units with their places, from which replicates are drawn; without replicates only small samples need them."""
        return cut_lineage(place_units(self.units, [self.domain], self.id_col, self.bootstrap_seed, blocks=not self.bounded))

    @cached_property
    def copies(self) -> DataFrame:
        if not self.resamples:
            return self.units.withColumns({"replicate": F.lit(0), "multiplicity": F.lit(1).cast("bigint")})
        drawn = draw(self.placed, [self.domain], self.id_col, resamples=self.resamples, seed=self.bootstrap_seed, mode=self.mode, include_original=True)
        # Every endpoint reads the copies three to four times.
        return pinned_if_small(drawn, 2 * self.largest * (self.resamples + 1), 64 + 4 * self.repeats)

    @cached_property
    def _medians(self) -> DataFrame:
        copies = self.copies if "block" in self.copies.columns else self._with_blocks(self.copies)
        found = leave_fold_out_medians(copies, self.keys, self.target, repeats=self.repeats, k=self.k, n_samples=self.n_samples)
        # one row a fit; several endpoints of the same samples share them
        return cut_lineage(found)

    def medians(self) -> DataFrame:
        return self._medians

    def coefficients(self, recalibrator: str) -> DataFrame:
        # sums are taken around the mean of the units, which is one small aggregate and not one over all copies
        return affine_coefficients(
            self.copies, self.keys, self.prediction, self.target, recalibrator, repeats=self.repeats, k=self.k, bounded=self.bounded,
            center=sample_center(self.units, self.prediction, self.target),
        )

    def _as_arrays(self, table: DataFrame, columns: Sequence[str]) -> DataFrame:
        """One row per sample with an array per column, indexed by repeat * k + fold."""
        slot = F.col("repeat") * self.k + F.col("fold")
        maps = table.groupBy(*self.keys).agg(
            F.map_from_entries(F.collect_list(F.struct(slot.alias("s"), F.struct(*columns).alias("v")))).alias("m")
        )
        slots = F.sequence(F.lit(0), F.lit(self.repeats * self.k - 1))
        arrays = maps.select(
            *self.keys,
            *[F.transform(slots, lambda s: F.try_element_at("m", s)).getField(c).alias(c) for c in columns],
        )
        return bounded_broadcast(arrays, self.n_samples, 64 + 16 * len(columns) * self.repeats * self.k)

    def skills(self, recalibrator: str | None) -> DataFrame:
        """``(domain, replicate, repeat, model_mae, comparator_mae, skill, n_misplaced)``; no recalibrator means as deployed.

        ``n_misplaced`` counts the copies of a replicate whose fold is not that of their unit.
        """
        if self.bounded:
            found = replicate_skills(
                self.placed, [self.domain], self.id_col, self.target, self.prediction, repeats=self.repeats, k=self.k, recalibrator=recalibrator,
                resamples=self.resamples, seed=self.bootstrap_seed, mode=self.mode,
            )
            return found.select(
                *self.keys, "repeat", "model_mae", "comparator_mae", skill(F.col("model_mae"), F.col("comparator_mae")).alias("skill"), "n_misplaced"
            )
        params = self.medians().select(*self.keys, "repeat", "fold", "median")
        columns = ["median"]
        if recalibrator in ("affine_L1", "affine_OLS"):
            params = params.join(
                self.coefficients(recalibrator).select(*self.keys, "repeat", "fold", "intercept", "slope"), [*self.keys, "repeat", "fold"]
            )
            columns += ["intercept", "slope"]
        arrays = self._as_arrays(params, columns)
        joined = self.copies.join(arrays, self.keys)
        m, y, x = F.col("multiplicity"), F.col(self.target), F.col(self.prediction)
        sums = [F.sum(m).alias("w"), F.sum(m * F.abs(x - y)).alias("deployed")]
        for r in range(self.repeats):
            slot = F.element_at("folds", r + 1) + (r * self.k + 1)
            sums.append(F.sum(m * F.abs(F.element_at("median", slot) - y)).alias(f"c{r}"))
            # copies whose fold has no fit must not drop out of one side of the comparison
            fit = "intercept" if len(columns) > 1 else "median"
            sums.append(F.sum(F.when(F.element_at("median", slot).isNull() | F.element_at(fit, slot).isNull(), m).otherwise(0)).alias(f"u{r}"))
            if len(columns) > 1:
                fitted = F.element_at("intercept", slot) + F.element_at("slope", slot) * x
                sums.append(F.sum(m * F.abs(fitted - y)).alias(f"m{r}"))
        wide = joined.groupBy(*self.keys).agg(*sums)
        rows = [
            F.struct(
                F.lit(r).alias("repeat"),
                F.when(F.col(f"u{r}") == 0, (F.col(f"m{r}") if len(columns) > 1 else F.col("deployed")) / F.col("w")).alias("model_mae"),
                F.when(F.col(f"u{r}") == 0, F.col(f"c{r}") / F.col("w")).alias("comparator_mae"),
            )
            for r in range(self.repeats)
        ]
        long = wide.select(*self.keys, F.explode(F.array(*rows)).alias("e")).select(*self.keys, "e.*")
        if recalibrator == "isotonic":
            long = long.drop("model_mae").join(self.isotonic_errors(), [*self.keys, "repeat"])
        if not self.resamples:
            # the copies are the units themselves
            return long.select(
                *self.keys, "repeat", "model_mae", "comparator_mae", skill(F.col("model_mae"), F.col("comparator_mae")).alias("skill"), F.lit(0).cast("bigint").alias("n_misplaced")
            )
        stray = self.integrity_violations().groupBy(*self.keys).agg(F.sum("multiplicity").alias("n_misplaced"))
        return long.join(stray, self.keys, "left").select(
            *self.keys, "repeat", "model_mae", "comparator_mae", skill(F.col("model_mae"), F.col("comparator_mae")).alias("skill"),
            F.coalesce("n_misplaced", F.lit(0)).cast("bigint").alias("n_misplaced"),
        )

    def isotonic_errors(self) -> DataFrame:
        predicted = isotonic_predictions(
            self.copies, self.keys, [self.target, "multiplicity"], self.prediction, self.target, repeats=self.repeats, k=self.k
        )
        error = F.sum(F.col("multiplicity") * F.abs(F.col("prediction") - F.col(self.target))) / F.sum("multiplicity")
        return predicted.groupBy(*self.keys, "repeat").agg(error.alias("model_mae"))

    def predictions(self, recalibrator: str) -> DataFrame:
        return crossfit_predictions(
            self.copies, self.keys, self.id_col, self.prediction, self.target, recalibrator,
            repeats=self.repeats, k=self.k, bounded=self.bounded,
        )

    def integrity_violations(self) -> DataFrame:
        """Copies whose fold array differs from the unit's own; inheritance is a join, so this stays empty."""
        own = self.units.select(self.domain, self.id_col, F.col("folds").alias("__own"))
        return self.copies.join(own, [self.domain, self.id_col]).where(~F.col("folds").eqNullSafe(F.col("__own")))


def replicate_deltas(skills: DataFrame, domain: str, in_domain: str, out_domain: str) -> DataFrame:
    """``(replicate, s_id, s_ood, delta)``: mean over repeats first, then out minus in."""
    return skills.groupBy("replicate").agg(
        F.avg(F.when(F.col(domain) == in_domain, F.col("skill"))).alias("s_id"),
        F.avg(F.when(F.col(domain) == out_domain, F.col("skill"))).alias("s_ood"),
        F.count_if(F.col("skill").isNull()).alias("n_undefined"), F.sum("n_misplaced").alias("n_misplaced"),
    ).withColumn("delta", F.col("s_ood") - F.col("s_id"))


def directional_verdict(ci_low: Column, ci_high: Column, positive: str = "POSITIVE") -> Column:
    """``positive`` when the whole interval is below zero; ``INVALID`` for a crossed or missing interval."""
    return (
        F.when(ci_low.isNull() | ci_high.isNull() | F.isnan(ci_low) | F.isnan(ci_high) | (ci_low > ci_high), F.lit("INVALID"))
        .when(ci_high < 0, F.lit(positive))
        .otherwise(F.lit("UNRESOLVED"))
    )


def refuse_unusable(units: DataFrame, domain: str, id_col: str, values: Sequence[str]) -> None:
    """Raise unless every (domain, id) occurs once and has finite values."""
    bad = F.col(id_col).isNull() | F.col(domain).isNull()
    for v in values:
        bad = bad | not_finite(v)
    per_id = units.groupBy(domain, id_col).agg(F.count(F.lit(1)).alias("n"), F.max(bad.cast("int")).alias("bad"))
    found = per_id.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    if found["repeated"] or found["bad"]:
        raise ContractError(f"{found['repeated']} repeated ids, {found['bad']} ids with missing or non-finite values")


def shift_endpoint(
    units: DataFrame, domain: str, id_col: str, target: str, prediction: str, in_domain: str, out_domain: str, *,
    recalibrator: str | None = None, seeds: Sequence[int] = CROSSFIT_SEEDS, k: int = CROSSFIT_FOLDS,
    resamples: int = BOOTSTRAP_RESAMPLES, bootstrap_seed: int = BOOTSTRAP_SEED, mode: str = "multinomial",
) -> DataFrame:
    """One row: both skills, their difference, its bootstrap interval and the verdict.

    Without a recalibrator this is the as-deployed endpoint; with one it is the
    recoverable-skill endpoint, refitted inside every replicate. Only the deployed
    and the least-absolute-deviation endpoint carry a verdict. Repeated ids, nulls and values that
    are not finite are refused.
    """
    # the source is read once; the contract and everything after start from what was read
    units = cut_lineage(units.select(domain, id_col, target, prediction))
    refuse_unusable(units, domain, id_col, [target, prediction])
    samples = Samples(
        units, domain, id_col, target, prediction, seeds=seeds, k=k, resamples=resamples, bootstrap_seed=bootstrap_seed, mode=mode
    )
    deltas = replicate_deltas(samples.skills(recalibrator), domain, in_domain, out_domain)
    return summarize_endpoint(deltas, recalibrator, len(seeds), k, resamples, bootstrap_seed)


def summarize_endpoint(
    deltas: DataFrame, recalibrator: str | None, repeats: int, k: int, resamples: int, bootstrap_seed: int
) -> DataFrame:
    # Both inputs have one row per replicate at most, and both results have one row.
    tail = 0.025
    drawn = F.when(F.col("replicate") > 0, F.col("delta"))
    out = deltas.agg(
        F.max(F.when(F.col("replicate") == 0, F.col("s_id"))).alias("s_id"),
        F.max(F.when(F.col("replicate") == 0, F.col("s_ood"))).alias("s_ood"),
        F.max(F.when(F.col("replicate") == 0, F.col("delta"))).alias("delta"),
        F.percentile(drawn, F.array(F.lit(tail), F.lit(1.0 - tail))).alias("__ci"),
        F.sum("n_undefined").alias("n_undefined"), F.sum("n_misplaced").alias("n_misplaced"), F.count(drawn).alias("__drawn"),
    ).withColumns({"ci_low": F.col("__ci")[0], "ci_high": F.col("__ci")[1]}).drop("__ci")
    positive = "REPLICATED" if recalibrator == "affine_L1" else "POSITIVE"
    judged = recalibrator in (None, "affine_L1")
    # an undefined skill or a misplaced copy anywhere, or a replicate without a difference, leaves no verdict to give
    complete = (F.coalesce("n_undefined", F.lit(1)) == 0) & (F.coalesce("n_misplaced", F.lit(1)) == 0) & (F.col("__drawn") >= resamples)
    called = F.when(complete, directional_verdict(F.col("ci_low"), F.col("ci_high"), positive)).otherwise(F.lit("INVALID"))
    verdict = called if judged else F.lit(None).cast("string")
    return out.withColumns(
        {
            "recalibration": F.lit(recalibrator or "NONE"),
            "repeats": F.lit(repeats), "n_folds": F.lit(k), "resamples": F.lit(resamples), "bootstrap_seed": F.lit(bootstrap_seed),
            "verdict": verdict,
        }
    ).drop("__drawn")


def aggregate_gate(df: DataFrame, columns: Sequence[str], macro: float = 0.80, each: float = 0.60) -> DataFrame:
    """Column means, their mean, and whether the macro mean and every column mean reach their floors.

    Means are rounded to 12 digits before the comparison because distributed sums
    are not exactly rounded.
    """
    means = df.agg(*[F.round(F.avg(c), 12).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
    passes = F.round(total, 12) >= macro
    for c in columns:
        passes = passes & (F.col(c) >= each)
    return means.withColumn("macro_mean", total).withColumn("passed", passes)


def point_estimates(samples: Samples, in_domain: str, out_domain: str, recalibrators: Mapping[str, str | None]) -> DataFrame:
    """Long table ``(metric, value)``: skills and difference of every endpoint on the sample itself."""
    out: DataFrame | None = None
    for name, recalibrator in recalibrators.items():
        row = replicate_deltas(samples.skills(recalibrator).where("replicate = 0"), samples.domain, in_domain, out_domain)
        entries = F.array(
            *[F.struct(F.lit(f"{name}.{label}").alias("metric"), F.col(c).alias("value")) for label, c in (("S_ID", "s_id"), ("S_OOD", "s_ood"), ("Delta", "delta"))]
        )
        long = row.select(F.explode(entries).alias("e")).select("e.*")
        out = long if out is None else out.unionByName(long)
    return out
