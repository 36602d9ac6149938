"""Quality predictors: mean, ridge with a cross-validated penalty, boosted trees; scoring from features."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftgauge.operators.contracts import assert_clean, contract_violations, population_violations
from driftgauge.operators.resample import repeated_folds
from driftgauge.session import cut_lineage

# Penalty grid, cross-validation and tree settings.
ALPHA_GRID = (
    0.0001, 0.0003, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10000.0,
)
CV_FOLDS = 5
CV_SEED = 2026
TREES, LEARNING_RATE, MIN_LEAF = 100, 0.1, 20


@dataclass(frozen=True)
class LinearModel:
    """A standardised linear predictor; a few numbers per feature."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coefficient: tuple[float, ...]
    intercept: float
    alpha: float

    def score(self) -> Column:
        """The prediction as a column expression, unclipped."""
        out = F.lit(self.intercept)
        for f, m, s, c in zip(self.features, self.mean, self.scale, self.coefficient):
            out = out + F.lit(c) * (F.col(f) - F.lit(m)) / F.lit(s)
        return out

    def table(self, spark) -> DataFrame:
        rows = [
            (i, f, float(m), float(s), float(c), float(self.intercept), float(self.alpha))
            for i, (f, m, s, c) in enumerate(zip(self.features, self.mean, self.scale, self.coefficient))
        ]
        return spark.createDataFrame(
            rows, "position int, feature string, mean double, scale double, coefficient double, intercept double, alpha double"
        )


def train_mean(df: DataFrame, train: Column, target: str) -> float:
    """The mean baseline: one number, used for every row."""
    return float(df.where(train).agg(F.avg(target).alias("m")).first()["m"])


def standardization(df: DataFrame, features: Sequence[str]) -> tuple[list[float], list[float]]:
    """Mean and population standard deviation per feature; a constant feature gets scale one."""
    row = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    means = [float(row[f"m{i}"]) for i in range(len(features))]
    scales = [float(row[f"s{i}"]) or 1.0 for i in range(len(features))]
    return means, scales


def standardized(df: DataFrame, features: Sequence[str], means: Sequence[float], scales: Sequence[float]) -> DataFrame:
    return df.withColumns({f: (F.col(f) - F.lit(m)) / F.lit(s) for f, m, s in zip(features, means, scales)})


def fold_moments(df: DataFrame, columns: Sequence[str], fold_col: str, k: int, center: Sequence[float]) -> np.ndarray:
    """Per fold, the (1 + c) x (1 + c) matrix of sums of products of ``1, columns - center``.

    Every task adds its batches up and emits one matrix per fold; only sums travel.
    """
    columns = list(columns)
    size = len(columns) + 1
    shift = np.asarray(center, dtype=np.float64)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, size, size))
        for batch in batches:
            values = np.column_stack([np.ones(len(batch)), batch[columns].to_numpy(np.float64) - shift])
            folds = batch[fold_col].to_numpy()
            for f in range(k):
                part = values[folds == f]
                total[f] += part.T @ part
        yield pd.DataFrame({"fold": range(k), "moments": [m.ravel() for m in total]})

    parts = df.select(*columns, fold_col).mapInPandas(partial, "fold int, moments array<double>")
    sums = parts.select("fold", F.posexplode("moments").alias("pos", "v")).groupBy("fold", "pos").agg(F.sum("v").alias("v"))
    out = np.zeros((k, size * size))
    for row in sums.collect():  # k * (1 + c)^2 numbers, whatever the size of the table
        out[row["fold"], row["pos"]] = row["v"]
    return out.reshape(k, size, size)


def _standard_form(moments: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float, np.ndarray, np.ndarray]:
    """n, mean and scale of x, mean of y, and Z'Z, Z'(y - mean) for standardised x; last column is y."""
    n = moments[0, 0]
    mean = moments[0, 1:] / n
    centered = moments[1:, 1:] - n * np.outer(mean, mean)
    variance = np.maximum(np.diag(centered)[:-1] / n, 0.0)
    scale = np.sqrt(variance)
    scale[scale <= 1e-12 * np.maximum(np.abs(mean[:-1]), 1e-300)] = 1.0
    scale[scale == 0.0] = 1.0
    return n, mean[:-1], scale, mean[-1], centered[:-1, :-1] / np.outer(scale, scale), centered[:-1, -1] / scale


@dataclass(frozen=True)
class RidgeSearch:
    model: LinearModel
    fold_scores: DataFrame


def ridge_search(
    train: DataFrame, id_col: str, features: Sequence[str], target: str, *, alphas: Sequence[float] = ALPHA_GRID, k: int = CV_FOLDS, seed: int = CV_SEED
) -> RidgeSearch:
    """Penalty by k-fold mean absolute error, then a refit on all rows.

    Three passes: means, fold moments, fold errors. The moments of all folds give
    every training set by subtraction, scaling included, so the k * |alphas| fits
    are small solves; the errors of all of them come from one further pass.
    """
    features = list(features)
    columns = [*features, target]
    placed = repeated_folds(train.select(id_col, *columns).withColumn("__all", F.lit(0)), ["__all"], id_col, [seed], k)
    # Three passes follow, so the training matrix is pinned after its folds are known.
    data = cut_lineage(placed.select(*columns, F.element_at("folds", 1).alias("fold")))
    center = [float(v) for v in data.agg(*[F.avg(c) for c in columns]).first()]
    moments = fold_moments(data, columns, "fold", k, center)
    total = moments.sum(axis=0)

    eye = np.eye(len(features))
    weights = np.zeros((k, len(features), len(alphas)))
    offsets = np.zeros((k, len(alphas)))
    shift = np.asarray(center)
    for f in range(k):
        _, mean, scale, y_mean, gram, cross = _standard_form(total - moments[f])
        for a, alpha in enumerate(alphas):
            beta = np.linalg.solve(gram + alpha * eye, cross) / scale
            weights[f, :, a] = beta
            offsets[f, a] = (y_mean + shift[-1]) - beta @ (mean + shift[:-1])

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, len(alphas))), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x, y = batch[features].to_numpy(np.float64), batch[target].to_numpy(np.float64)
            folds = batch["fold"].to_numpy()
            for f in range(k):
                own = folds == f
                sums[f] += np.abs(x[own] @ weights[f] + offsets[f] - y[own, None]).sum(axis=0)
                counts[f] += int(own.sum())
        yield pd.DataFrame(
            {
                "fold": np.repeat(np.arange(k), len(alphas)), "alpha": np.tile(np.asarray(alphas, dtype=np.float64), k),
                "error": sums.ravel(), "n": np.repeat(counts, len(alphas)),
            }
        )

    scores = (
        data.mapInPandas(errors, "fold int, alpha double, error double, n bigint")
        .groupBy("alpha", "fold")
        .agg((F.sum("error") / F.sum("n")).alias("mae"))
    )
    rows = scores.groupBy("alpha").agg(F.avg("mae").alias("m")).collect()  # one row per alpha
    means = {row["alpha"]: row["m"] for row in rows}
    best = min(alphas, key=lambda a: means[float(a)])
    _, mean, scale, y_mean, gram, cross = _standard_form(total)
    beta = np.linalg.solve(gram + best * eye, cross)
    model = LinearModel(
        tuple(features), tuple((mean + shift[:-1]).tolist()), tuple(scale.tolist()), tuple(beta.tolist()), float(y_mean + shift[-1]), float(best)
    )
    return RidgeSearch(model, scores)


def cv_provenance(fold_scores: DataFrame) -> DataFrame:
    """Per penalty: mean and population spread of the fold errors, and the rank (ties share the best)."""
    table = fold_scores.groupBy("alpha").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("sd_mae")
    )
    # One row per penalty of the grid, so a single ordered partition is fine.
    return table.withColumn("rank", F.rank().over(W.partitionBy(F.lit(1)).orderBy("mean_mae")))


def selected_penalty(fold_scores: DataFrame) -> DataFrame:
    """``(alpha, fold, mae, mean_mae)`` of the penalty with the smallest mean fold error; ties go to the smaller penalty."""
    means = fold_scores.groupBy("alpha").agg(F.avg("mae").alias("mean_mae"))
    # a row per penalty of the grid, then one row
    best = means.orderBy("mean_mae", "alpha").limit(1)
    return fold_scores.join(F.broadcast(best), "alpha").select("alpha", "fold", "mae", "mean_mae")


def boosted_trees(
    train: DataFrame, features: Sequence[str], target: str, *, trees: int = TREES, learning_rate: float = LEARNING_RATE,
    min_leaf: int = MIN_LEAF, max_depth: int = 5, seed: int = CV_SEED,
) -> GBTRegressionModel:
    """Gradient-boosted regression trees with squared error, trained by MLlib."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="__features").transform(train.select(*features, target))
    return GBTRegressor(
        featuresCol="__features", labelCol=target, maxIter=trees, stepSize=learning_rate, maxDepth=max_depth,
        minInstancesPerNode=min_leaf, lossType="squared", seed=seed,
    ).fit(assembled)


def predict_trees(df: DataFrame, model: GBTRegressionModel, features: Sequence[str], name: str) -> DataFrame:
    assembled = VectorAssembler(inputCols=list(features), outputCol="__features").transform(df)
    return model.setPredictionCol(name).transform(assembled).drop("__features")


@dataclass(frozen=True)
class Baselines:
    mean: float
    ridge: RidgeSearch
    trees: GBTRegressionModel
    features: tuple[str, ...]


def fit_baselines(
    df: DataFrame, id_col: str, split_col: str, fit_split: str, features: Sequence[str], target: str, *,
    expected_n: int | None = None, forbidden: Sequence[str] = (), trees: int = TREES,
) -> Baselines:
    """Fit every baseline on the training split only, after its contract holds."""
    train = df.where(F.col(split_col) == fit_split)
    assert_clean(population_violations(train, split_col, id_col, fit_split, expected_n))
    assert_clean(contract_violations(train.select(id_col, *features, target), keys=[id_col], finite=[*features, target]))
    overlap = {f.casefold() for f in features} & {c.casefold() for c in (*forbidden, target, id_col, split_col)}
    if overlap:
        raise ValueError(f"forbidden model inputs: {sorted(overlap)}")
    return Baselines(
        train_mean(df, F.col(split_col) == fit_split, target),
        ridge_search(train, id_col, features, target),
        boosted_trees(train, features, target, trees=trees),
        tuple(features),
    )


def predict_baselines(df: DataFrame, fitted: Baselines, target: str, sort_cols: Sequence[str]) -> DataFrame:
    """Unclipped predictions and absolute errors of every baseline, for all rows."""
    out = df.withColumns({"mean_pred": F.lit(fitted.mean), "ridge_pred": fitted.ridge.model.score()})
    out = predict_trees(out, fitted.trees, fitted.features, "trees_pred")
    errors = {f"{m}_abs_error": F.abs(F.col(f"{m}_pred") - F.col(target)) for m in ("mean", "ridge", "trees")}
    return out.withColumns(errors).orderBy(*sort_cols)


def fit_deployed(
    df: DataFrame, id_col: str, population_col: str, population: str, features: Sequence[str], target: str, expected_n: int | None = None
) -> LinearModel:
    """Ridge on a frame that must hold exactly one population; refused otherwise."""
    assert_clean(population_violations(df, population_col, id_col, population, expected_n))
    return ridge_search(df, id_col, features, target).model
