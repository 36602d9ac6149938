"""Fits against brute force, cross-fitting against numpy, and leakage by mutation."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import endpoints, recalibrate
from driftgauge.operators.recalibrate import lad_line, pool_adjacent, weighted_line

GRID = np.linspace(0, 1, 9)
SHAPES = {
    "perfect": (GRID, 0.2 + 0.5 * GRID),
    "positive": (GRID, 0.1 + 0.8 * GRID + 0.05 * np.sin(9 * GRID)),
    "negative": (GRID, 0.9 - 0.6 * GRID + 0.05 * np.cos(7 * GRID)),
    "shift": (GRID, GRID + 0.3),
    "ties": (np.array([0.1, 0.1, 0.2, 0.2, 0.3, 0.3]), np.array([0.1, 0.3, 0.2, 0.4, 0.3, 0.35])),
    "outlier": (GRID, np.where(GRID > 0.9, 5.0, GRID)),
    "constant": (np.full(5, 0.4), np.array([0.1, 0.2, 0.5, 0.6, 0.9])),
    "two": (np.array([0.0, 1.0]), np.array([0.3, 0.7])),
    "near": (0.5 + 1e-4 * GRID, 0.1 + GRID),
}


def best_objective(x, y):
    """Some optimal line passes through two points (or is flat when x is constant)."""
    best = min(np.abs(y - v).sum() for v in y)
    for i, j in itertools.combinations(range(len(x)), 2):
        if x[i] != x[j]:
            b = (y[j] - y[i]) / (x[j] - x[i])
            best = min(best, np.abs(y - (y[i] - b * x[i]) - b * x).sum())
    return best


@pytest.mark.parametrize("name", SHAPES)
def test_lad_reaches_the_optimum(name):
    x, y = SHAPES[name]
    a, b = lad_line(x, y, np.ones(len(x)))
    assert np.abs(y - a - b * x).sum() <= best_objective(x, y) + 1e-8


def test_constant_x_gives_minimum_norm():
    x, y = SHAPES["constant"]
    expected = np.linalg.lstsq(np.column_stack([np.ones(5), x]), y, rcond=None)[0]
    assert weighted_line(x, y, np.ones(5)) == pytest.approx(tuple(expected))


def test_isotonic_is_the_min_max_solution():
    rng = np.random.default_rng(0)
    x, y, m = rng.permutation(30) / 30.0, rng.random(30), rng.integers(1, 4, 30).astype(float)
    knots, fitted = pool_adjacent(x, y, m)
    order = np.argsort(x)
    ys, ms = y[order], m[order]
    average = lambda i, j: (ys[i : j + 1] @ ms[i : j + 1]) / ms[i : j + 1].sum()
    expected = [max(min(average(i, j) for j in range(t, 30)) for i in range(t + 1)) for t in range(30)]
    assert knots == pytest.approx(x[order]) and fitted == pytest.approx(expected)


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(3)
    rows = [
        (d, f"{d}{i:03d}", float(t), float(0.2 + 0.5 * t + 0.2 * rng.random()))
        for d, n in (("ID", 61), ("OOD", 47)) for i, t in enumerate(rng.random(n).round(2))
    ]
    return spark.createDataFrame(rows, "domain string, unit_id string, q_true double, q_hat double").cache()


def make(units, resamples=0):
    return endpoints.Samples(units, "domain", "unit_id", "q_true", "q_hat", seeds=(11, 12, 13), k=4, resamples=resamples)


def copies_frame(samples):
    return samples.copies.select("domain", "replicate", "q_true", "q_hat", "folds", "multiplicity").toPandas()


def numpy_skills(frame, k, fit):
    out = {}
    for (d, rep), part in frame.groupby(["domain", "replicate"]):
        part = part.loc[part.index.repeat(part["multiplicity"])]
        folds = np.stack(part["folds"].to_numpy())
        x, y = part["q_hat"].to_numpy(), part["q_true"].to_numpy()
        for r in range(folds.shape[1]):
            comparator, model = np.empty(len(y)), np.empty(len(y))
            for f in range(k):
                own = folds[:, r] == f
                comparator[own] = np.median(y[~own])
                model[own] = fit(x[~own], y[~own], x[own])
            out[d, rep, r] = 1 - np.abs(model - y).mean() / np.abs(comparator - y).mean()
    return out


def fit_ols(x, y, at):
    b, a = np.polyfit(x, y, 1)
    return a + b * at


def fit_l1(x, y, at):
    a, b = lad_line(x, y, np.ones(len(x)))
    return a + b * at


def fit_isotonic(x, y, at):
    return np.interp(at, *pool_adjacent(x, y, np.ones(len(x))))


@pytest.mark.parametrize("name,fit", [(None, lambda x, y, at: at), ("affine_OLS", fit_ols), ("affine_L1", fit_l1), ("isotonic", fit_isotonic)])
def test_bootstrapped_skills_match_numpy(units, name, fit):
    samples = make(units, 4)
    expected = numpy_skills(copies_frame(samples), 4, fit)
    found = {(r["domain"], r["replicate"], r["repeat"]): r["skill"] for r in samples.skills(name).collect()}
    assert found.keys() == expected.keys()
    assert all(found[key] == pytest.approx(expected[key], abs=1e-6) for key in expected)


def test_large_sample_forms_agree(spark, units):
    small = make(units)
    want = {n: small.coefficients(n).orderBy("domain", "repeat", "fold").collect() for n in ("affine_OLS",)}
    bounded = recalibrate.l1_coefficients(small.copies, small.keys, "q_hat", "q_true", repeats=3, k=4, bounded=True).orderBy("domain", "repeat", "fold").collect()
    distributed = recalibrate.l1_coefficients(small.copies, small.keys, "q_hat", "q_true", repeats=3, k=4, bounded=False, iterations=6).orderBy("domain", "repeat", "fold").collect()
    short = recalibrate.l1_coefficients(small.copies, small.keys, "q_hat", "q_true", repeats=3, k=4, bounded=True, iterations=6).orderBy("domain", "repeat", "fold").collect()
    for x, y in zip(distributed, short):
        assert (x["domain"], x["repeat"], x["fold"], x["n_train"]) == (y["domain"], y["repeat"], y["fold"], y["n_train"])
        assert x["intercept"] == pytest.approx(y["intercept"], abs=1e-7) and x["slope"] == pytest.approx(y["slope"], abs=1e-7)
    assert len(bounded) == len(want["affine_OLS"]) == 24
    spark.conf.set("driftgauge.task.rows", "10")
    try:
        large = make(units)
        assert not large.bounded
        a, b = (sorted(map(tuple, s.skills(None).collect())) for s in (small, large))
        assert [v[:3] for v in a] == [v[:3] for v in b] and [v[-1] for v in a] == pytest.approx([v[-1] for v in b])
    finally:
        spark.conf.unset("driftgauge.task.rows")


def test_distributed_isotonic_agrees(units):
    samples = endpoints.Samples(units, "domain", "unit_id", "q_true", "q_hat", seeds=(11,), k=2)
    args = (samples.copies, samples.keys, "unit_id", "q_hat", "q_true", "isotonic")
    small, large = (
        {(r["unit_id"], r["repeat"]): r["prediction"] for r in recalibrate.crossfit_predictions(*args, repeats=1, k=2, bounded=b).collect()} for b in (True, False)
    )
    assert small.keys() == large.keys() and all(small[key] == pytest.approx(large[key]) for key in small)


def test_own_label_cannot_move_own_prediction(units):
    victim = "ID007"
    changed = units.withColumn("q_true", F.when(F.col("unit_id") == victim, 0.0).otherwise(F.col("q_true")))
    for name in ("affine_OLS", "affine_L1", "isotonic"):
        before, after = (
            {r["repeat"]: r["prediction"] for r in make(u).predictions(name).where(F.col("unit_id") == victim).collect()} for u in (units, changed)
        )
        assert before == pytest.approx(after)


def test_copies_inherit_folds(units):
    assert make(units, 5).integrity_violations().count() == 0


def test_endpoint_row(units):
    row = endpoints.shift_endpoint(units, "domain", "unit_id", "q_true", "q_hat", "ID", "OOD", seeds=(11, 12), k=4, resamples=20).first()
    assert row["ci_low"] <= row["delta"] + 0.5 and row["verdict"] in ("POSITIVE", "UNRESOLVED")
    assert row["delta"] == pytest.approx(row["s_ood"] - row["s_id"])
    assert endpoints.shift_endpoint(units, "domain", "unit_id", "q_true", "q_hat", "ID", "OOD", recalibrator="affine_OLS", seeds=(11,), k=4, resamples=5).first()["verdict"] is None


def test_runs_pool_like_single_pairs():
    """Whole falling runs at once, and the stack for what is left, give the fit that pooling pair by pair gives, several fits side by side."""
    rng = np.random.default_rng(5)
    shapes = [rng.normal(size=400), np.arange(300.0), -np.arange(300.0), np.append(np.arange(200.0), -1e6), np.zeros(50), rng.integers(0, 3, 500).astype(float), np.array([1.0])]
    y, m = np.concatenate(shapes), rng.integers(1, 5, sum(map(len, shapes))).astype(float)
    start = np.zeros(len(y), dtype=bool)
    start[np.cumsum([0, *map(len, shapes[:-1])])] = True
    at = np.arange(len(y))
    first, last, mass, total, begins = recalibrate.pool_runs(at, at, m, m * y, start)
    got, want = np.repeat(total / mass, last - first + 1), []
    for part in np.split(at, np.flatnonzero(start)[1:]):
        stack = []
        for i in part:
            stack.append([y[i], m[i], 1])
            while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
                v, w, c = stack.pop()
                stack[-1] = [(stack[-1][0] * stack[-1][1] + v * w) / (stack[-1][1] + w), stack[-1][1] + w, stack[-1][2] + c]
        want += [v for v, _, c in stack for _ in range(c)]
    assert got == pytest.approx(want, abs=1e-9) and begins.sum() == len(shapes)


def test_rows_of_one_x_in_several_batches_are_averaged_first(spark, monkeypatch):
    """Every range is pooled some rows at a time; an x whose rows come in several turns still counts as one, for each key."""
    monkeypatch.setattr(recalibrate, "POOLED_ROWS", 7)
    rng = np.random.default_rng(8)
    data = [(s, i % 3, i, float(rng.integers(0, 6)), float(rng.normal()), int(rng.integers(1, 4)), [int(v) for v in rng.integers(0, 3, 2)]) for s in "ab" for i in range(90)]
    copies = spark.createDataFrame(data, "s string, t int, id int, x double, y double, multiplicity bigint, folds array<int>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {tuple(r[:4]): r["prediction"] for r in recalibrate.isotonic_predictions(copies, ["s", "t"], ["id"], "x", "y", repeats=2, k=3).collect()}
        spark.conf.set("driftgauge.broadcast.bytes", "1")
        sorted_form = {tuple(r[:4]): r["prediction"] for r in recalibrate.isotonic_predictions(copies, ["s", "t"], ["id"], "x", "y", repeats=2, k=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("driftgauge.broadcast.bytes")
    want = {}
    for s, t, i, x, _, _, folds in data:
        for r in range(2):
            train = [d for d in data if d[0] == s and d[1] == t and d[6][r] != folds[r]]
            knots, fitted = pool_adjacent(*(np.array([d[c] for d in train], dtype=float) for c in (3, 4, 5)))
            want[s, t, i, r] = np.interp(x, knots, fitted)
    assert got == pytest.approx(want, abs=1e-9) and sorted_form == pytest.approx(want, abs=1e-9)


def test_samples_without_replicates_are_neither_placed_nor_joined_with_themselves(spark):
    """Draw places and the check of inherited folds are for copies; a sample beyond a task goes without both."""
    units = spark.range(60).select(
        F.when(F.col("id") % 2 == 0, "ID").otherwise("OOD").alias("domain"), F.col("id").cast("string").alias("unit_id"),
        (F.col("id") * 7 % 31 / 31.0).alias("q_true"), (F.col("id") * 11 % 37 / 37.0).alias("q_hat"),
    )
    spark.conf.set("driftgauge.task.rows", "5")
    try:
        made = endpoints.Samples(units, "domain", "unit_id", "q_true", "q_hat", seeds=(11, 12), k=3)
        rows = made.skills("isotonic").collect()
    finally:
        spark.conf.unset("driftgauge.task.rows")
    assert "placed" not in vars(made) and {r["n_misplaced"] for r in rows} == {0} and len(rows) == 4
