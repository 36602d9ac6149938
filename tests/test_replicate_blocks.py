"""Replicates by blocks, isotonic rounds and the two forms of the L1 fit against plain numpy and against each other."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import endpoints, metrics, recalibrate, replicate_blocks, resample
from driftgauge.operators.recalibrate import lad_line, pool_adjacent
from driftgauge.operators.replicate_blocks import replicate_skills

ARGS = ("domain", "unit_id", "q_true", "q_hat")


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d, n in (("ID", 83), ("OOD", 59)):
        t = rng.random(n).round(2)
        rows += [(d, f"{d}{i}", float(v), float(round(0.3 + 0.4 * v + 0.3 * rng.random(), 2))) for i, v in enumerate(t)]
    return spark.createDataFrame(rows, "domain string, unit_id string, q_true double, q_hat double").cache()


@pytest.fixture
def small_tasks(spark):
    spark.conf.set("driftgauge.task.rows", "25")
    yield
    spark.conf.unset("driftgauge.task.rows")


def samples(units, **options):
    return endpoints.Samples(units, *ARGS, seeds=(11, 12, 13), k=4, **options)


@pytest.mark.parametrize("mode", ["multinomial", "poisson"])
def test_multiplicities_are_those_of_the_drawn_copies(units, mode):
    """Skills of replicates by blocks equal those of the copies that ``draw`` makes."""
    made = samples(units, resamples=9, mode=mode)
    copies = made.copies.toPandas()
    found = {(r["domain"], r["replicate"], r["repeat"]): r for r in made.skills(None).collect()}
    assert len(found) == 2 * 10 * 3
    for (d, b), part in copies.groupby(["domain", "replicate"]):
        folds, m = np.stack(part["folds"].to_numpy()), part["multiplicity"].to_numpy()
        y, x = part["q_true"].to_numpy(), part["q_hat"].to_numpy()
        for r in range(3):
            base = np.empty(len(y))
            for f in range(4):
                own = folds[:, r] == f
                base[own] = np.median(np.repeat(y[~own], m[~own]))
            row = found[d, b, r]
            assert row["comparator_mae"] == pytest.approx(m @ np.abs(base - y) / m.sum())
            assert row["model_mae"] == pytest.approx(m @ np.abs(x - y) / m.sum()) and row["n_misplaced"] == 0


@pytest.mark.parametrize("name", [None, "affine_OLS", "isotonic"])
def test_both_sides_of_the_switch(spark, units, name):
    want = {(r["domain"], r["replicate"], r["repeat"]): r["skill"] for r in samples(units, resamples=2).skills(name).collect()}
    spark.conf.set("driftgauge.task.rows", "25")
    try:
        large = samples(units, resamples=2)
        assert not large.bounded
        got = {(r["domain"], r["replicate"], r["repeat"]): r["skill"] for r in large.skills(name).collect()}
    finally:
        spark.conf.unset("driftgauge.task.rows")
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key], abs=1e-6) for key in want)


def test_misplaced_copies_are_counted(units):
    made = samples(units, resamples=3)
    moved = made.placed.withColumn("folds", F.when(F.col("unit_id") == "ID3", F.array(F.lit(9), F.lit(0), F.lit(1))).otherwise(F.col("folds")))
    found = replicate_skills(moved, ["domain"], "unit_id", "q_true", "q_hat", repeats=3, k=4, recalibrator=None, resamples=3, seed=2026)
    stray = {(r["domain"], r["replicate"], r["repeat"]): r["n_misplaced"] for r in found.where("n_misplaced > 0").collect()}
    times = {r["replicate"]: r["multiplicity"] for r in made.copies.where("unit_id = 'ID3'").collect()}
    assert stray == {("ID", b, 0): m for b, m in times.items()}


def test_competence_of_both_forms(spark, units, small_tasks):
    large = metrics.competence(units, ["domain"], "unit_id", "q_true", "q_hat", resamples=30, seed=5).orderBy("domain").collect()
    spark.conf.unset("driftgauge.task.rows")
    small = metrics.competence(units, ["domain"], "unit_id", "q_true", "q_hat", resamples=30, seed=5).orderBy("domain").collect()
    for a, b in zip(large, small):
        assert (a["domain"], a["n"], a["n_undefined"], a["verdict"]) == (b["domain"], b["n"], b["n_undefined"], b["verdict"])
        assert [a[c] for c in ("rho", "ci_low", "ci_high")] == pytest.approx([b[c] for c in ("rho", "ci_low", "ci_high")])


def test_replicate_ranks_against_numpy(units):
    made = samples(units, resamples=6)
    from driftgauge.operators.replicate_blocks import replicate_rank_correlations

    found = {(r["domain"], r["replicate"]): r["value"] for r in replicate_rank_correlations(made.placed, *[["domain"], "unit_id", "q_true", "q_hat"], resamples=6, seed=2026).collect()}
    for key, part in made.copies.toPandas().groupby(["domain", "replicate"]):
        part = part.loc[part.index.repeat(part["multiplicity"])]
        assert found[key] == pytest.approx(np.corrcoef(part["q_true"].rank(), part["q_hat"].rank())[0, 1])


SHAPES = {
    "constant": lambda rng: ([0.7] * 40, rng.random(40).round(3)),
    "large constant": lambda rng: ([1e9 + 1] * 40, rng.random(40).round(3)),
    "two points": lambda rng: ([0.25, 0.75] * 20, rng.random(40).round(3)),
    "ties": lambda rng: (rng.integers(0, 4, 40) / 4, rng.integers(0, 3, 40) / 3),
    "one differs": lambda rng: ([0.5] * 39 + [0.9], rng.random(40).round(3)),
    "outlier": lambda rng: (np.r_[rng.random(39), 1e6], np.r_[rng.random(39), -5.0]),
}


def test_l1_lines_of_both_forms(spark):
    """Constant, two-point and tied predictors: equal lines (or, where the line is not unique, equal objectives)."""
    rng = np.random.default_rng(1)
    rows = []
    for name, shape in SHAPES.items():
        x, y = shape(rng)
        rows += [(name, i, float(a), float(b), [i % 4]) for i, (a, b) in enumerate(zip(x, y))]
    copies = spark.createDataFrame(rows, "s string, id int, x double, y double, folds array<int>").withColumn("multiplicity", F.lit(1).cast("bigint"))
    one, many = (
        {(r["s"], r["fold"]): r for r in recalibrate.l1_coefficients(copies, ["s"], "x", "y", repeats=1, k=4, bounded=b).collect()} for b in (True, False)
    )
    assert one.keys() == many.keys() and len(one) == 4 * len(SHAPES)
    for (name, fold), a in one.items():
        b = many[name, fold]
        x, y = (np.array([r[c] for r in rows if r[0] == name and r[4] != [fold]]) for c in (2, 3))
        cost = [np.abs(y - r["intercept"] - r["slope"] * x).mean() for r in (a, b)]
        assert cost[0] == pytest.approx(cost[1], abs=1e-7), name
        if "constant" in name:
            assert a["slope"] == pytest.approx(b["slope"], rel=1e-6) and a["intercept"] == pytest.approx(b["intercept"], rel=1e-6)
        assert cost[0] == pytest.approx(np.abs(y - np.array([1, 0]) @ [lad_line(x, y, np.ones(len(x)))[0], 0] - lad_line(x, y, np.ones(len(x)))[1] * x).mean(), abs=1e-7)


def test_l1_lines_in_blocks(monkeypatch):
    """Blocks give the lines of the plain form; a fit whose points have one x among others that do not takes the plain form."""
    rng = np.random.default_rng(4)
    n = 700
    x = np.r_[rng.random(n), np.full(40, 1e9)]
    y = np.r_[0.3 + 0.5 * x[:n] + 0.2 * rng.standard_normal(n), rng.random(40)]
    weights = np.zeros((4, n + 40))
    weights[:3, :n] = rng.integers(0, 3, (3, n))
    weights[3, n:] = 1.0
    plain = recalibrate.lad_lines(x, y, weights)
    monkeypatch.setattr(recalibrate, "LAD_BLOCKED", 500)
    blocked = recalibrate.lad_lines(x, y, weights)
    assert np.stack(blocked) == pytest.approx(np.stack(plain), abs=1e-7)
    few = recalibrate.lad_lines(x[:n], y[:n], weights[:3, :n])
    assert np.stack(few) == pytest.approx(np.stack(plain)[:, :3], abs=1e-7)
    assert recalibrate._lad_lines_blocked(x[:n], y[:n], weights[:3, :n], 80, 1e-9)[2].all()


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "steps"])
def test_isotonic_rounds(spark, small_tasks, shape):
    """Long runs that pool across many ranges, and fits that hardly pool at all."""
    rng = np.random.default_rng(2)
    n = 400
    x = rng.permutation(n) // 2 / 100.0
    y = {"noise": rng.random(n), "rising": x + 0.0, "falling": -x, "steps": np.floor(x) + 0.8 * rng.random(n)}[shape]
    folds = np.stack([rng.permutation(n) % 5, rng.permutation(n) % 5], axis=1)
    m = rng.integers(1, 4, n)
    rows = [("a", i, float(x[i]), float(y[i]), [int(f) for f in folds[i]], int(m[i])) for i in range(n)]
    copies = spark.createDataFrame(rows, "s string, id int, x double, y double, folds array<int>, multiplicity bigint").repartition(5)
    got = {(r["id"], r["repeat"]): r["prediction"] for r in recalibrate.isotonic_predictions(copies, ["s"], ["id"], "x", "y", repeats=2, k=5).collect()}
    assert len(got) == 2 * n
    for r in range(2):
        for f in range(5):
            own = folds[:, r] == f
            want = np.interp(x[own], *pool_adjacent(x[~own], y[~own], m[~own].astype(float)))
            assert [got[int(i), r] for i in np.flatnonzero(own)] == pytest.approx(list(want))


@pytest.mark.parametrize("distinct", [True, False])
def test_isotonic_predictions_of_a_replicate(monkeypatch, distinct):
    """Fits in the order of x equal fits that sort for themselves, with and without ties, and sort nothing."""
    rng = np.random.default_rng(8)
    n = 900
    x = np.sort(rng.random(n) if distinct else rng.random(n).round(2))
    y, m, folds = x + 0.5 * rng.random(n), rng.integers(1, 4, n).astype(float), rng.integers(0, 5, n)
    want = np.empty(n)
    for f in range(5):
        own = folds == f
        want[own] = np.interp(x[own], *pool_adjacent(x[~own], y[~own], m[~own]))
    monkeypatch.setattr(np, "unique", None)
    assert replicate_blocks._isotonic_predictions(x, y, m, folds, 5) == pytest.approx(want, abs=1e-12)
    assert np.isnan(replicate_blocks._isotonic_predictions(x, y, m, np.zeros(n, dtype=int), 5)).all()


def test_errors_of_replicates_are_those_of_the_copies(spark, units):
    """Also with a null cell, a null error and a cell that some replicates do not draw."""
    cell = F.when(F.col("unit_id") == "ID1", "rare").when(F.col("unit_id") == "ID2", F.lit(None)).otherwise(F.substring("unit_id", -1, 1))
    made = units.select("domain", "unit_id", cell.alias("cell"), F.when(F.col("unit_id") != "OOD7", F.col("q_hat") - F.col("q_true")).alias("e"))
    placed = resample.place_units(made, ["domain"], "unit_id", 3, blocks=False)
    got = replicate_blocks.replicate_errors(placed, ["domain"], "unit_id", "cell", "e", resamples=8, seed=3)
    m = F.col("multiplicity")
    copies = resample.bootstrap(made, ["domain"], "unit_id", resamples=8, seed=3, include_original=True, blocks=False)
    want = copies.groupBy("domain", "replicate", "cell").agg(F.sum(m).alias("n"), (F.sum(m * F.abs("e")) / F.sum(m)).alias("mae"), (F.sum(m * F.col("e")) / F.sum(m)).alias("bias"))
    one, other = ({(r["domain"], r["replicate"], r["cell"]): [r[c] for c in ("n", "mae", "bias")] for r in t.collect()} for t in (got, want))
    assert one.keys() == other.keys() and sum(key[2] == "rare" for key in one) < 9
    assert all(one[key] == pytest.approx(other[key]) for key in one)


def test_replicate_queries_make_no_copies(spark, monkeypatch):
    """While a sample fits a task, nothing is drawn by a shuffle."""
    from driftgauge.plans import replicates

    monkeypatch.setattr(replicates, "bootstrap", None)
    assert replicates.replicate_values(spark, "/root/testdata/sf0.001").where("metric = 'mae'").count() > 0
