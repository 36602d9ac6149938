"""Published small cases with known answers."""
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import conformal, endpoints, metrics, recalibrate

# Expected results of the small cases.
VALUES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
FOLDS = [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
MEDIANS = [0.65, 0.65, 0.55, 0.45, 0.45]


@pytest.fixture(scope="module")
def copies(spark):
    rows = [("ID", 0, f"p{i:02d}", v, v, [f], 1, i // 3) for i, (v, f) in enumerate(zip(VALUES, FOLDS))]
    return spark.createDataFrame(
        rows, "domain string, replicate int, unit_id string, q_true double, q_hat double, folds array<int>, multiplicity bigint, block int"
    )


def test_spearman_of_equal_vectors(copies):
    row = metrics.spearman(copies, ["domain"], "q_true", "q_hat").first()
    assert row["defined"] and row["value"] == pytest.approx(1.0)


def test_crossfit_medians(copies):
    out = recalibrate.leave_fold_out_medians(copies, ["domain", "replicate"], "q_true", repeats=1, k=5)
    found = {r["fold"]: r["median"] for r in out.collect()}
    assert [found[f] for f in range(5)] == pytest.approx(MEDIANS)


def test_comparator_error_and_skill(copies):
    out = recalibrate.leave_fold_out_medians(copies, ["domain", "replicate"], "q_true", repeats=1, k=5)
    joined = copies.withColumn("fold", F.col("folds")[0]).join(out.select("fold", "median"), "fold")
    row = joined.agg(
        F.avg(F.abs(F.col("median") - F.col("q_true"))).alias("c"), F.avg(F.abs(F.col("q_hat") - F.col("q_true"))).alias("m")
    ).select("c", metrics.skill(F.col("m"), F.col("c")).alias("s")).first()
    assert row["c"] == pytest.approx(0.33) and row["s"] == pytest.approx(1.0)


def test_skill_without_comparator_error_is_undefined(spark):
    assert spark.range(1).select(metrics.skill(F.lit(0.1), F.lit(0.0)).alias("s")).first()["s"] is None


def test_spearman_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 4.0)], "p double, t double").withColumn("g", F.lit(0))
    assert metrics.spearman(df, ["g"], "t", "p").first()["value"] == pytest.approx(5 / 6)


def test_undefined_correlations_have_reasons(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 1.0, 2.0), (1, 1.0, 3.0), (1, 2.0, 3.0)], "g int, p double, t double")
    for fn in (metrics.pearson, metrics.spearman):
        found = {r["g"]: (r["value"], r["reason"]) for r in fn(df, ["g"], "t", "p").collect()}
        assert found == {0: (None, "constant_prediction"), 1: (None, "constant_target")}
    strict = metrics.undefined_violations(metrics.spearman(df, ["g"], "t", "p"), F.col("g"))
    assert strict.count() == 2


@pytest.mark.parametrize("sign,area,excess", [(1, 0.175, -0.075), (-1, 0.325, 0.075)])
@pytest.mark.parametrize("blocks", [False, True])
def test_risk_coverage(spark, sign, area, excess, blocks):
    df = spark.createDataFrame([(k, r, sign * r) for k, r in zip("abcd", (0.1, 0.2, 0.3, 0.4))], "id string, risk double, signal double").withColumn("g", F.lit(0))
    row = metrics.risk_coverage(df, ["g"], "risk", "signal", "id", blocks=blocks).first()
    assert row["aurc"] == pytest.approx(area) and row["excess_aurc"] == pytest.approx(excess)


def test_interval_score(spark):
    df = spark.createDataFrame([(y, 0.2, 0.8) for y in (0.1, 0.5, 0.9)], "y double, lo double, hi double")
    each = metrics.interval_score(df.withColumn("g", F.col("y")), ["g"], "y", "lo", "hi", 0.1)
    assert sorted(r["interval_score"] for r in each.collect()) == pytest.approx([0.6, 2.6, 2.6])
    row = metrics.interval_score(df.withColumn("g", F.lit(0)), ["g"], "y", "lo", "hi", 0.1).first()
    assert row["coverage"] == pytest.approx(1 / 3) and row["mean_width"] == pytest.approx(0.6)


def test_conformal_rank_and_order_statistic(spark):
    df = spark.createDataFrame([(0, i / 10) for i in range(1, 20)], "g int, residual double")
    found = {r["alpha"]: (r["rank"], r["threshold"]) for r in conformal.residual_thresholds(df, ["g"], "residual", (0.2, 0.1, 0.05, 0.01)).collect()}
    assert found[0.2] == (16, 1.6) and found[0.1] == (18, 1.8) and found[0.05] == (19, 1.9) and found[0.01] == (20, None)
    assert conformal.threshold_violations(conformal.residual_thresholds(df, ["g"], "residual", (0.01,))).count() == 1


def test_interval_ends_are_clipped_separately(spark):
    df = spark.createDataFrame([(1.5,), (-0.5,), (0.5,)], "p double")
    rows = conformal.intervals(df, "p", F.lit(0.2)).collect()
    assert [(r["lower"], r["upper"]) for r in rows] == [(1.0, 1.0), (0.0, 0.0), (0.3, 0.7)]


def test_directional_verdicts(spark):
    df = spark.createDataFrame([(-0.3, -0.1), (-0.1, 0.0), (0.2, 0.1), (None, 0.1)], "lo double, hi double")
    rows = df.select(endpoints.directional_verdict(F.col("lo"), F.col("hi")).alias("v")).collect()
    assert [r["v"] for r in rows] == ["POSITIVE", "UNRESOLVED", "INVALID", "INVALID"]


def test_gate(spark):
    good = spark.createDataFrame([(0.9, 0.8, 0.7)], "a double, b double, c double")
    weak = spark.createDataFrame([(1.0, 1.0, 0.59)], "a double, b double, c double")
    assert endpoints.aggregate_gate(good, ["a", "b", "c"]).first()["passed"]
    assert not endpoints.aggregate_gate(weak, ["a", "b", "c"]).first()["passed"]
