"""Rows and answers that must not get lost: repairs with the cases that showed them."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import elements, endpoints, provenance, recalibrate, resample
from driftgauge.operators.contracts import ContractError
from driftgauge.sources import files, tables


def test_integers_beyond_doubles(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n\n9007199254740993\n3.0\n1e3\n1.5\n9007199254740993.0\nx\n\n-7\n")
    table, problems = tables.scan_csv(spark, str(tmp_path / "a.csv"), ["n"], integers=["n"])
    assert sorted(r.n for r in table.collect() if r.n is not None) == [-7, 3, 1000, 9007199254740993]
    assert {"1.5", "9007199254740993.0", "x"} <= {r.detail for r in problems.collect()}


@pytest.mark.parametrize("algorithm", ["sha256", "md5"])
def test_digests_of_any_size(spark, tmp_path, monkeypatch, algorithm):
    (tmp_path / "small").write_bytes(b"abc")
    big = tmp_path / "sub dir"
    big.mkdir()
    (big / "large").write_bytes(b"x" * 50_000 + b"y")
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 1000)
    got = {r.path: r.digest for r in files.digests(spark, str(tmp_path), algorithm=algorithm).collect()}
    assert got == {"small": hashlib.new(algorithm, b"abc").hexdigest(), "sub dir/large": hashlib.new(algorithm, b"x" * 50_000 + b"y").hexdigest()}
    before = files.tree_digest(files.digests(spark, str(tmp_path))).first().digest
    (big / "large").write_bytes(b"x" * 50_000 + b"z")
    assert files.tree_digest(files.digests(spark, str(tmp_path))).first().digest != before


def test_components_far_from_the_origin(spark):
    points = [("c", 0, 1 << 20), ("c", 1, 0), ("c", -5, -5), ("c", -4, -6), ("c", -65, 3), ("c", -64, 4), ("c", 5_000_000, 5_000_000)]
    df = spark.createDataFrame([(*p, 1) for p in points], "case string, x int, y int, label int")
    got = {(r.x, r.y): r.component for r in elements.connected_components(df, "case", "label", ("x", "y")).collect()}
    assert len(set(got.values())) == 5
    assert got[-5, -5] == got[-4, -6] and got[-65, 3] == got[-64, 4]
    wide = spark.createDataFrame([("c", -(2**31), -(2**31), -(2**31), 1), ("c", 2**31 - 1, 2**31 - 1, 2**31 - 1, 1)], "case string, x int, y int, z int, label int")
    with pytest.raises(ContractError):
        elements.connected_components(wide, "case", "label")


def test_one_coordinate_distance(spark):
    rows = [("c", i, 2 <= i <= 6, 3 <= i <= 9) for i in range(12)]
    df = spark.createDataFrame(rows, "case string, x int, ref boolean, pred boolean")
    got = elements.surface_distance(df, "case", F.col("ref"), F.col("pred"), [1.0], percentile=100.0, coords=("x",)).first()
    assert got.hd == 3.0


def test_case_without_support_stays(spark):
    rows = [(c, i, 0, [0.2, 0.8] if i % 2 else [0.9, 0.1], i % 2, c == "a") for c in "ab" for i in range(6)]
    df = spark.createDataFrame(rows, "case string, x int, y int, p array<double>, label int, inside boolean")
    got = {r.case: r for r in elements.case_features(df, "case", "p", "label", [0, 1], support=F.col("inside"), coords=("x", "y")).collect()}
    assert set(got) == {"a", "b"} and got["a"].entropy_mean is not None and got["b"].entropy_mean is None and got["b"].components_1 == 3.0


def test_records_without_a_hash_match_nothing(spark):
    side = lambda rows: spark.createDataFrame(rows, "id string, canonical string, raw string")
    got = {r.id: r.status for r in provenance.one_to_one_matches(side([("a", "h", "r"), ("b", None, "r")]), side([("x", "h", "r"), ("y", None, "r")]), "id", "canonical", "raw").collect()}
    assert got == {"a": "EXACT", "b": "NO_MATCH"}
    other = spark.createDataFrame([("a", "DOCUMENTED")], "id string, status string")
    assert provenance.authoritative(other, ("EXACT", "DOCUMENTED")).count() == 1 and provenance.authoritative(other).count() == 0


def test_quotas_must_fit(spark):
    units = spark.createDataFrame([("s", i) for i in range(8)] + [("t", i) for i in range(3)], "stratum string, id int")
    with pytest.raises(ContractError):
        resample.quota_split(units, "stratum", "id", spark.createDataFrame([("s", "TRAIN", 0, 6)], "stratum string, role string, role_order int, quota bigint"), 1)
    full = spark.createDataFrame([("s", "A", 0, 5), ("s", "B", 1, 3), ("t", "A", 0, 3)], "stratum string, role string, role_order int, quota bigint")
    assert resample.quota_split(units, "stratum", "id", full, 1).count() == 11


def test_slope_of_large_values_with_a_small_spread(spark):
    rng = np.random.default_rng(1)
    x = 1e6 + rng.uniform(0, 0.05, 200)
    rows = [("s", float(v), float(2 * v + 1), 1, [i % 5]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "key string, x double, y double, multiplicity bigint, folds array<int>")
    assert all(abs(r.slope - 2) < 1e-3 for r in recalibrate.ols_coefficients(df, ["key"], "x", "y").collect())
    flat = df.withColumn("x", F.lit(0.3))
    for r in recalibrate.ols_coefficients(flat, ["key"], "x", "y").collect():
        assert abs(r.slope / r.intercept - 0.3) < 1e-9


def units(spark, rows):
    return spark.createDataFrame(rows, "domain string, unit_id string, q_true double, q_hat double")


def spread(n):
    return [(d, f"{d}{i}", 0.1 + 0.8 * i / n + (0.01 if d == "O" else 0), 0.2 + 0.6 * i / n) for d in "IO" for i in range(n)]


def test_endpoint_contract(spark):
    run = lambda rows, **k: endpoints.shift_endpoint(units(spark, rows), "domain", "unit_id", "q_true", "q_hat", "I", "O", seeds=[1], resamples=3, **k)
    for bad in (spread(20) + [("I", "I3", 0.5, 0.5)], spread(20) + [("I", "new", float("nan"), 0.5)], spread(20) + [("O", "new", 0.5, None)]):
        with pytest.raises(ContractError):
            run(bad)
    assert run(spread(20)).first().verdict in ("POSITIVE", "UNRESOLVED")


def test_units_without_a_fit_make_the_skill_undefined(spark):
    few = [r for r in spread(3)]
    out = endpoints.shift_endpoint(units(spark, few), "domain", "unit_id", "q_true", "q_hat", "I", "O", recalibrator="affine_OLS", seeds=[1], k=2, resamples=0).first()
    deployed = endpoints.shift_endpoint(units(spark, few), "domain", "unit_id", "q_true", "q_hat", "I", "O", seeds=[1], k=2, resamples=4).first()
    assert out.s_id is None and out.n_undefined > 0
    assert deployed.n_undefined == 0 or deployed.verdict == "INVALID"
