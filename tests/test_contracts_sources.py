"""Every contract has an input that breaks it; readers and sinks round-trip."""
import hashlib

import pytest
from pyspark.sql import functions as F

from driftgauge.session import compute_tasks
from driftgauge.functions import normalized_label, set_digest
from driftgauge.operators import audit, contracts, provenance, resample, summaries
from driftgauge.session import scratch_path
from driftgauge.sources import files, sinks, tables


def checks(df):
    return sorted((r["check"], r["key"], r["detail"]) for r in df.collect())


def test_schema_contract(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert contracts.schema_violations(df, ["a", "b"]).count() == 0
    assert checks(contracts.schema_violations(df, ["b", "a"])) == [("schema", "a,b", "reordered")]
    assert checks(contracts.schema_violations(df, ["a", "c"])) == [("schema", "b", "unexpected"), ("schema", "c", "missing")]


def test_leakage_contract(spark):
    df = spark.createDataFrame([(1, 2, 3)], "entropy_mean int, Dice_Macro int, predicted int")
    assert checks(contracts.leakage_violations(df, ["PREDICTED"], ["dice"])) == [
        ("leakage", "Dice_Macro", "forbidden token"), ("leakage", "predicted", "forbidden name")
    ]


def test_value_and_key_contracts(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", float("nan")), ("", 2.0), (None, float("inf"))], "id string, v double")
    found = checks(contracts.contract_violations(df, keys=["id"], finite=["v"], unit_interval=["v"]))
    assert found == [("empty_key", "id", "2"), ("finite", "v", "2"), ("range", "v", "1"), ("unique_key", "a", "2")]
    with pytest.raises(contracts.ContractError, match="unique_key"):
        contracts.assert_clean(contracts.key_violations(df, ["id"]))


def test_population_contract(spark):
    df = spark.createDataFrame([("ID", "a"), ("ID", "a")], "p string, id string")
    assert checks(contracts.population_violations(df, "p", "id", "OOD", 3)) == [
        ("population", "ID", "duplicated ids"), ("population", "ID", "wrong count"), ("population", "ID", "wrong population")
    ]
    assert checks(contracts.population_violations(df.limit(0), "p", "id", "ID"))[0][2] == "empty"


def test_labels_keep_the_closed_tolerance(spark):
    df = spark.createDataFrame([(1.0 + 1e-5,), (1.00002,), (2.5,), (float("nan"),), (-0.000001,)], "v double")
    assert [r[0] for r in df.select(normalized_label("v", 1.1e-5)).collect()] == [1, None, None, None, 0]


def test_completeness(spark):
    rows = [("a", "ED", "x"), ("a", "ES", "x"), ("b", "ED", "x"), ("c", "ED", "x"), ("c", "ES", "y"), ("d", "ED", "x"), ("d", "ED", "x"), ("d", "ES", "x")]
    df = spark.createDataFrame(rows, "u string, p string, s string")
    found = {r["u"]: r["complete"] for r in audit.group_completeness(df, "u", "p", ["ED", "ES"], "s").collect()}
    assert found == {"a": True, "b": False, "c": False, "d": False}


def test_digests_ignore_order_and_see_every_change(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("v"))
    digest = lambda d: d.agg(set_digest("v").alias("d")).first()["d"]
    assert digest(df) == digest(df.repartition(7).orderBy(F.desc("v")))
    assert digest(df) != digest(df.where("v <> '3'")) and digest(df) != digest(df.union(df.where("v = '3'")))
    two = spark.createDataFrame([("a", "bc")], "x string, y string"), spark.createDataFrame([("ab", "c")], "x string, y string")
    assert audit.content_hash(two[0]).first()["digest"] != audit.content_hash(two[1]).first()["digest"]


def test_array_fingerprint_depends_on_shape(spark):
    flat = spark.createDataFrame([(0, 0, i, 1.0) for i in range(4)], "c int, x int, y int, v double")
    square = spark.createDataFrame([(0, i // 2, i % 2, 1.0) for i in range(4)], "c int, x int, y int, v double")
    prints = [provenance.array_fingerprints(d, "c", ["x", "y"], "v").first()["fingerprint"] for d in (flat, square, flat.withColumn("v", F.col("v").cast("int")))]
    assert prints[0] == prints[2] != prints[1]


def test_collisions_on_either_side_are_ambiguous(spark):
    schema = "id string, c string, r string"
    left = spark.createDataFrame([("l1", "h1", "x"), ("l2", "h2", "x"), ("l3", "h3", "x"), ("l4", "h3", "x"), ("l5", "h5", "x"), ("l6", "h6", None)], schema)
    right = spark.createDataFrame([("r1", "h1", "x"), ("r2", "h2", "y"), ("r3", "h3", "x"), ("r5", "h5", "x"), ("r6", "h5", "x"), ("r7", "h6", None)], schema)
    found = {r["id"]: (r["status"], r["matched_id"]) for r in provenance.one_to_one_matches(left, right, "id", "c", "r").collect()}
    assert found == {
        "l1": ("EXACT", "r1"), "l2": ("EQUIVALENT", "r2"), "l3": ("AMBIGUOUS", None), "l4": ("AMBIGUOUS", None), "l5": ("AMBIGUOUS", None), "l6": ("EQUIVALENT", "r7"),
    }


def test_apportionment(spark):
    strata = spark.createDataFrame([("a", 12), ("b", 8)], "s string, n bigint")
    found = {(r["s"], r["role"]): r["quota"] for r in resample.apportion(strata, "s", {"SEG": 8, "TRAIN": 4, "CAL": 4, "EVAL": 4}).collect()}
    assert sum(v for (s, _), v in found.items() if s == "a") == 12
    for role, size in {"SEG": 8, "TRAIN": 4, "CAL": 4, "EVAL": 4}.items():
        assert found["a", role] + found["b", role] == size
    assert found["a", "SEG"] == 5 and found["b", "SEG"] == 3


def test_quota_contract(spark):
    units = spark.createDataFrame([("a", str(i)) for i in range(5)], "s string, id string")
    quotas = spark.createDataFrame([("a", "x", 0, 2), ("a", "y", 1, 2)], "s string, role string, role_order int, quota bigint")
    assert resample.quota_violations(units, "s", quotas).count() == 1


def test_overlaps_and_reconcile(spark):
    df = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u1", "c"), ("u2", "a")], "u string, s string")
    assert {(r["split_a"], r["split_b"], r["n_shared"]) for r in audit.overlap_matrix(df, "u", "s", ["a", "b", "c", "d"]).where("n_shared > 0").collect()} == {
        ("a", "b", 1), ("a", "c", 1), ("b", "c", 1)
    }
    row = audit.same_table(df, df.union(df.limit(1))).first()
    assert (row["n_missing"], row["n_extra"], row["identical"]) == (0, 1, False)
    assert not audit.same_table(df, df.withColumn("u", F.lit(1))).first()["same_schema"]


def test_csv_round_trip_and_integer_contract(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("a", "1", ['x"', "y,z"]), ("b", "2.5", []), ("c", None, ["q"])], "id string, n string, tags array<string>").transform(lambda d: sinks.write_csv(d, path) or d)
    typed, problems = tables.scan_csv(spark, path, ["id", "n"], rename={"id": "unit_id"}, integers=["n"])
    assert {(r["unit_id"], r["n"]) for r in typed.collect()} == {("a", 1), ("b", None), ("c", None)} and problems.count() == 2
    back = spark.read.option("header", True).option("escape", '"').csv(path).where("id = 'a'").first()
    assert back["tags"] == '["x\\"","y,z"]'
    with pytest.raises(contracts.ContractError):
        tables.scan_csv(spark, path, ["missing"])


def test_ledger_contract_and_lookup(spark):
    schema = tables.LEDGER_SCHEMA
    rows = [("k1", "d", "e", "q", 1.0, "1", "F"), ("k2", "d", "e", "q2", float("nan"), "x", "F"), ("k3", "d", "e", "q3", 2.0, "", "F"), ("k1", "d", "e", "q", 1.0, "1", "F")]
    path = scratch_path(spark, "ledger")
    spark.createDataFrame(rows, schema).write.json(path)
    ledger = tables.scan_ledger(spark, path)
    assert {c for c, _, _ in checks(tables.ledger_contract(ledger))} == {"content", "unique_key"}
    assert checks(tables.ledger_contract(ledger.limit(0))) == [("ledger", "rows", "empty")]
    keys = spark.createDataFrame([("k1",), ("k3",), ("k9",)], "result_id string")
    assert checks(summaries.ledger_violations(ledger, keys)) == [("content", "k3", "display"), ("missing", "k9", "no row")]


def test_write_once_and_file_digests(spark):
    path = scratch_path(spark, "once")
    df = spark.range(20).toDF("v").coalesce(1)
    assert sinks.write_once(df, path) == "written" and sinks.write_once(df, path, verify=True) == "identical"
    with pytest.raises(contracts.ContractError):
        sinks.write_once(df, path)
    with pytest.raises(contracts.ContractError):
        sinks.write_once(df.where("v < 3"), path, verify=True)
    seen = files.digests(spark, path, "*.parquet")
    assert seen.count() == 1 and files.reconcile(seen, seen).count() == 0
    changed = seen.withColumn("digest", F.lit("0"))
    assert files.reconcile(seen, changed).first()["status"] == "digest"
    assert files.tree_digest(seen).first()["digest"] != files.tree_digest(changed).first()["digest"]


def test_hash_positions_cover_every_place(spark):
    placed = resample.place_units(spark.range(50).selectExpr("cast(id as string) id", "id % 3 g"), ["g"], "id", 1)
    assert sorted(r["__slot"] for r in placed.collect()) == list(range(50))


def test_integer_totals(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.5)], "g string, v double")
    assert {(r["g"], r["total"], r["n_bad"]) for r in summaries.integer_total(df, ["g"], "v").collect()} == {("a", 3, 0), ("b", None, 1)}


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.txt").write_text(f"line {i}")
    few = files.digests(spark, str(tmp_path), "*.txt", tasks=2)
    # small and large files are read apart
    assert few.rdd.getNumPartitions() <= 2 + compute_tasks(spark)
    assert sorted(few.collect()) == sorted(files.digests(spark, str(tmp_path), "*.txt").collect()) and few.count() == 200


def test_keys_are_reconciled_without_a_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (None, None)], "k bigint, t string")
    right = spark.createDataFrame([(2, "b"), (2, "b"), (3, None), (4, "d")], "k bigint, t string")
    found = audit.key_reconcile(left, right, ["k", "t"])
    want = [(1, "a", "missing"), (3, None, "missing"), (None, None, "missing"), (3, None, "unexpected"), (4, "d", "unexpected")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("algorithm", ["sha256", "md5"])
def test_files_beyond_a_few_megabytes_are_streamed(spark, tmp_path, algorithm):
    """No row holds a file of 20 MB, whether it is found by its path or under a mount point."""
    (tmp_path / "a b.gz").write_bytes(b"0123456789abcdef" * (20 << 16))
    (tmp_path / "small.gz").write_bytes(b"few")
    want = {(p.name, p.stat().st_size, hashlib.new(algorithm, p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(18 << 20))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.held.link./in", tmp_path.parent.as_uri())
    try:
        for root in (str(tmp_path), f"file://{tmp_path}", f"viewfs://held/in/{tmp_path.name}"):
            assert {tuple(r) for r in files.digests(spark, root, "*.gz", algorithm).collect()} == want
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
