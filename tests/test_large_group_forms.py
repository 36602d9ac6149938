"""The range-partitioned forms give exactly what the one-window forms give, ties and hot values included."""
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import metrics, ranks, resample, support


@pytest.fixture(scope="module")
def values(spark):
    # A third of all rows share one value, and one group holds most rows.
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("g"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") * 7919 % 1013) / 1013.0).alias("v"),
        ((F.col("id") * 104729 % 997) / 997.0).alias("w"), (F.col("id") % 4).alias("m"),
    )
    return df.cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("weight", [None, "m"])
def test_value_ranks(values, weight):
    assert rows(ranks.value_ranks(values, ["g"], "v", weight, blocks=True)) == rows(ranks.value_ranks(values, ["g"], "v", weight, blocks=False))


@pytest.mark.parametrize("weight", [None, "m"])
def test_quantiles(values, weight):
    probs = {"a": 0.025, "b": 0.5, "c": 0.9}
    df = values if weight is None else values.where("m > 0")
    large, small = (ranks.quantiles(df, ["g"], "v", probs, weight, blocks=b).orderBy("g").collect() for b in (True, False))
    for x, y in zip(large, small):
        assert x["g"] == y["g"] and [x[n] for n in probs] == pytest.approx([y[n] for n in probs])


def test_order_statistics(values):
    ks = {"k1": lambda n: F.lit(1), "kn": lambda n: n, "beyond": lambda n: n + 1}
    assert rows(ranks.order_statistics(values, ["g"], "v", ks, blocks=True)) == rows(ranks.order_statistics(values, ["g"], "v", ks, blocks=False))


def test_hash_positions_and_folds(values):
    one = values.select("g", "id")
    assert rows(ranks.hash_positions(one, ["g"], "id", 7, blocks=True).select("g", "id", "position", "size")) == rows(
        ranks.hash_positions(one, ["g"], "id", 7, blocks=False).select("g", "id", "position", "size")
    )
    large, small = (resample.repeated_folds(one, ["g"], "id", [1, 2, 3], 5, blocks=b).select("g", "id", "folds") for b in (True, False))
    assert sorted((r["g"], r["id"], tuple(r["folds"])) for r in large.collect()) == sorted((r["g"], r["id"], tuple(r["folds"])) for r in small.collect())


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_fold_ends_by_selection_equal_folds_by_order(spark, values, limit):
    """Folds by selected boundaries are the folds of the whole hash order, also where buckets have to be cut again, in tiny groups and for a null group."""
    tiny = spark.createDataFrame([("two", "a"), ("two", "b"), ("one", "c"), (None, "d"), (None, "e"), (None, "f")], "g string, id string")
    one = values.select("g", "id").union(tiny).union(spark.range(20000).select(F.lit("large"), F.col("id").cast("string")))
    spark.conf.set("driftgauge.task.rows", str(limit))
    try:
        got = {(r["g"], r["id"]): r["folds"] for r in resample.repeated_folds(one, ["g"], "id", [1, 2, 3], 5).collect()}
    finally:
        spark.conf.unset("driftgauge.task.rows")
    assert len(got) == one.count()
    for i, seed in enumerate([1, 2, 3]):
        placed = ranks.hash_positions(one, ["g"], "id", seed, blocks=False)
        for r in placed.withColumn("fold", resample.fold_of(F.col("position"), F.col("size"), 5)).collect():
            assert got[r["g"], r["id"]][i] == r["fold"]


def test_spearman_and_blocks(values):
    large, small = (metrics.spearman(values.where("m > 0"), ["g"], "v", "w", "m", blocks=b).orderBy("g").collect() for b in (True, False))
    assert [r["value"] for r in large] == pytest.approx([r["value"] for r in small])
    for b in (True, False):
        blocked = ranks.with_order_block(values, ["g"], "v", 10, blocks=b)
        spread = blocked.groupBy("g", "block").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("g", "block").collect()
        for x, y in zip(spread, spread[1:]):
            assert x["g"] != y["g"] or x["hi"] < y["lo"]


def test_the_switch_is_a_measurement(spark, values):
    spark.conf.set("driftgauge.task.rows", "100")
    try:
        assert ranks.needs_blocks(values, ["g"])
        small = ranks.quantiles(values, ["g"], "v", {"a": 0.5}, blocks=False)
        assert rows(ranks.quantiles(values, ["g"], "v", {"a": 0.5})) == rows(small)
    finally:
        spark.conf.unset("driftgauge.task.rows")
    assert not ranks.needs_blocks(values, ["g"])


def test_results_do_not_depend_on_partitioning(values):
    a = resample.bootstrap(values.select("g", "id"), ["g"], "id", resamples=3, seed=1)
    b = resample.bootstrap(values.select("g", "id").repartition(7).sortWithinPartitions(F.desc("id")), ["g"], "id", resamples=3, seed=1)
    assert rows(a.select("g", "id", "replicate", "multiplicity")) == rows(b.select("g", "id", "replicate", "multiplicity"))


def test_bootstrap_draws_exactly_n(values):
    counts = resample.bootstrap(values.select("g", "id"), ["g"], "id", resamples=5, seed=1).groupBy("g", "replicate").agg(F.sum("multiplicity").alias("n"))
    assert {(r["g"], r["n"]) for r in counts.collect()} == {("small", 300), ("big", 2700)}


def test_folds_are_balanced(values):
    sizes = (
        resample.long_folds(resample.repeated_folds(values.select("g", "id").where("id < '29'"), ["g"], "id", [5, 6], 7), ["g"])
        .groupBy("g", "repeat", "fold").count().groupBy("g", "repeat").agg((F.max("count") - F.min("count")).alias("d"), F.count("*").alias("k")).collect()
    )
    assert all(r["d"] <= 1 and r["k"] == 7 for r in sizes)


def test_copy_ordinals_of_a_hot_id(spark):
    """One id in half the rows: its rows are numbered range by range."""
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 11).alias("user"), ((F.col("id") * 7919) % 2003).alias("at"))
    spark.conf.set("driftgauge.task.rows", "100")
    try:
        large = resample.copy_ordinals(df, "user", "at").collect()
    finally:
        spark.conf.unset("driftgauge.task.rows")
    small = resample.copy_ordinals(df, "user", "at").collect()
    key = lambda r: (r["user"] is None, r["user"] or 0, r["at"], r["ordinal"])
    assert sorted(map(key, large)) == sorted(map(key, small)) and len(large) == 2000


def test_poisson_draws_are_hashed_once_and_spread(spark):
    """A few units with many replicates are work for every core, and a draw is one hash."""
    units = spark.range(40).coalesce(1).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("id"))
    drawn = resample.bootstrap(units, ["g"], "id", resamples=50, seed=7, mode="poisson")
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("md5(") == 1
    assert drawn.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert drawn.agg(F.min("multiplicity")).first()[0] == 1


def test_nearest_rows_are_found_in_bounded_memory():
    """Many queries of a small cell gather their candidates in parts, in any number of dimensions, with the same distances."""
    rng = np.random.default_rng(3)
    q, r = rng.random((8000, 64)), rng.random((100, 64))
    tracemalloc.start()
    try:
        found = support._nearest(q, r, 20, cells=400_000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6
    assert found == pytest.approx(np.sort(support._distances(q, r), axis=1)[:, :20], abs=1e-9)
