"""Element-level operators against brute force on small grids."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import elements as el


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(2)
    rows = []
    for case in range(4):
        ref, pred = (rng.integers(0, 3, size=(6, 5, 4)) * (rng.random((6, 5, 4)) < 0.7) for _ in range(2))
        if case == 2:
            ref[:] = 0
        if case == 3:
            ref[:], pred[:] = 0, 0
        for x, y, z in np.ndindex(6, 5, 4):
            rows.append((case, x, y, z, int(ref[x, y, z]), int(pred[x, y, z])))
    return spark.createDataFrame(rows, "case_id int, x int, y int, z int, ref int, pred int").cache()


def points(grid, case, column):
    return {tuple(r) for r in grid.where((F.col("case_id") == case) & (F.col(column) > 0)).select("x", "y", "z").collect()}


def surface_of(mask):
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    return [p for p in mask if any(tuple(a + b for a, b in zip(p, s)) not in mask for s in steps)]


def test_surface(grid):
    found = el.surface(grid.where("case_id = 0 and ref > 0"), "case_id")
    assert {(r["x"], r["y"], r["z"]) for r in found.collect()} == set(surface_of(points(grid, 0, "ref")))


def test_surface_distance_rules_and_values(grid):
    spacing = (1.5, 0.5, 2.0)
    found = {r["case_id"]: r["hd"] for r in el.surface_distance(grid, "case_id", F.col("ref") > 0, F.col("pred") > 0, spacing).collect()}
    assert found[2] == math.inf and math.isnan(found[3])
    for case in (0, 1):
        r, p = (np.array(surface_of(points(grid, case, c))) * spacing for c in ("ref", "pred"))
        d = np.sqrt(((r[:, None] - p[None]) ** 2).sum(axis=2))
        assert found[case] == pytest.approx(np.percentile(np.concatenate([d.min(axis=0), d.min(axis=1)]), 95))


def brute_components(grid, case):
    labels = {(r["x"], r["y"], r["z"]): r["ref"] for r in grid.where(f"case_id = {case} and ref > 0").collect()}
    seen, out = set(), []
    for start in sorted(labels):
        if start in seen:
            continue
        stack, members = [start], set()
        while stack:
            p = stack.pop()
            if p in members:
                continue
            members.add(p)
            for o in np.ndindex(3, 3, 3):
                q = tuple(a + b - 1 for a, b in zip(p, o))
                if labels.get(q) == labels[start]:
                    stack.append(q)
        seen |= members
        out.append((labels[start], frozenset(members)))
    return set(out)


@pytest.mark.parametrize("tile", [64, 2])
def test_components_do_not_depend_on_tiling(grid, tile):
    found = el.connected_components(grid.where("ref > 0 and case_id < 2"), "case_id", "ref", tile=tile).collect()
    for case in (0, 1):
        groups = {}
        for r in found:
            if r["case_id"] == case:
                groups.setdefault((r["label"], r["component"]), set()).add((r["x"], r["y"], r["z"]))
        assert {(label, frozenset(m)) for (label, _), m in groups.items()} == brute_components(grid, case)


def test_long_component_over_many_tiles(spark):
    snake = [(0, i, (i // 3) % 2 * 0 + abs((i % 8) - 4), 0, 1) for i in range(40)]
    df = spark.createDataFrame(snake, "case_id int, x int, y int, z int, ref int")
    assert el.connected_components(df, "case_id", "ref", tile=3).select("component").distinct().count() == 1


def test_component_features_of_absent_labels(grid):
    cases = grid.select("case_id").distinct()
    out = el.component_features(el.connected_components(grid.where("ref > 0"), "case_id", "ref"), cases, "case_id", (1, 2))
    assert {(r["components"], r["largest_fraction"]) for r in out.where("case_id = 3").collect()} == {(0, 0.0)}


def test_dice_rules(grid):
    by_case = {r["case_id"]: r["dice"] for r in el.dice_binary(grid, "case_id", F.col("ref") > 0, F.col("pred") > 0).collect()}
    a, b = points(grid, 0, "ref"), points(grid, 0, "pred")
    assert by_case[0] == pytest.approx(2 * len(a & b) / (len(a) + len(b))) and by_case[2] == 0.0 and by_case[3] == 1.0
    strict = el.dice_per_label(grid, "case_id", "ref", "pred", (1, 2), strict=True)
    assert strict.where("dice is null").count() == 4 and el.empty_truth_violations(strict, "case_id").count() == 4


def test_grid_mismatch(grid):
    assert el.grid_violations(grid, grid, "case_id").count() == 0
    row = el.grid_violations(grid, grid.where("not (case_id = 1 and x = 0)"), "case_id").first()
    assert (row["case_id"], row["only_reference"], row["only_prediction"]) == (1, 20, 0)


def test_entropy_and_argmax(spark):
    rows = [(0, [0.25] * 4), (1, [1.0, 0.0, 0.0, 0.0]), (2, [0.1, 0.4, 0.4, 0.1])]
    df = spark.createDataFrame(rows, "case_id int, p array<double>")
    found = {r["case_id"]: r for r in el.probability_features(df, "case_id", "p").collect()}
    assert found[0]["entropy_mean"] == pytest.approx(math.log(4)) and found[1]["entropy_mean"] == 0.0
    assert [r["label"] for r in el.with_argmax(df, "p").orderBy("case_id").collect()] == [0, 0, 1]


def test_feature_row_order(grid, spark):
    p = grid.withColumn("p", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)))
    out = el.case_features(p, "case_id", "p", "pred", (0, 1, 2))
    assert out.columns == ["case_id", *el.feature_names((0, 1, 2))]
    assert len(el.feature_names((0, 1, 2, 3))) == 15 and len(el.feature_names((0, 1, 2, 3, 4))) == 18


def test_feature_rows_read_the_elements_once(spark):
    """Features of a case have many parts, but make each element only once."""
    grid = spark.createDataFrame([(c, x, y, 0, x % 3) for c in range(4) for x in range(5) for y in range(5)], "case_id int, x int, y int, z int, pred int")
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    grid = grid.mapInPandas(counted, grid.schema)
    p = F.when(F.col("pred") == 0, F.array(F.lit(0.8), F.lit(0.2))).otherwise(F.array(F.lit(0.3), F.lit(0.7)))
    out = el.case_features(grid.withColumn("p", p), "case_id", "p", "pred", (0, 1, 2), support=F.col("x") > 0)
    assert len(out.collect()) == 4 and made.value == 100
