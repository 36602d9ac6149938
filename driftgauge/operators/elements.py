"""Element-level (voxel, pixel, token) aggregates on a long table ``case, coordinates, labels, probabilities``."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.functions import argmax_index, entropy, hash60
from driftgauge.functions.arrays import probability_violation
from driftgauge.operators.contracts import ContractError, violation
from driftgauge.operators.ranks import needs_blocks, quantiles
from driftgauge.session import compute_tasks, cut_lineage

COORDS = ("x", "y", "z")
# Edge length of the tiles that are labelled inside one task: at most 64 ** 3 elements.
TILE = 64
BUCKET_ROWS = 500_000


def grid_violations(reference: DataFrame, prediction: DataFrame, case: str, coords: Sequence[str] = COORDS) -> DataFrame:
    """Per case: elements present in one table only; identical grids give no rows."""
    keys = [case, *coords]
    sides = (
        reference.select(*keys, F.lit(1).alias("r"), F.lit(0).alias("p"))
        .unionByName(prediction.select(*keys, F.lit(0).alias("r"), F.lit(1).alias("p")))
        .groupBy(*keys)
        .agg(F.sum("r").alias("r"), F.sum("p").alias("p"))
    )
    odd = sides.groupBy(case).agg(
        F.count_if((F.col("r") > 0) & (F.col("p") == 0)).alias("only_reference"),
        F.count_if((F.col("r") == 0) & (F.col("p") > 0)).alias("only_prediction"),
        F.count_if((F.col("r") > 1) | (F.col("p") > 1)).alias("repeated"),
    )
    return odd.where("only_reference > 0 or only_prediction > 0 or repeated > 0")


# --- overlap ------------------------------------------------------------------------

def _dice(both: Column, ref: Column, pred: Column) -> Column:
    """Both empty gives one, one empty gives zero."""
    total = ref + pred
    return F.when(total == 0, F.lit(1.0)).otherwise(F.try_divide(2.0 * both, total))


def dice_binary(elements: DataFrame, case: str, ref: Column, pred: Column) -> DataFrame:
    counts = elements.groupBy(case).agg(
        F.count_if(ref & pred).alias("n_both"), F.count_if(ref).alias("n_ref"), F.count_if(pred).alias("n_pred")
    )
    return counts.withColumn("dice", _dice(F.col("n_both"), F.col("n_ref"), F.col("n_pred")))


def confusion(elements: DataFrame, case: str, ref: str, pred: str) -> DataFrame:
    """Element counts per case and label pair; every overlap measure follows from it."""
    return elements.groupBy(case, ref, pred).agg(F.count(F.lit(1)).alias("n"))


def dice_per_label(elements: DataFrame, case: str, ref: str, pred: str, labels: Sequence[int], *, strict: bool = False) -> DataFrame:
    """One-versus-rest Dice of every label, also of labels a case does not contain.

    ``strict`` makes an empty truth a null (see :func:`empty_truth_violations`) instead of applying the empty rule.
    """
    entries, sums = [], []
    for i, label in enumerate(labels):
        r, p = F.col(ref) == label, F.col(pred) == label
        sums += [
            F.sum(F.when(r & p, F.col("n")).otherwise(0)).alias(f"b{i}"),
            F.sum(F.when(r, F.col("n")).otherwise(0)).alias(f"r{i}"),
            F.sum(F.when(p, F.col("n")).otherwise(0)).alias(f"p{i}"),
        ]
        entries.append(
            F.struct(F.lit(int(label)).alias("label"), F.col(f"b{i}").alias("n_both"), F.col(f"r{i}").alias("n_ref"), F.col(f"p{i}").alias("n_pred"))
        )
    wide = confusion(elements, case, ref, pred).groupBy(case).agg(*sums)
    long = wide.select(case, F.explode(F.array(*entries)).alias("e")).select(case, "e.*")
    value = _dice(F.col("n_both"), F.col("n_ref"), F.col("n_pred"))
    return long.withColumn("dice", F.when(F.col("n_ref") > 0, value) if strict else value)


def macro_dice(per_label: DataFrame, case: str) -> DataFrame:
    return per_label.groupBy(case).agg(F.avg("dice").alias("dice_macro"))


def empty_truth_violations(per_label: DataFrame, case: str) -> DataFrame:
    return per_label.where("n_ref = 0").select(
        *violation("empty_truth", F.col(case), F.concat(F.lit("label "), F.col("label")))
    )


# --- surfaces -------------------------------------------------------------------------

def surface(mask: DataFrame, case: str, coords: Sequence[str] = COORDS) -> DataFrame:
    """Elements of a mask with at least one face neighbour outside it (outside the grid counts as outside).

    Neighbours along an axis are the previous and next row of a line of the grid, so
    one window per axis over short lines decides it.
    """
    coords = list(coords)
    out, inner = mask.select(case, *coords), F.lit(True)
    for i, axis in enumerate(coords):
        line = W.partitionBy(case, *[c for c in coords if c != axis]).orderBy(axis)
        both = (F.lag(axis).over(line) == F.col(axis) - 1) & (F.lead(axis).over(line) == F.col(axis) + 1)
        out = out.withColumn(f"__i{i}", F.coalesce(both, F.lit(False)))
        inner = inner & F.col(f"__i{i}")
    return out.where(~inner).select(case, *coords)


def nearest_squared(points: DataFrame, targets: DataFrame, case: str, coords: Sequence[str], spacing: Sequence[float]) -> DataFrame:
    """``points`` with ``d2``, the exact squared distance to the nearest target of the same case.

    The distance separates by axis: for each line of the grid the minimum over the
    line is taken, one axis after the other. Rows stay proportional to the bounding
    grid of a case, no pairs of points are formed, and a line is never longer than
    the grid's extent.
    """
    coords = list(coords)
    weights = {c: float(s) ** 2 for c, s in zip(coords, spacing)}
    extent = points.groupBy(case).agg(
        F.count(F.lit(1)).alias("__points"), *[F.min(c).cast("int").alias(f"__lo_{c}") for c in coords[1:]], *[F.max(c).cast("int").alias(f"__hi_{c}") for c in coords[1:]]
    )
    field = targets.select(case, *[F.col(c).cast("int").alias(c) for c in coords], F.lit(0.0).alias("g"))

    def line_minimum(axis: str, at: Column) -> Column:
        return F.array_min(
            F.transform("line", lambda e: e["g"] + F.lit(weights[axis]) * ((e["a"] - at) * (e["a"] - at)).cast("double"))
        )

    for axis in reversed(coords[1:]):
        rest = [c for c in coords if c != axis]
        lines = field.groupBy(case, *rest).agg(F.collect_list(F.struct(F.col(axis).alias("a"), "g")).alias("line"))
        spread = lines.join(extent.select(case, f"__lo_{axis}", f"__hi_{axis}"), case).withColumn(
            axis, F.explode(F.sequence(F.col(f"__lo_{axis}"), F.col(f"__hi_{axis}")))
        )
        field = spread.select(case, *coords, line_minimum(axis, F.col(axis)).alias("g"))
    first, rest = coords[0], coords[1:]
    lines = field.groupBy(case, *rest).agg(F.collect_list(F.struct(F.col(first).alias("a"), "g")).alias("line"))
    wanted = points.select(case, *[F.col(c).cast("int").alias(c) for c in coords])
    return wanted.join(lines, [case, *rest]).select(case, *coords, line_minimum(first, F.col(first)).alias("d2"))


def surface_distance(
    elements: DataFrame, case: str, ref: Column, pred: Column, spacing: Sequence[float], *, percentile: float = 95.0, coords: Sequence[str] = COORDS
) -> DataFrame:
    """``(case, hd)``: percentile of the pooled two-way nearest surface distances in physical units.

    Both masks empty gives NaN, exactly one empty gives +Inf.
    """
    coords = list(coords)
    r = surface(elements.where(ref), case, coords)
    p = surface(elements.where(pred), case, coords)
    pooled = nearest_squared(p, r, case, coords, spacing).unionByName(nearest_squared(r, p, case, coords, spacing))
    pooled = pooled.select(case, F.sqrt("d2").alias("d"))
    found = quantiles(pooled, [case], "d", {"hd": percentile / 100.0})
    present = elements.groupBy(case).agg(F.max(ref).alias("has_ref"), F.max(pred).alias("has_pred"))
    return present.join(found, case, "left").select(
        case,
        F.when(F.col("has_ref") & F.col("has_pred"), F.col("hd"))
        .when(F.col("has_ref") | F.col("has_pred"), F.lit(float("inf")))
        .otherwise(F.lit(float("nan")))
        .alias("hd"),
    )


def case_metrics(elements: DataFrame, case: str, ref: str, pred: str, labels: Sequence[int], spacing: Sequence[float], coords: Sequence[str] = COORDS) -> DataFrame:
    """Per case: Dice of each foreground label, macro Dice, merged-foreground Dice and its HD95."""
    foreground = [label for label in labels if label != 0]
    per_label = dice_per_label(elements, case, ref, pred, foreground)
    wide = per_label.groupBy(case).agg(
        *[F.max(F.when(F.col("label") == label, F.col("dice"))).alias(f"dice_{label}") for label in foreground],
        F.avg("dice").alias("dice_macro"),
    )
    in_ref, in_pred = F.col(ref).isin(foreground), F.col(pred).isin(foreground)
    whole = dice_binary(elements, case, in_ref, in_pred).select(case, F.col("dice").alias("dice_whole"))
    distance = surface_distance(elements, case, in_ref, in_pred, spacing, coords=coords).select(case, F.col("hd").alias("hd95"))
    return wide.join(whole, case).join(distance, case)


# --- support, probabilities, labels -------------------------------------------------------

def in_support(intensity: str) -> Column:
    """Finite and not zero."""
    c = F.col(intensity)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (c != 0)


def support_counts(elements: DataFrame, case: str, intensity: str) -> DataFrame:
    """Supported elements per case; zero is a violation for the caller to report."""
    return elements.groupBy(case).agg(F.count_if(in_support(intensity)).alias("n_support"), F.count(F.lit(1)).alias("n_elements"))


def probability_violations(elements: DataFrame, case: str, probabilities: str, classes: int, atol: float = 1e-5, rtol: float = 1e-5) -> DataFrame:
    """Invalid probability vectors per case and rule."""
    rule = probability_violation(probabilities, classes, atol, rtol)
    return elements.select(case, rule.alias("rule")).where("rule is not null").groupBy(case, "rule").agg(F.count(F.lit(1)).alias("n"))


def label_violations(elements: DataFrame, case: str, label: str, allowed: Sequence[int]) -> DataFrame:
    bad = elements.where(F.col(label).isNull() | ~F.col(label).isin(list(allowed)))
    return bad.groupBy(case, label).agg(F.count(F.lit(1)).alias("n"))


def probability_features(elements: DataFrame, case: str, probabilities: str, support: Column | None = None) -> DataFrame:
    """Entropy mean / p90 / p95 and confidence mean / p10 per case, inside the support if one is given."""
    inside = elements if support is None else elements.where(support)
    values = inside.select(case, entropy(probabilities).alias("e"), F.array_max(probabilities).alias("c"))
    if not needs_blocks(values, [case]):
        found = values.groupBy(case).agg(
            F.avg("e").alias("entropy_mean"), F.percentile("e", F.array(F.lit(0.9), F.lit(0.95))).alias("q"),
            F.avg("c").alias("confidence_mean"), F.percentile("c", F.lit(0.1)).alias("confidence_p10"),
        )
        return found.select(
            case, "entropy_mean", F.col("q")[0].alias("entropy_p90"), F.col("q")[1].alias("entropy_p95"), "confidence_mean", "confidence_p10"
        )
    means = values.groupBy(case).agg(F.avg("e").alias("entropy_mean"), F.avg("c").alias("confidence_mean"))
    e = quantiles(values, [case], "e", {"entropy_p90": 0.9, "entropy_p95": 0.95}, blocks=True)
    c = quantiles(values, [case], "c", {"confidence_p10": 0.1}, blocks=True)
    return means.join(e, case).join(c, case)


def label_fractions(elements: DataFrame, case: str, label: str, labels: Sequence[int], support: Column | None = None) -> DataFrame:
    """Foreground fraction and the fraction of each label, over the support or over all elements."""
    inside = F.lit(True) if support is None else support
    n = F.count_if(inside)
    fraction = lambda condition: F.try_divide(F.count_if(inside & condition).cast("double"), n)
    foreground = [v for v in labels if v != 0]
    return elements.groupBy(case).agg(
        fraction(F.col(label).isin(foreground)).alias("foreground_fraction"),
        *[fraction(F.col(label) == v).alias(f"class_fraction_{v}") for v in foreground],
    )


# --- connected components ---------------------------------------------------------------

def _measured_strides(elements: DataFrame, coords: Sequence[str]) -> tuple[list[int], list[int]]:
    """Offsets and strides that pack the table's coordinates in one BIGINT, in coordinate order.

    20 bits each where all coordinates are in that range, else by the measured extents.
    """
    bounds = elements.agg(*[f(c) for c in coords for f in (F.min, F.max)]).first()
    low = [int(bounds[2 * i] or 0) for i in range(len(coords))]
    extent = [int(bounds[2 * i + 1] or 0) - low[i] + 1 for i in range(len(coords))]
    if len(coords) <= 3 and all(a >= 0 and a + n <= 1 << 20 for a, n in zip(low, extent)):
        return [0] * len(coords), [1 << 20 * i for i in reversed(range(len(coords)))]
    if math.prod(extent) > 1 << 63:
        raise ContractError(f"the grid of {extent} has more cells than a BIGINT can number")
    return low, [math.prod(extent[i + 1 :]) for i in range(len(coords))]


def _offsets(dims: int) -> list[tuple[int, ...]]:
    """One of each opposite pair of the full neighbourhood (diagonals included)."""
    every = np.stack(np.meshgrid(*[(-1, 0, 1)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    return [tuple(int(v) for v in o) for o in every if tuple(o) > (0,) * dims]


def label_tiles(group: np.ndarray, points: np.ndarray, labels: np.ndarray, tile: int) -> np.ndarray:
    """For every element, the index of the first element (in coordinate order) of its component inside its group.

    Groups are tiles. Padded local coordinates and the group number form one key, so a
    neighbour is a key at a fixed distance and is found by binary search, for all
    tiles at once. Minimum labels spread along all neighbour directions; pointer
    jumping shortens the chains, so few rounds are needed.
    """
    base = tile + 2
    key = group.astype(np.int64)
    for axis in range(points.shape[1]):
        key = key * base + (points[:, axis] % tile + 1)
    order = np.argsort(key, kind="stable")
    key, by_rank = key[order], labels[order]
    left, right = [], []
    for offset in _offsets(points.shape[1]):
        jump = 0
        for step in offset:
            jump = jump * base + step
        at = np.searchsorted(key, key + jump)
        at[at == len(key)] = 0
        hit = np.flatnonzero((key[at] == key + jump) & (by_rank[at] == by_rank))
        left.append(hit)
        right.append(at[hit])
    left, right = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(key))
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if np.array_equal(root, before):
            out = np.empty(len(key), dtype=np.int64)
            out[order] = order[root]
            return out


def connected_components(elements: DataFrame, case: str, label: str, coords: Sequence[str] = COORDS, *, tile: int = TILE) -> DataFrame:
    """``(case, label, coords…, component)``: components of equal labels, diagonals connect.

    Tiles of bounded size are labelled in parallel; only elements on tile faces then
    form edges between the tiles' components, and those edges are contracted. The
    component number is the smallest packed coordinate in it, whatever the tiling.
    """
    coords = list(coords)
    tiles = [f"__t_{c}" for c in coords]
    placed = elements.select(case, F.col(label).alias("label"), *[F.col(c).cast("int").alias(c) for c in coords]).withColumns(
        {t: F.floor(F.col(c) / tile).cast("int") for t, c in zip(tiles, coords)}
    )
    schema = T.StructType(
        [placed.schema[case], placed.schema["label"], *[placed.schema[c] for c in coords], T.StructField("component", T.LongType())]
    )

    low, strides = _measured_strides(placed, coords)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf[coords].to_numpy(np.int64)
        code = (points - np.array(low, dtype=np.int64)) @ np.array(strides, dtype=np.int64)
        group = pdf.groupby([case, *tiles], sort=False).ngroup().to_numpy()
        first = label_tiles(group, points, pdf["label"].to_numpy(), tile)
        out = pdf[[case, "label", *coords]].copy()
        out["component"] = code[first]
        return out

    # Whole tiles go to buckets of about BUCKET_ROWS elements: few calls, bounded size.
    spark = elements.sparkSession
    buckets = max(compute_tasks(spark), elements.count() // BUCKET_ROWS + 1)
    bucketed = placed.withColumn("__bucket", F.pmod(hash60(case, *tiles), F.lit(buckets)).cast("int"))
    labelled = cut_lineage(bucketed.repartition(min(buckets, 10_000), "__bucket").groupBy("__bucket").applyInPandas(local, schema))
    roots = _contract(_face_edges(labelled, case, coords, tile), case)
    if roots is None:
        return labelled
    return labelled.join(roots, [case, "component"], "left").select(
        case, "label", *coords, F.coalesce("root", "component").alias("component")
    )


def _face_edges(labelled: DataFrame, case: str, coords: Sequence[str], tile: int) -> DataFrame:
    """Distinct pairs of components that touch across a tile face."""
    on_face = F.lit(False)
    for c in coords:
        on_face = on_face | F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    faces = labelled.where(on_face)
    steps = F.array(*[F.struct(*[F.lit(o).alias(c) for o, c in zip(offset, coords)]) for offset in _offsets(len(coords))])
    reach = faces.select(case, "label", F.col("component").alias("a"), *coords, F.explode(steps).alias("s")).select(
        case, "label", "a", *[(F.col(c) + F.col("s")[c]).alias(c) for c in coords],
        *[F.floor(F.col(c) / tile).alias(f"__t_{c}") for c in coords],
    )
    crosses = F.lit(False)
    for c in coords:
        crosses = crosses | (F.floor(F.col(c) / tile) != F.col(f"__t_{c}"))
    touching = reach.where(crosses).join(faces.withColumnRenamed("component", "b"), [case, "label", *coords])
    return touching.where("a <> b").select(case, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _contract(edges: DataFrame, case: str) -> DataFrame | None:
    """Alternate large-star and small-star steps until every node points at its root; null when there are no edges."""
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(hash60(case, "u", "v").cast("decimal(28,0)"))).first())

    edges = cut_lineage(edges)
    current = state(edges)
    if current[0] == 0:
        return None
    while True:
        both = edges.unionByName(edges.select(case, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(case, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, [case, "u"]).where("v > u").select(case, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(case, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, [case, "u"]).select(case, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select(case, "u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        edges = cut_lineage(small)
        following = state(edges)
        if following == current:
            return edges.select(case, F.col("u").alias("component"), F.col("v").alias("root"))
        current = following


def component_features(components: DataFrame, cases: DataFrame, case: str, labels: Sequence[int]) -> DataFrame:
    """Number of components and share of the largest per case and label; absent labels give 0 and 0.0."""
    sizes = components.groupBy(case, "label", "component").agg(F.count(F.lit(1)).alias("n"))
    counted = sizes.groupBy(case, "label").agg(
        F.count(F.lit(1)).alias("components"), (F.max("n") / F.sum("n")).alias("largest_fraction")
    )
    wanted = cases.select(case, F.explode(F.array(*[F.lit(int(v)) for v in labels])).alias("label"))
    return wanted.join(counted, [case, "label"], "left").select(
        case, "label", F.coalesce("components", F.lit(0)).cast("bigint").alias("components"),
        F.coalesce("largest_fraction", F.lit(0.0)).alias("largest_fraction"),
    )


# --- complete feature rows -------------------------------------------------------------------

def case_features(
    elements: DataFrame, case: str, probabilities: str, label: str, labels: Sequence[int], *, support: Column | None = None,
    coords: Sequence[str] = COORDS, tile: int = TILE,
) -> DataFrame:
    """One row per case in fixed column order: entropy and confidence, fractions, components.

    With a support, means and fractions are taken inside it (components never are);
    without one, all elements count. The label may be the argmax of the probabilities.
    """
    foreground = [v for v in labels if v != 0]
    # the source is read once: sizes, features, fractions, components and cases all start from what was read
    inside = [] if support is None else [support.alias("__inside")]
    elements = cut_lineage(elements.select(case, *coords, probabilities, label, *inside))
    support = F.col("__inside") if inside else None
    probability = probability_features(elements, case, probabilities, support)
    fractions = label_fractions(elements, case, label, labels, support)
    components = connected_components(elements.where(F.col(label).isin(foreground)), case, label, coords, tile=tile)
    cases = elements.select(case).distinct()
    per_label = component_features(components, cases, case, foreground)
    wide = per_label.groupBy(case).agg(
        *[F.max(F.when(F.col("label") == v, F.col("components"))).cast("double").alias(f"components_{v}") for v in foreground],
        *[F.max(F.when(F.col("label") == v, F.col("largest_fraction"))).alias(f"largest_component_fraction_{v}") for v in foreground],
    )
    # a case without any element in the support keeps its row; its means and fractions are null
    found = cases.join(probability, case, "left").join(fractions, case, "left").join(wide, case, "left")
    return found.select(case, *feature_names(labels))


def feature_names(labels: Sequence[int]) -> list[str]:
    foreground = [v for v in labels if v != 0]
    return [
        "entropy_mean", "entropy_p90", "entropy_p95", "confidence_mean", "confidence_p10", "foreground_fraction",
        *[f"class_fraction_{v}" for v in foreground],
        *[f"components_{v}" for v in foreground],
        *[f"largest_component_fraction_{v}" for v in foreground],
    ]


def with_argmax(elements: DataFrame, probabilities: str, name: str = "label") -> DataFrame:
    return elements.withColumn(name, argmax_index(probabilities))
