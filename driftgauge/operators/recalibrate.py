"""Cross-fitted quantities: leave-one-fold-out medians and recalibration of a prediction.

Tables here are "copies": one row per (keys, unit) with a multiplicity, the unit's
``folds`` array and its values. ``keys`` identify an independent sample, such as
(domain, replicate). Every fit for a fold uses the other folds only.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.operators.ranks import BLOCK, range_blocks
from driftgauge.session import bounded_broadcast, broadcast_bytes, compute_tasks, cut_lineage, measured_broadcast, task_rows

# Least-absolute-deviation fit.
IRLS_ITERATIONS = 80
IRLS_EPSILON = 1e-9
# points from which several fits are made in blocks, and points times fits of a block
LAD_BLOCKED, LAD_CELLS = 4096, 1 << 15

# A weighted variance below this share of (1 + squared mean) is that of a constant.
FLAT = 1e-28

RECALIBRATORS = ("affine_L1", "affine_OLS", "isotonic")


# --- leave-one-fold-out medians -------------------------------------------------

def leave_fold_out_medians(
    copies: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    repeats: int,
    k: int,
    weight: str = "multiplicity",
    block: str = "block",
    n_samples: int | None = None,
) -> DataFrame:
    """``(keys, repeat, fold, n_train, median)`` of the values outside each fold.

    A median is not decomposable, so it is found in two passes without sorting the
    copies: counts per order block give the block that holds each middle position
    (map-side-combined), and only the rows of those blocks are then looked at.
    ``block`` must not decrease with the value.
    """
    keys = list(keys)
    fold = lambda r: F.element_at("folds", r + 1)
    counts = copies.groupBy(*keys, block).agg(
        *[
            F.sum(F.when(fold(r) == f, F.col(weight)).otherwise(0)).alias(f"c{r}_{f}")
            for r in range(repeats)
            for f in range(k)
        ]
    )
    entries = []
    for r in range(repeats):
        everyone = sum((F.col(f"c{r}_{f}") for f in range(1, k)), F.col(f"c{r}_0"))
        for f in range(k):
            entries.append(
                F.struct(F.lit(r).alias("repeat"), F.lit(f).alias("fold"), (everyone - F.col(f"c{r}_{f}")).alias("outside"))
            )
    per_block = counts.select(*keys, block, F.explode(F.array(*entries)).alias("e")).select(*keys, block, "e.*")
    one = [*keys, "repeat", "fold"]
    ordered = W.partitionBy(*one).orderBy(block)
    placed = per_block.select(
        *one,
        block,
        "outside",
        F.coalesce(F.sum("outside").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("outside").over(W.partitionBy(*one)).alias("n_train"),
    ).withColumns({"lo": F.expr("(n_train - 1) div 2"), "hi": F.expr("n_train div 2")})
    covers = lambda at: (F.col("offset") <= F.col(at)) & (F.col(at) < F.col("offset") + F.col("outside"))
    targets = placed.where((F.col("n_train") > 0) & (covers("lo") | covers("hi"))).drop("outside")
    if n_samples is not None:
        targets = bounded_broadcast(targets, 2 * n_samples * repeats * k, 96)

    inside = (
        copies.select(*keys, block, value, weight, "folds")
        .join(targets, [*keys, block])
        .where(F.expr("folds[repeat]") != F.col("fold"))
        .groupBy(*one, block, "offset", "lo", "hi", "n_train", value)
        .agg(F.sum(weight).alias("mult"))
    )
    running = W.partitionBy(*one, block).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("offset") + F.coalesce(F.sum("mult").over(running), F.lit(0)))
    at = lambda p: F.max(F.when((F.col("start") <= F.col(p)) & (F.col(p) < F.col("start") + F.col("mult")), F.col(value)))
    return inside.groupBy(*one).agg(F.max("n_train").alias("n_train"), ((at("lo") + at("hi")) / 2.0).alias("median"))


# --- affine fits ------------------------------------------------------------------

def sample_center(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """A point near the data, around which sums of products do not cancel."""
    row = df.agg(F.avg(x).alias("x"), F.avg(y).alias("y")).first()
    return float(row["x"] or 0.0), float(row["y"] or 0.0)


def affine_from_sums(
    n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, center: tuple[float, float] = (0.0, 0.0)
) -> tuple[Column, Column]:
    """Intercept and slope of least squares from sums around ``center``; the minimum-norm solution when x is constant."""
    cxx = sxx - sx * sx / n
    mean_x, mean_y = F.lit(center[0]) + sx / n, F.lit(center[1]) + sy / n
    # constant up to the rounding of the sums or of the values themselves
    flat = (cxx <= F.lit(1e-14) * sxx) | (cxx <= F.lit(FLAT) * n * (1.0 + mean_x * mean_x))
    slope = F.try_divide(sxy - sx * sy / n, cxx)
    norm = 1.0 + mean_x * mean_x
    return (
        F.when(flat, mean_y / norm).otherwise(mean_y - slope * mean_x),
        F.when(flat, mean_y * mean_x / norm).otherwise(slope),
    )


def affine_line_from_sums(
    n: float, sx: float, sy: float, sxx: float, sxy: float, center: tuple[float, float]
) -> tuple[float, float]:
    """:func:`affine_from_sums` for numbers."""
    cxx = sxx - sx * sx / n
    mean_x, mean_y = center[0] + sx / n, center[1] + sy / n
    if cxx <= 1e-14 * sxx or cxx <= FLAT * n * (1.0 + mean_x * mean_x):
        return mean_y / (1.0 + mean_x * mean_x), mean_y * mean_x / (1.0 + mean_x * mean_x)
    slope = (sxy - sx * sy / n) / cxx
    return mean_y - slope * mean_x, slope


def ols_coefficients(
    copies: DataFrame, keys: Sequence[str], x: str, y: str, *, weight: str = "multiplicity", center: tuple[float, float] | None = None
) -> DataFrame:
    """``(keys, repeat, fold, n_train, intercept, slope)`` fitted outside each fold.

    Sums are additive, so outside = total - fold: one combined aggregate. They are taken around ``center`` (measured when not
    given), so that large values with a small spread do not cancel.
    """
    keys = list(keys)
    center = center or sample_center(copies, x, y)
    m, cx, cy = F.col(weight), F.col(x) - F.lit(center[0]), F.col(y) - F.lit(center[1])
    per_fold = (
        copies.select(*keys, x, y, weight, F.posexplode("folds").alias("repeat", "fold"))
        .groupBy(*keys, "repeat", "fold")
        .agg(
            F.sum(m).alias("n"), F.sum(m * cx).alias("sx"), F.sum(m * cy).alias("sy"),
            F.sum(m * cx * cx).alias("sxx"), F.sum(m * cx * cy).alias("sxy"),
        )
    )
    every = W.partitionBy(*keys, "repeat")
    outside = per_fold.select(
        *keys, "repeat", "fold", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")]
    )
    intercept, slope = affine_from_sums(F.col("n"), F.col("sx"), F.col("sy"), F.col("sxx"), F.col("sxy"), center)
    return outside.where("n >= 2").select(
        *keys, "repeat", "fold", F.col("n").alias("n_train"), intercept.alias("intercept"), slope.alias("slope")
    )


def weighted_line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted least squares line around the weighted means; minimum norm when x is constant."""
    total = w.sum()
    mx, my = (w @ x) / total, (w @ y) / total
    dx = x - mx
    cxx = w @ (dx * dx)
    if cxx <= FLAT * total * (1.0 + mx * mx):
        return my / (1.0 + mx * mx), my * mx / (1.0 + mx * mx)
    slope = (w @ (dx * (y - my))) / cxx
    return my - slope * mx, slope


def lad_line(x: np.ndarray, y: np.ndarray, m: np.ndarray, iterations: int = IRLS_ITERATIONS, eps: float = IRLS_EPSILON) -> tuple[float, float]:
    """Least-absolute-deviation line: a fixed number of reweighted least-squares steps from OLS."""
    a, b = weighted_line(x, y, m)
    for _ in range(iterations):
        a, b = weighted_line(x, y, m / np.maximum(np.abs(y - a - b * x), eps))
    return float(a), float(b)


def lad_lines(x: np.ndarray, y: np.ndarray, weights: np.ndarray, iterations: int = IRLS_ITERATIONS, eps: float = IRLS_EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """:func:`lad_line` for several fits to the same points at once; each row of ``weights`` is a fit, zero where a point takes no part.

    Many points are worked on in blocks, by products of matrices; fits whose sums would cancel there take the plain form.
    """
    if len(x) < LAD_BLOCKED:
        return _lad_lines_plain(x, y, weights, iterations, eps)
    a, b, sound = _lad_lines_blocked(x, y, weights, iterations, eps)
    if not sound.all():
        a[~sound], b[~sound] = _lad_lines_plain(x, y, weights[~sound], iterations, eps)
    return a, b


def _lad_lines_blocked(x: np.ndarray, y: np.ndarray, weights: np.ndarray, iterations: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intercepts, slopes and which fits are sound: their spread of x did not cancel in sums around the mean of all points in any step."""
    cx, cy, fits = x.mean(), y.mean(), len(weights)
    dx, dy = x - cx, y - cy
    size = max(256, LAD_CELLS // fits)
    starts = range(0, len(x), size)
    points = [np.stack([dy[s : s + size], np.ones(len(dx[s : s + size])), dx[s : s + size]]) for s in starts]
    moments = [np.stack([p[1], p[2], p[0], p[2] * p[2], p[2] * p[0]], axis=1) for p in points]
    blocks = [np.ascontiguousarray(weights[:, s : s + size]) for s in starts]
    cells = [np.empty((fits, p.shape[1])) for p in (points[0], points[-1])]
    a, b, sound = np.zeros(fits), np.zeros(fits), np.ones(fits, dtype=bool)
    for step in range(iterations + 1):
        sums, lines = np.zeros((fits, 5)), np.stack([np.ones(fits), -a, -b], axis=1)
        for i, (p, m, w) in enumerate(zip(points, moments, blocks)):
            if step:
                r = cells[i == len(points) - 1]
                np.matmul(lines, p, out=r)
                np.abs(r, out=r)
                np.maximum(r, eps, out=r)
                np.divide(w, r, out=r)
                w = r
            sums += w @ m
        n, sx, sy, sxx, sxy = sums.T
        cxx = sxx - sx * sx / n
        sound &= cxx > 1e-9 * sxx
        b = (sxy - sx * sy / n) / np.where(sound, cxx, 1.0)
        a = (sy - b * sx) / n
    return a + cy - b * cx, b, sound


def _lad_lines_plain(x: np.ndarray, y: np.ndarray, weights: np.ndarray, iterations: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    w, a, b = weights, None, None
    for step in range(iterations + 1):
        if step:
            w = weights / np.maximum(np.abs(y - a[:, None] - b[:, None] * x), eps)
        total = w.sum(axis=1)
        mx, my = (w @ x) / total, (w @ y) / total
        dx = x - mx[:, None]
        wdx = w * dx
        cxx = (wdx * dx).sum(axis=1)
        flat = cxx <= FLAT * total * (1.0 + mx * mx)
        slope = (wdx * (y - my[:, None])).sum(axis=1) / np.where(flat, 1.0, cxx)
        norm = 1.0 + mx * mx
        b = np.where(flat, my * mx / norm, slope)
        a = np.where(flat, my / norm, my - slope * mx)
    return a, b


def pool_runs(first: np.ndarray, last: np.ndarray, mass: np.ndarray, total: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks ``(first, last, mass, total, start)`` of pooled adjacent violators, several fits one after the other; ``start`` marks where a fit begins.

    A run of falling levels pools into one block whatever the order, so whole runs are pooled at once while that takes many away; what is left then is
    pooled by a stack, which no order of values makes slow.
    """
    while len(mass) > 1:
        level = total / mass
        head = np.concatenate([[True], (level[1:] > level[:-1]) | start[1:]])
        heads = np.flatnonzero(head)
        if len(heads) == len(mass):
            return first, last, mass, total, start
        few = len(heads) > len(mass) * 15 // 16
        ends = np.append(heads[1:], len(mass)) - 1
        first, last, start = first[heads], last[ends], start[heads]
        mass, total = np.add.reduceat(mass, heads), np.add.reduceat(total, heads)
        if few:
            break
    kept: list[int] = []
    m, s, begins, ends = mass.tolist(), total.tolist(), start.tolist(), list(range(len(mass)))
    for i in range(len(m)):
        at = i
        while kept and not begins[at] and s[kept[-1]] / m[kept[-1]] >= s[at] / m[at]:
            before = kept.pop()
            m[before], s[before], ends[before], at = m[before] + m[at], s[before] + s[at], ends[at], before
        kept.append(at)
    return first[kept], last[[ends[i] for i in kept]], np.array([m[i] for i in kept]), np.array([s[i] for i in kept]), start[kept]


def pool_sorted(mass: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Fitted value at each knot of one isotonic fit; the runs of :func:`pool_runs` by their heads alone, until few pool."""
    heads, w, s = np.arange(len(mass)), mass, total
    while len(w) > 1:
        level = s / w
        at = np.concatenate([[0], np.flatnonzero(level[1:] > level[:-1]) + 1])
        few = len(at) > len(w) * 15 // 16
        heads, w, s = heads[at], np.add.reduceat(w, at), np.add.reduceat(s, at)
        if few:
            break
    place = np.arange(len(w))
    first, _, w, s, _ = pool_runs(place, place, w, s, place == 0)
    return np.repeat(s / w, np.diff(np.append(heads[first], len(mass))))


def pool_adjacent(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: knots and fitted values. Equal x are averaged first."""
    knots, where = np.unique(x, return_inverse=True)
    w, total = np.bincount(where, weights=m), np.bincount(where, weights=m * y)
    place = np.arange(len(knots))
    first, last, mass, sums, _ = pool_runs(place, place, w, total, place == 0)
    return knots, np.repeat(sums / mass, last - first + 1)


def _coefficient_schema(copies: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [copies.schema[key] for key in keys]
    return T.StructType(
        [*fields, T.StructField("repeat", T.IntegerType()), T.StructField("fold", T.IntegerType()),
         T.StructField("n_train", T.LongType()), T.StructField("intercept", T.DoubleType()), T.StructField("slope", T.DoubleType())]
    )


def l1_coefficients(
    copies: DataFrame, keys: Sequence[str], x: str, y: str, *, repeats: int, k: int, weight: str = "multiplicity", bounded: bool,
    iterations: int = IRLS_ITERATIONS, eps: float = IRLS_EPSILON,
) -> DataFrame:
    """``(keys, repeat, fold, n_train, intercept, slope)`` of least absolute deviations outside each fold.

    ``bounded`` states that a sample was measured to fit one task: then all fits of a
    sample run there in numpy. Otherwise every step is one distributed aggregate over packed rows.
    """
    if not bounded:
        return _l1_distributed(copies, list(keys), x, y, weight, iterations, eps, repeats, k)
    keys = list(keys)
    one = [*keys, "repeat"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys, ms = (pdf[c].to_numpy(np.float64) for c in (x, y, weight))
        folds = pdf["fold"].to_numpy()
        head = [pdf[key].iloc[0] for key in one]
        rows = []
        for f in range(k):
            train = folds != f
            n = int(ms[train].sum())
            if n >= 2:
                rows.append((*head, f, n, *lad_line(xs[train], ys[train], ms[train], iterations, eps)))
        return pd.DataFrame(rows, columns=[*one, "fold", "n_train", "intercept", "slope"])

    return _by_repeat(copies, keys, [x, y, weight]).applyInPandas(fit, _coefficient_schema(copies, keys))


def _by_repeat(copies: DataFrame, keys: list[str], columns: list[str]) -> GroupedData:
    """Copies grouped by (sample, repeat).

    The fits are bound by computing, not by bytes, so the groups are spread over all
    cores explicitly instead of being coalesced by size.
    """
    tasks = compute_tasks(copies.sparkSession)
    long = copies.select(*keys, *columns, F.posexplode("folds").alias("repeat", "fold"))
    return long.repartition(tasks, *keys, "repeat").groupBy(*keys, "repeat")


# Rows of a sample that are packed into one row of arrays.
PACKED_ROWS = 1 << 14


def _packed(copies: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    """``(keys, xs, ys, ms, fs)``: rows of a sample in packs, as the bytes of float64 vectors and of int16 fold numbers, repeat by repeat."""
    columns = ["xs", "ys", "ms"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for head, rows in _by_keys(table, keys):
                for at in range(0, rows.num_rows, PACKED_ROWS):
                    part = rows.slice(at, PACKED_ROWS)
                    vectors = [np.asarray(part.column(c)).astype(np.float64).tobytes() for c in columns]
                    folds = _fold_rows(part).astype(np.int16).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([v], batch.schema.field(c).type) for c, v in zip(keys, head)), *(pa.array([v], pa.binary()) for v in (*vectors, folds))],
                        names=[*keys, *columns, "fs"],
                    )

    schema = T.StructType([*[copies.schema[c] for c in keys], *[T.StructField(c, T.BinaryType()) for c in (*columns, "fs")]])
    slim = copies.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in zip((x, y, weight), columns)], "folds")
    return slim.mapInArrow(pack, schema)


def _by_keys(table: pa.Table, keys: Sequence[str]) -> Iterator[tuple[list, pa.Table]]:
    """The rows of every combination of key values, with these values, in the order of their first rows."""
    if not table.num_rows:
        return
    code = np.zeros(table.num_rows, dtype=np.int64)
    for c in keys:
        found = table.column(c).combine_chunks().dictionary_encode("encode")
        own = np.unique(code * (len(found.dictionary) + 1) + np.asarray(found.indices), return_inverse=True)[1]
        code = own.astype(np.int64).ravel()
    order = np.argsort(code, kind="stable")
    for rows in sorted(np.split(order, np.flatnonzero(np.diff(code[order])) + 1), key=lambda r: r[0]):
        part = table if len(rows) == table.num_rows else table.take(pa.array(rows))
        yield [part.column(c)[0].as_py() for c in keys], part


def _fold_rows(table: pa.Table) -> np.ndarray:
    """Fold numbers, one row for each repeat."""
    lists = table.column("folds").combine_chunks()
    flat = np.asarray(lists.flatten())
    return np.ascontiguousarray(flat.reshape(table.num_rows, -1).T) if table.num_rows else flat.reshape(0, 0)


def _l1_sums(x: np.ndarray, y: np.ndarray, m: np.ndarray, folds: np.ndarray, a: np.ndarray, b: np.ndarray, center: np.ndarray, eps: float | None) -> np.ndarray:
    """Sums (5, folds) of one repeat: weights, and products of weight, distance to the centre and residual, over the rows outside each fold."""
    residual = y - a[:, None] - b[:, None] * x
    dx = x - center[:, None]
    w = np.broadcast_to(m, residual.shape).copy() if eps is None else m / np.maximum(np.abs(residual), eps)
    inside = (folds >= 0) & (folds < len(a))
    w[folds[inside], np.flatnonzero(inside)] = 0.0
    wr, wx = w * residual, w * dx
    return np.stack([w.sum(axis=1), wx.sum(axis=1), wr.sum(axis=1), (wx * dx).sum(axis=1), (wx * residual).sum(axis=1)])


def _l1_distributed(copies: DataFrame, keys: list[str], x: str, y: str, weight: str, iterations: int, eps: float, repeats: int, k: int) -> DataFrame:
    """The same fits when a sample exceeds one task: the only state between steps is the coefficients.

    Each step is one aggregate over all fits at once, by vectors over packs of rows: residuals are regressed on the distance from the fit's last weighted mean,
    so large weights do not cancel. The least-squares start is such a step too, so both forms take the same decisions about constant predictors.
    """
    one = [*keys, "repeat", "fold"]
    data = cut_lineage(_packed(copies, keys, x, y, weight).repartition(compute_tasks(copies.sparkSession)))
    m = F.col(weight)
    per_fold = copies.select(*keys, x, weight, F.posexplode("folds").alias("repeat", "fold")).groupBy(*one).agg(F.sum(m).alias("n"), F.sum(m * F.col(x)).alias("sx"))
    every = W.partitionBy(*keys, "repeat")
    outside = per_fold.select(*one, *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n", "sx")]).where("n >= 2")
    current = cut_lineage(outside.select(
        *one, F.col("n").alias("n_train"), F.lit(0.0).alias("intercept"), F.lit(0.0).alias("slope"), (F.col("sx") / F.col("n")).alias("center")
    ))
    n_fits = current.count()
    names, state = ["sw", "sx", "sr", "sxx", "sxr"], ["n_train", "intercept", "slope", "center"]
    schema = T.StructType([*[copies.schema[c] for c in keys], T.StructField("repeat", T.IntegerType()), T.StructField("fold", T.IntegerType()),
                           *[T.StructField(c, T.DoubleType()) for c in names]])

    def sums_of(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                head = tuple(batch.column(c)[i].as_py() for c in keys)
                xs, ys, ms = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.float64) for c in ("xs", "ys", "ms"))
                folds = np.frombuffer(batch.column("fs")[i].as_buffer(), dtype=np.int16).reshape(repeats, -1)
                if head not in found:
                    fits = batch.column("fits")[i].as_py()
                    lines = np.full((3, repeats, k), np.nan)
                    for f in fits:
                        lines[:, f["repeat"], f["fold"]] = f["intercept"], f["slope"], f["center"]
                    found[head] = [fits, lines, np.zeros((5, repeats, k))]
                _, (a, b, center), sums = found[head]
                for r in range(repeats):
                    sums[:, r] += _l1_sums(xs, ys, ms, folds[r], a[r], b[r], center[r], eps if step else None)
        for head, (fits, _, sums) in found.items():
            r, f = ([e[c] for e in fits] for c in ("repeat", "fold"))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([v] * len(fits), batch.schema.field(c).type) for c, v in zip(keys, head)), pa.array(r, pa.int32()), pa.array(f, pa.int32()), *(pa.array(s) for s in sums[:, r, f])],
                names=schema.names,
            )

    for step in range(iterations + 1):
        fits = current.groupBy(*keys).agg(F.collect_list(F.struct("repeat", "fold", "intercept", "slope", "center")).alias("fits"))
        joined = data.join(bounded_broadcast(fits, n_fits, 64), keys)
        parts = joined.mapInArrow(lambda batches, step=step: sums_of(batches, step), schema)
        sums = parts.groupBy(*one).agg(*[F.sum(c).alias(c) for c in names]).join(bounded_broadcast(current.select(*one, *state), n_fits, 128), one)
        sw, sx, sr = F.col("sw"), F.col("sx"), F.col("sr")
        cxx = F.greatest(F.col("sxx") - sx * sx / sw, F.lit(0.0))
        mean_x = F.col("center") + sx / sw
        mean_y = sr / sw + F.col("intercept") + F.col("slope") * mean_x
        flat = cxx <= F.lit(FLAT) * sw * (1.0 + mean_x * mean_x)
        norm = 1.0 + mean_x * mean_x
        slope = F.when(flat, mean_y * mean_x / norm).otherwise(F.col("slope") + F.try_divide(F.col("sxr") - sx * sr / sw, cxx))
        current = cut_lineage(
            sums.select(*one, "n_train", slope.alias("__b"), F.when(flat, mean_y / norm).otherwise(mean_y - slope * mean_x).alias("intercept"), mean_x.alias("center"))
            .withColumnRenamed("__b", "slope")
        )
    return current.select(*one, "n_train", "intercept", "slope")


def training_objectives(copies: DataFrame, keys: Sequence[str], x: str, y: str, coefficients: DataFrame, *, weight: str = "multiplicity") -> DataFrame:
    """Adds ``mean_abs_error``, the mean absolute error on the rows each fit was trained on."""
    keys = list(keys)
    fits = measured_broadcast(cut_lineage(coefficients.withColumnRenamed("fold", "heldout")))
    long = copies.select(*keys, x, y, weight, F.posexplode("folds").alias("repeat", "fold"))
    error = F.abs(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))
    return (
        long.join(fits, [*keys, "repeat"]).where("fold <> heldout")
        .groupBy(*keys, "repeat", F.col("heldout").alias("fold"), "n_train", "intercept", "slope")
        .agg((F.sum(F.col(weight) * error) / F.sum(weight)).alias("mean_abs_error"))
    )


def affine_coefficients(
    copies: DataFrame, keys: Sequence[str], x: str, y: str, recalibrator: str, *, repeats: int, k: int, bounded: bool,
    weight: str = "multiplicity", center: tuple[float, float] | None = None,
) -> DataFrame:
    if recalibrator == "affine_OLS":
        return ols_coefficients(copies, keys, x, y, weight=weight, center=center)
    if recalibrator == "affine_L1":
        return l1_coefficients(copies, keys, x, y, repeats=repeats, k=k, weight=weight, bounded=bounded)
    raise ValueError(f"not an affine recalibrator: {recalibrator}")


# --- out-of-fold predictions ---------------------------------------------------------

def crossfit_predictions(
    copies: DataFrame, keys: Sequence[str], id_col: str, x: str, y: str, recalibrator: str, *, repeats: int, k: int, bounded: bool,
    weight: str = "multiplicity",
) -> DataFrame:
    """``(keys, id, repeat, fold, prediction)``: the full out-of-fold vector, never clipped."""
    keys = list(keys)
    if recalibrator in ("affine_L1", "affine_OLS"):
        coefficients = affine_coefficients(copies, keys, x, y, recalibrator, repeats=repeats, k=k, bounded=bounded, weight=weight)
        # Few fits, many rows: the coefficients are pinned, counted and broadcast when small.
        coefficients = measured_broadcast(cut_lineage(coefficients))
        long = copies.select(*keys, id_col, x, F.posexplode("folds").alias("repeat", "fold"))
        return long.join(coefficients, [*keys, "repeat", "fold"]).select(
            *keys, id_col, "repeat", "fold", (F.col("intercept") + F.col("slope") * F.col(x)).alias("prediction")
        )
    if recalibrator != "isotonic":
        raise ValueError(f"unknown recalibrator: {recalibrator}")
    if not bounded:
        return isotonic_predictions(copies, keys, [id_col], x, y, repeats=repeats, k=k, weight=weight)
    schema = T.StructType(
        [*[copies.schema[key] for key in keys], copies.schema[id_col], T.StructField("repeat", T.IntegerType()),
         T.StructField("fold", T.IntegerType()), T.StructField("prediction", T.DoubleType())]
    )

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*keys, id_col, "repeat", "fold"]].copy()
        out["prediction"] = _isotonic_out_of_fold(pdf, x, y, weight, k)
        return out

    return _by_repeat(copies, keys, [id_col, x, y, weight]).applyInPandas(predict, schema)


def _isotonic_out_of_fold(pdf: pd.DataFrame, x: str, y: str, weight: str, k: int) -> np.ndarray:
    xs, ys, ms = (pdf[c].to_numpy(np.float64) for c in (x, y, weight))
    folds = pdf["fold"].to_numpy()
    predicted = np.full(len(xs), np.nan)
    for f in range(k):
        held = folds == f
        if held.any():
            knots, fitted = pool_adjacent(xs[~held], ys[~held], ms[~held])
            predicted[held] = np.interp(xs[held], knots, fitted)
    return predicted


# --- isotonic fits of samples beyond one task -----------------------------------------

def _pool(stack: list[list[float]], level: float, mass: float, first: float, last: float) -> None:
    """Add a block (level, mass, first x, last x) to the right and pool it with what it violates."""
    while stack and stack[-1][0] >= level:
        before = stack.pop()
        level = (before[0] * before[1] + level * mass) / (before[1] + mass)
        mass, first = mass + before[1], before[2]
    stack.append([level, mass, first, last])


def _pooled_runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks ``(keys, repeat, fold, x_first, x_last, mass, level)`` pooled inside every sorted partition.

    The pooled state is what any further pooling needs, so partitions can be pooled in any order.
    """
    one = [*keys, "repeat", "fold"]
    columns = ["x_first", "x_last", "mass", "level"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, stack, schema = None, [], None

        def flushed() -> pa.RecordBatch:
            heads = [pa.array([v] * len(stack), schema.field(i).type) for i, v in enumerate(head)]
            values = [pa.array([b[i] for b in stack], pa.float64()) for i in (2, 3, 1, 0)]
            return pa.RecordBatch.from_arrays([*heads, *values], names=[*one, *columns])

        for batch in batches:
            schema = batch.schema
            values = [batch.column(c).to_pylist() for c in [*one, *columns]]
            for *of, first, last, mass, level in zip(*values):
                if head != of:
                    if stack:
                        yield flushed()
                    head, stack = of, []
                _pool(stack, level, mass, first, last)
        if stack:
            yield flushed()

    fields = T.StructType([*[rows.schema[c] for c in one], *[T.StructField(c, T.DoubleType()) for c in columns]])
    return rows.select(*one, *columns).mapInArrow(run, fields)


# Rows that are pooled by vectors at once.
POOLED_ROWS = 1 << 16


class _RangePooler:
    """Pools the rows of one sorted range for the fits outside every fold of every repeat, some rows at a time."""

    def __init__(self, repeats: int, k: int) -> None:
        self.repeats, self.k, self.held = repeats, k, None

    def add(self, x: np.ndarray, y: np.ndarray, m: np.ndarray, folds: np.ndarray, final: bool) -> list[tuple]:
        """``(repeat, fold, first, last, mass, level)`` of what is sure to have all rows of its x: the last x is held back unless ``final``."""
        new = np.append(np.ones(min(1, len(x)), bool), x[1:] != x[:-1])
        knots, where = x[new], np.cumsum(new) - 1
        grids = []
        for r in range(self.repeats):
            # rows in no fold 0..k-1 are outside of all
            of = folds[r] if len(folds) else where
            cell = where * (self.k + 1) + np.where((of >= 0) & (of < self.k), of, self.k)
            size = len(knots) * (self.k + 1)
            grids.append(np.stack([np.bincount(cell, weights=v, minlength=size).reshape(-1, self.k + 1) for v in (m, m * y)]))
        if self.held is not None:
            at, before = self.held
            if len(knots) and knots[0] == at:
                for g, h in zip(grids, before):
                    g[:, :1] += h
            else:
                knots, grids = np.append(at, knots), [np.concatenate([h, g], axis=1) for g, h in zip(grids, before)]
            self.held = None
        if not final and len(knots):
            self.held = knots[-1], [g[:, -1:].copy() for g in grids]
            knots, grids = knots[:-1], [g[:, :-1] for g in grids]
        return [out for r, g in enumerate(grids) for out in self._fits(r, knots, g)] if len(knots) else []

    def _fits(self, r: int, knots: np.ndarray, grid: np.ndarray) -> Iterator[tuple]:
        # whole multiplicities subtract exactly
        mass, total = (np.ascontiguousarray((g.sum(axis=1)[:, None] - g[:, : self.k]).T) for g in grid)
        fit, place = np.nonzero(mass > 0)
        if not len(fit):
            return
        begins = np.concatenate([[True], fit[1:] != fit[:-1]])
        # the fit of a block travels with its first place
        at = np.arange(len(fit))
        first, last, mass, total, _ = pool_runs(at, at, mass[fit, place], total[fit, place], begins)
        yield np.full(len(first), r), fit[first], knots[place[first]], knots[place[last]], mass, total / mass


def _pooled_ranges(copies: DataFrame, keys: list[str], x: str, y: str, weight: str, repeats: int, k: int, parts: int) -> DataFrame:
    """Blocks ``(keys, repeat, fold, x_first, x_last, mass, level)`` of all fits, pooled inside ranges of (keys, x): the rows are sorted once and not once for each fit."""
    names = ["repeat", "fold", "x_first", "x_last", "mass", "level"]
    types = [pa.int32(), pa.int32(), *[pa.float64()] * 4]
    schema = T.StructType([*[copies.schema[c] for c in keys], T.StructField("repeat", T.IntegerType()), T.StructField("fold", T.IntegerType()),
                           *[T.StructField(c, T.DoubleType()) for c in names[2:]]])
    slim = copies.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.col(weight).cast("double").alias("__m"), "folds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, pooler, waiting, n = None, None, [], 0
        key_types: list = []

        def pooled(final: bool) -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(waiting)
            values = [np.asarray(table.column(c)) for c in ("__x", "__y", "__m")]
            for out in pooler.add(*values, _fold_rows(table), final):
                heads = [pa.array([v] * len(out[0]), kind) for v, kind in zip(head, key_types)]
                yield pa.RecordBatch.from_arrays([*heads, *(pa.array(v, kind) for v, kind in zip(out, types))], names=[*keys, *names])

        for batch in batches:
            key_types = [batch.schema.field(c).type for c in keys]
            # sorted by keys, so a batch has the rows of a key together
            for own, rows in _by_keys(pa.Table.from_batches([batch]), keys):
                if own != head:
                    if waiting:
                        yield from pooled(True)
                    head, pooler, waiting, n = own, _RangePooler(repeats, k), [], 0
                waiting.append(rows)
                n += rows.num_rows
                if n >= POOLED_ROWS:
                    yield from pooled(False)
                    waiting, n = [rows.slice(0, 0)], 0
        if waiting:
            yield from pooled(True)

    ranged = slim.repartitionByRange(parts, *keys, "__x").sortWithinPartitions(*keys, "__x")
    return ranged.mapInArrow(run, schema)


def isotonic_blocks(copies: DataFrame, keys: Sequence[str], x: str, y: str, *, repeats: int, k: int, weight: str = "multiplicity") -> DataFrame:
    """``(keys, repeat, fold, x_first, x_last, mass, level)``: the pooled blocks of the isotonic fit outside each fold, all fits at once.

    Copies are sorted once by ranges of x, and pooled inside every range for all fits, equal x averaged first. Blocks that still violate the order across the end of a
    range are pooled in further rounds over fewer, shifted ranges of (fit, x). Pooling adjacent violators gives the same fit in any
    order, so the rounds end with the fit of the whole sample; no task sees more than a range and the driver sees two counts a round.
    """
    keys = list(keys)
    one = [*keys, "repeat", "fold"]
    spark = copies.sparkSession
    limit, turn = task_rows(spark), 0
    parts = max(compute_tasks(spark), 2)
    rows = cut_lineage(_pooled_ranges(copies, keys, x, y, weight, repeats, k, parts))
    parts = max(1, min(parts, math.ceil(rows.count() / limit)))
    while True:
        ranged = rows.repartitionByRange(parts, *one, "x_first").sortWithinPartitions(*one, "x_first")
        rows = cut_lineage(_pooled_runs(ranged, keys).withColumn(BLOCK, F.spark_partition_id()))
        ends = rows.groupBy(*one, BLOCK).agg(F.min_by("level", "x_first").alias("left"), F.max_by("level", "x_first").alias("right"), F.count("*").alias("n"))
        beside = F.lag("right").over(W.partitionBy(*one).orderBy(BLOCK))
        total, open_ends = ends.withColumn("before", beside).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("before") >= F.col("left"))).first()
        rows = rows.drop(BLOCK)
        if not open_ends:
            return rows
        turn += 1
        # another number of ranges moves their ends
        parts = max(1, min(parts, math.ceil(total / limit))) + turn % 2


def _looked_up(copies: DataFrame, blocks: DataFrame, keys: list[str], carry: Sequence[str], x: str, repeats: int, k: int) -> DataFrame:
    """``(keys, carry, repeat, fold, prediction)`` where the blocks were counted to fit a broadcast: rows are read once and not sorted."""
    found: dict[tuple, tuple] = {}
    for head, rows in _by_keys(blocks.toArrow(), [*keys, "repeat", "fold"]):
        rows = rows.sort_by("x_first")
        found[tuple(head)] = tuple(np.asarray(rows.column(c)) for c in ("x_first", "x_last", "level"))
    shared = copies.sparkSession.sparkContext.broadcast(found)
    carry = [c for c in carry if c not in keys]
    schema = T.StructType([*[copies.schema[c] for c in (*keys, *carry)], copies.schema["folds"], T.StructField("__p", T.ArrayType(T.DoubleType()))])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head, rows in _by_keys(pa.Table.from_batches([batch]), keys):
                at, folds = np.asarray(rows.column("__x")), _fold_rows(rows)
                out = np.full((rows.num_rows, repeats), np.nan)
                for r in range(repeats):
                    for f in range(k):
                        held = np.flatnonzero(folds[r] == f)
                        fit = shared.value.get((*head, r, f))
                        if fit is not None and len(held):
                            out[held, r] = _interpolated(at[held], *fit)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, repeats), pa.int32()), pa.array(out.ravel(), from_pandas=True))
                kept = rows.select([*keys, *carry, "folds"]).append_column("__p", lists)
                yield from kept.combine_chunks().to_batches()

    done = copies.select(*keys, *carry, "folds", F.col(x).cast("double").alias("__x")).mapInArrow(predict, schema)
    return done.select(*keys, *carry, F.posexplode(F.arrays_zip("folds", "__p")).alias("repeat", "e")).select(
        *keys, *carry, "repeat", F.col("e.folds").alias("fold"), F.col("e.__p").alias("prediction")
    )


def _interpolated(at: np.ndarray, first: np.ndarray, last: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Levels at ``at``: that of its block, linear between blocks, constant beyond them."""
    before = np.searchsorted(first, at, side="right") - 1
    p, q = np.maximum(before, 0), np.minimum(before + 1, len(first) - 1)
    gap = (before >= 0) & (before < len(first) - 1) & (at > last[p])
    share = np.where(gap, (at - last[p]) / np.where(gap, first[q] - last[p], 1.0), 0.0)
    return level[p] + share * (level[q] - level[p])


def isotonic_predictions(
    copies: DataFrame, keys: Sequence[str], carry: Sequence[str], x: str, y: str, *, repeats: int, k: int, weight: str = "multiplicity"
) -> DataFrame:
    """``(keys, carry, repeat, fold, prediction)``: out-of-fold isotonic predictions, linear between the blocks and constant beyond them.

    While the blocks were counted to fit a broadcast, every row looks them up. Beyond that, blocks and the rows that ask are sorted together by ranges of (fit, x); a row takes the last block before it and the first after it, from its own range or,
    by one number a fit and range, from the nearest range that has one.
    """
    keys = list(keys)
    one = [*keys, "repeat", "fold"]
    blocks = isotonic_blocks(copies, keys, x, y, repeats=repeats, k=k, weight=weight)
    if blocks.count() * 128 <= broadcast_bytes(copies.sparkSession):
        return _looked_up(copies, blocks, keys, carry, x, repeats, k)
    asks = copies.select(*keys, F.struct(*carry).alias("__ask"), F.col(x).cast("double").alias("__x"), F.posexplode("folds").alias("repeat", "fold"))
    block = F.struct("x_first", "x_last", "level")
    both = blocks.select(*one, F.col("x_first").alias("__x"), F.lit(0).alias("__asks"), block.alias("__b"), F.lit(None).cast(asks.schema["__ask"].dataType).alias("__ask"))
    both = both.unionByName(asks.select(*one, "__x", F.lit(1).alias("__asks"), F.lit(None).cast(both.schema["__b"].dataType).alias("__b"), "__ask"))
    pinned = range_blocks(both, [*one, "__x", "__asks"])
    inside = W.partitionBy(*one, BLOCK).orderBy("__x", "__asks")
    ends = pinned.where("__asks = 0").groupBy(*one, BLOCK).agg(F.min_by("__b", "__x").alias("left"), F.max_by("__b", "__x").alias("right"))
    every = pinned.select(*one, BLOCK).distinct().join(ends, [*one, BLOCK], "left")
    across = W.partitionBy(*one).orderBy(BLOCK)
    carried = every.select(
        *one, BLOCK,
        F.last("right", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias("__left"),
        F.first("left", ignorenulls=True).over(across.rowsBetween(1, W.unboundedFollowing)).alias("__right"),
    )
    placed = pinned.withColumns({
        "__p": F.last("__b", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)),
        "__q": F.first("__b", ignorenulls=True).over(inside.rowsBetween(W.currentRow, W.unboundedFollowing)),
    }).where("__asks = 1").join(measured_broadcast(cut_lineage(carried)), [*one, BLOCK])
    p, q, at = F.coalesce("__p", "__left"), F.coalesce("__q", "__right"), F.col("__x")
    share = (at - p["x_last"]) / (q["x_first"] - p["x_last"])
    prediction = (
        F.when(p.isNull(), q["level"]).when((at <= p["x_last"]) | q.isNull(), p["level"])
        .otherwise(p["level"] + share * (q["level"] - p["level"]))
    )
    return placed.select(*keys, "__ask.*", "repeat", "fold", prediction.alias("prediction"))
