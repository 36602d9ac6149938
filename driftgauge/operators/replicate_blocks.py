"""Bootstrap replicates by blocks: a sample that fits a task stays together, replicates are what is spread.

Each task takes the units of one sample and a block of replicates. A unit's multiplicity in a replicate is an entry of a vector; medians,
fits, ranks and sums of a replicate are vector operations over units that were sorted once for the whole block. So copies
are never built or shuffled: what moves is the sample, once for each block. Draws are the same as those of
:func:`driftgauge.operators.resample.draw`, and results do not depend on the blocks.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.operators.recalibrate import LAD_BLOCKED, affine_line_from_sums, lad_lines, pool_sorted
from driftgauge.operators.resample import POISSON_TOTALS
from driftgauge.session import compute_tasks

LOW_60 = (1 << 60) - 1
PAIRS_PER_BLOCK = 64
# points times fits that are worked on at once, in the plain and in the blocked form of the fits
FIT_CELLS, BLOCKED_CELLS = 1 << 15, 1 << 22

# what a replicate gives: a list of rows for its multiplicities
PerReplicate = Callable[[np.ndarray], list[tuple]]


def _hashes(prefix: bytes, parts: list[bytes]) -> np.ndarray:
    """md5 of ``prefix + part`` for every part, as rows of 16 bytes."""
    md5 = hashlib.md5
    joined = b"".join([md5(prefix + p, usedforsecurity=False).digest() for p in parts])
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, 16)


def _first_60(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, :8]).view(">u8").ravel().astype(np.uint64) >> np.uint64(4)


def _second_60(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, 7:15]).view(">u8").ravel().astype(np.uint64) & np.uint64(LOW_60)


def multiplicities(key: str, ids: Sequence[str] | None, n: int, pairs: range, resamples: int) -> Iterator[tuple[int, np.ndarray]]:
    """(replicate, multiplicity of the unit at each place) for the replicates of ``pairs``; place ``p`` of ``n`` draws by the hash of (key, pair, p).

    With ``ids`` the counts are Poisson by the hash of (key, replicate, id).
    """
    places = [str(p).encode() for p in range(n)] if ids is None else [str(i).encode() for i in ids]
    for pair in pairs:
        numbers = [r for r in (2 * pair - 1, 2 * pair) if 1 <= r <= resamples]
        if ids is not None:
            for r in numbers:
                uniform = _first_60(_hashes(f"{key}:{r}:".encode(), places)).astype(np.float64) / float(1 << 60)
                yield r, np.searchsorted(POISSON_TOTALS, uniform, side="right").astype(np.float64)
            continue
        digests = _hashes(f"{key}:{pair}:".encode(), places)
        for r in numbers:
            drawn = (_first_60(digests) if r % 2 else _second_60(digests)) % np.uint64(n)
            yield r, np.bincount(drawn.astype(np.int64), minlength=n).astype(np.float64)


def over_replicates(
    placed: DataFrame, group_cols: Sequence[str], id_col: str, columns: Sequence[str], prepare: Callable[[pa.Table], PerReplicate], fields: Sequence[T.StructField], *,
    resamples: int, seed: int, mode: str = "multinomial",
) -> DataFrame:
    """``(groups, replicate, fields)`` for replicate 0 (the sample itself) and 1..``resamples`` of every group.

    ``placed`` comes from :func:`driftgauge.operators.resample.place_units` and every group has been measured to fit a task. ``prepare`` gets the units of a
    group (``columns``) and returns a function from multiplicities to rows.
    """
    group_cols = list(group_cols)
    if mode not in ("multinomial", "poisson"):
        raise ValueError(f"unknown bootstrap mode: {mode}")
    pairs = (int(resamples) + 1) // 2
    tasks = compute_tasks(placed.sparkSession)
    per_block = max(1, min(PAIRS_PER_BLOCK, math.ceil(pairs / (2 * tasks)) if pairs else 1))
    n_blocks = max(1, math.ceil(pairs / per_block))
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in group_cols]).alias("__key")
    spread = placed.select(
        *group_cols, key, "__pos", F.col(id_col).cast("string").alias("__id"), *columns, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("__part")
    ).repartition(4 * tasks, *group_cols, "__part")
    schema = T.StructType([*[placed.schema[c] for c in group_cols], T.StructField("replicate", T.IntegerType()), *fields])
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields[len(group_cols):]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__pos")
        part, text = table.column("__part")[0].as_py(), table.column("__key")[0].as_py()
        each = prepare(table.select(list(columns)))
        n = table.num_rows
        rows = [(0, *row) for row in each(np.ones(n))] if part == 0 else []
        ids = table.column("__id").to_pylist() if mode == "poisson" else None
        for replicate, m in multiplicities(text, ids, n, range(1 + part * per_block, 1 + min(pairs, (part + 1) * per_block)), int(resamples)):
            rows += [(replicate, *row) for row in each(m)]
        found = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(arrow), arrow.types)], schema=arrow)
        heads = [pa.chunked_array([pa.repeat(table.column(c)[0], found.num_rows)]) for c in group_cols]
        return pa.Table.from_arrays([*heads, *found.columns], names=[*group_cols, *arrow.names])

    return spread.groupBy(*group_cols, "__part").applyInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {"integer": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[kind.typeName()]


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).cast(pa.float64()))


def _fold_matrix(table: pa.Table, name: str, repeats: int) -> np.ndarray:
    flat = np.asarray(table.column(name).combine_chunks().flatten())
    return np.ascontiguousarray(flat.reshape(-1, repeats).T.astype(np.int64))


def _outside_medians(y: np.ndarray, m: np.ndarray, folds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Median of the values outside each fold, weighted by ``m``; ``y`` is sorted. NaN where nothing is outside."""
    out = np.full(len(sizes), np.nan)
    for f, size in enumerate(sizes):
        outside = np.cumsum(np.where(folds == f, 0.0, m))
        n = int(outside[-1]) if len(outside) else 0
        if n:
            low, high = np.searchsorted(outside, [(n - 1) // 2, n // 2], side="right")
            out[f] = (y[low] + y[high]) / 2.0
    return out


def _ols_predictions(x: np.ndarray, y: np.ndarray, m: np.ndarray, folds: np.ndarray, k: int, center: tuple[float, float]) -> np.ndarray:
    """Prediction of every unit by the least-squares line outside its fold; NaN where there is none."""
    cx, cy = x - center[0], y - center[1]
    sums = [np.bincount(folds, weights=v, minlength=k) for v in (m, m * cx, m * cy, m * cx * cx, m * cx * cy)]
    outside = [s.sum() - s for s in sums]
    lines = [affine_line_from_sums(*(s[f] for s in outside), center) if outside[0][f] >= 2 else (np.nan, np.nan) for f in range(k)]
    a, b = np.array(lines).T
    return a[folds] + b[folds] * x


def _isotonic_predictions(x: np.ndarray, y: np.ndarray, m: np.ndarray, folds: np.ndarray, k: int) -> np.ndarray:
    """Prediction of every unit by the isotonic fit outside its fold, NaN where there is none; ``x`` is sorted, so no fit sorts and units are looked up in order."""
    predicted, my = np.full(len(x), np.nan), m * y
    tied = bool((x[1:] == x[:-1]).any())
    for f in range(k):
        inside = folds == f
        held, train = np.flatnonzero(inside), np.flatnonzero(~inside)
        if len(held) and len(train):
            knots, mass, total = x[train], m[train], my[train]
            if tied:
                heads = np.flatnonzero(np.concatenate([[True], knots[1:] != knots[:-1]]))
                knots, mass, total = knots[heads], np.add.reduceat(mass, heads), np.add.reduceat(total, heads)
            predicted[held] = np.interp(x[held], knots, pool_sorted(mass, total))
    return predicted


def _l1_predictions(x: np.ndarray, y: np.ndarray, m: np.ndarray, folds: np.ndarray, k: int) -> np.ndarray:
    """Predictions (repeats x units) of the least-absolute-deviation lines outside each fold; small samples take many fits at once."""
    fits = [(r, f) for r in range(len(folds)) for f in range(k)]
    lines, batch = np.full((2, len(folds), k), np.nan), max(1, (FIT_CELLS if len(x) < LAD_BLOCKED else BLOCKED_CELLS) // max(1, len(x)))
    for start in range(0, len(fits), batch):
        part = fits[start : start + batch]
        weights = np.stack([np.where(folds[r] == f, 0.0, m) for r, f in part])
        enough = weights.sum(axis=1) >= 2
        if enough.any():
            rows, cols = np.array([p for p, e in zip(part, enough) if e]).T
            lines[:, rows, cols] = lad_lines(x, y, weights[enough])
    return np.stack([lines[0, r][folds[r]] + lines[1, r][folds[r]] * x for r in range(len(folds))])


SKILL_FIELDS = (
    T.StructField("repeat", T.IntegerType()), T.StructField("model_mae", T.DoubleType()), T.StructField("comparator_mae", T.DoubleType()),
    T.StructField("n_misplaced", T.LongType()),
)


def replicate_skills(
    placed: DataFrame, group_cols: Sequence[str], id_col: str, target: str, prediction: str, *, repeats: int, k: int, recalibrator: str | None, resamples: int, seed: int,
    mode: str = "multinomial", folds_col: str = "folds",
) -> DataFrame:
    """``(groups, replicate, repeat, model_mae, comparator_mae, n_misplaced)``: all medians and fits are taken anew in each replicate, outside each fold.

    Errors are null where a fold with units has nothing outside it to learn from. ``n_misplaced`` counts copies that are in more than one fold of a
    repeat or outside 0..k-1, over the folds of the copies as drawn; a sound result has none.
    """

    def prepare(table: pa.Table) -> PerReplicate:
        x, y, folds = _column(table, prediction), _column(table, target), _fold_matrix(table, folds_col, repeats)
        order = np.argsort(y, kind="stable")
        x, y, folds = x[order], y[order], folds[:, order]
        center = (float(x.mean()), float(y.mean()))
        deployed = np.abs(x - y)
        by_x = np.argsort(x, kind="stable") if recalibrator == "isotonic" else None

        def each(m: np.ndarray) -> list[tuple]:
            m = m[order]
            held = np.flatnonzero(m)
            rows, total = [], m.sum()
            my, mx, mm = y[held], x[held], m[held]
            lines = _l1_predictions(mx, my, mm, np.clip(folds[:, held], 0, k - 1), k) if recalibrator == "affine_L1" else None
            if by_x is not None:
                rising = by_x[m[by_x] > 0]
                rx, ry, rm = x[rising], y[rising], m[rising]
            for r in range(repeats):
                of = folds[r, held]
                stray = int(mm[(of < 0) | (of >= k)].sum())
                of = np.clip(of, 0, k - 1)
                sizes = np.bincount(of, weights=mm, minlength=k)
                # every copy is counted once over the folds
                stray += int(abs(sizes.sum() - total))
                medians = _outside_medians(my, mm, of, sizes)
                comparator = float(mm @ np.abs(medians[of] - my)) / total if total else math.nan
                if recalibrator is None:
                    model = float(mm @ deployed[held]) / total if total else math.nan
                elif by_x is not None:
                    fitted = _isotonic_predictions(rx, ry, rm, np.clip(folds[r, rising], 0, k - 1), k)
                    model = float(rm @ np.abs(fitted - ry)) / total if total else math.nan
                else:
                    fitted = lines[r] if lines is not None else _ols_predictions(mx, my, mm, of, k, center)
                    model = float(mm @ np.abs(fitted - my)) / total if total else math.nan
                sound = not (math.isnan(model) or math.isnan(comparator))
                rows.append((r, model if sound else None, comparator if sound else None, stray))
            return rows

        return each

    return over_replicates(
        placed, group_cols, id_col, [target, prediction, folds_col], prepare, SKILL_FIELDS, resamples=resamples, seed=seed, mode=mode
    )


RANK_FIELDS = (T.StructField("n", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("defined", T.BooleanType()))


def replicate_rank_correlations(
    placed: DataFrame, group_cols: Sequence[str], id_col: str, target: str, prediction: str, *, resamples: int, seed: int, mode: str = "multinomial"
) -> DataFrame:
    """``(groups, replicate, n, value, defined)``: Spearman's correlation with average-tie ranks of every replicate.

    Both columns are sorted once; a replicate's ranks are prefix sums of the multiplicities of the distinct values.
    """

    def prepare(table: pa.Table) -> PerReplicate:
        codes = [np.unique(_column(table, c), return_inverse=True)[1].ravel() for c in (target, prediction)]

        def each(m: np.ndarray) -> list[tuple]:
            total, ranks, varied = m.sum(), [], True
            for code in codes:
                mass = np.bincount(code, weights=m)
                varied &= np.count_nonzero(mass) > 1
                ranks.append((np.cumsum(mass) - mass + (mass + 1) / 2.0 - (total + 1) / 2.0)[code])
            sxx, syy = (m @ (r * r) for r in ranks)
            defined = bool(varied and sxx * syy > 0)
            return [(int(total), float(m @ (ranks[0] * ranks[1]) / math.sqrt(sxx * syy)) if defined else None, defined)]

        return each

    return over_replicates(placed, group_cols, id_col, [target, prediction], prepare, RANK_FIELDS, resamples=resamples, seed=seed, mode=mode)


def replicate_errors(
    placed: DataFrame, group_cols: Sequence[str], id_col: str, cell: str, error: str, *, resamples: int, seed: int, mode: str = "multinomial"
) -> DataFrame:
    """``(groups, replicate, cell, n, mae, bias)``: copies and mean absolute and mean error of each ``cell`` of a group, from sums over vectors of multiplicities.

    ``cell`` is a text column; cells without a copy in a replicate have no row. Null errors count as copies but add nothing, as in a sum; a cell with no other has null means.
    """

    def prepare(table: pa.Table) -> PerReplicate:
        cells = table.column(cell).combine_chunks().dictionary_encode(null_encoding="encode")
        names, code, known = cells.dictionary.to_pylist(), np.asarray(cells.indices), np.asarray(table.column(error).is_valid())
        e = np.where(known, _column(table, error), 0.0)
        size = np.abs(e)

        def each(m: np.ndarray) -> list[tuple]:
            total, valid, absolute, signed = (np.bincount(code, weights=v, minlength=len(names)) for v in (m, m * known, m * size, m * e))
            return [
                (name, int(n), *((float(a / n), float(s / n)) if some else (None, None)))
                for name, n, some, a, s in zip(names, total, valid, absolute, signed) if n
            ]

        return each

    fields = (T.StructField(cell, T.StringType()), T.StructField("n", T.LongType()), T.StructField("mae", T.DoubleType()), T.StructField("bias", T.DoubleType()))
    return over_replicates(placed, group_cols, id_col, [cell, error], prepare, fields, resamples=resamples, seed=seed, mode=mode)
