"""Distance of a unit to the training support: k nearest references and shrunk Mahalanobis."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.operators.contracts import assert_clean, count_reconcile, violation
from driftgauge.operators.models import standardization, standardized
from driftgauge.session import broadcast_bytes, collected, compute_tasks, cut_lineage, remove_path, scratch_path

# Rows of either side that are compared at a time.
REFERENCE_ROWS = 2_048
QUERY_ROWS = 256
# Reference rows of a cell, as far as the sample that cells are made from is large enough.
CELL_ROWS = 512
# Rows that are compared with all cells at a time.
ROUTED_ROWS = 256
# Broadcast limits of reference rows that are on the executors' disks at a time.
ROUND_LIMITS = 16


@dataclass(frozen=True)
class SourceSupport:
    """Standardised reference rows and the parameters that standardise further rows."""

    reference: DataFrame
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def vectors(self, df: DataFrame, id_col: str) -> DataFrame:
        z = standardized(df.select(id_col, *self.features), self.features, self.mean, self.scale)
        return z.select(id_col, F.array(*[F.col(f).cast("double") for f in self.features]).alias("vec"))


def fit_source_support(
    df: DataFrame, split_col: str, domain_col: str, reference_splits: Sequence[str], source_domain: str, features: Sequence[str],
    expected: DataFrame | None = None,
) -> SourceSupport:
    """Select the reference splits, require the source domain only (and expected counts), fit the scaling."""
    reference = df.where(F.col(split_col).isin(list(reference_splits)))
    foreign = reference.where(F.col(domain_col) != source_domain).groupBy(domain_col).agg(F.count(F.lit(1)).alias("n"))
    assert_clean(foreign.select(*violation("source_domain", F.col(domain_col), F.col("n"))))
    if expected is not None:
        wrong = count_reconcile(reference, [split_col], expected)
        assert_clean(wrong.select(*violation("reference_count", F.col(split_col), F.col("observed"))))
    mean, scale = standardization(reference, features)
    return SourceSupport(reference, tuple(features), tuple(mean), tuple(scale))


def _distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Euclidean distances by summing squared differences, one dimension at a time."""
    out = np.zeros((len(q), len(r)))
    for d in range(q.shape[1]):
        diff = q[:, d, None] - r[None, :, d]
        diff *= diff
        out += diff
    return np.sqrt(out, out=out)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def _bounded_squares(q: np.ndarray, r: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (row, col), by summing squared differences, in bounded memory."""
    out = np.empty(len(row))
    step = max(1, 1_000_000 // max(q.shape[1], 1))
    for at in range(0, len(row), step):
        diff = q[row[at : at + step]] - r[col[at : at + step]]
        out[at : at + step] = np.einsum("ij,ij->i", diff, diff)
    return out


class _Screen:
    """Rows and a single-precision form of them, whose products with others tell squared distances to within ``slack``."""

    def __init__(self, rows: np.ndarray, centre: np.ndarray) -> None:
        self.rows = rows
        moved = rows - centre
        self.squares = np.einsum("ij,ij->i", moved, moved)
        with np.errstate(over="ignore", invalid="ignore"):
            self.single = moved.astype(np.float32)
            self.halves = (self.squares / 2).astype(np.float32)


def _improve(best: np.ndarray, q: _Screen, who: np.ndarray, r: _Screen, start: int, stop: int) -> None:
    """Merge the squared distances of queries ``who`` to the rows ``start`` to ``stop`` into ``best``, the k smallest of each query in rising order.

    A product in single precision rules out the rows that are beyond the k-th distance known, its error included; the others are computed in full.
    """
    rows, k = r.rows[start:stop], best.shape[1]
    own, most = q.squares[who], r.squares[start:stop].max()
    bound = best[who, -1]
    if not own.max() + most < 1e37:  # beyond single precision, or not a number
        row, col = (x.ravel() for x in np.indices((len(who), len(rows))))
    else:
        # half of (squared norm of the query - squared distance): greater is nearer
        near = q.single[who] @ r.single[start:stop].T
        near -= r.halves[start:stop]
        open_, wide = np.isinf(bound), k + 16
        if open_.any() and len(rows) > wide:
            some = np.argpartition(near[open_], len(rows) - wide, axis=1)[:, -wide:]
            exact = _bounded_squares(q.rows[who[open_]], rows, np.repeat(np.arange(len(some)), wide), some.ravel())
            bound[open_] = np.partition(exact.reshape(-1, wide), k - 1, axis=1)[:, k - 1]
        slack = (q.rows.shape[1] + 8) * 2.0**-22 * (own + most)
        with np.errstate(over="ignore"):
            least = np.nextafter(((own - bound - slack) / 2).astype(np.float32), np.float32(-np.inf))
        row, col = np.nonzero(~(near < least[:, None]))
    exact = _bounded_squares(q.rows[who], rows, row, col)
    better = ~(exact >= best[who[row], -1])
    row, exact = row[better], exact[better]
    if not len(row):
        return
    order = np.lexsort((exact, row))
    row, exact = row[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, exact, rank = (x[rank < k] for x in (row, exact, rank))
    hit, at = np.unique(row, return_inverse=True)
    both = np.full((len(hit), 2 * k), np.inf)
    both[:, :k] = best[who[hit]]
    both[at, k + rank] = exact
    both.sort(axis=1)
    best[who[hit]] = both[:, :k]


def _rooted(best: np.ndarray) -> np.ndarray:
    """Distances from their squares; what no number was found for is not a number."""
    return np.sqrt(np.where(np.isinf(best), np.nan, best))


def _nearest(q: np.ndarray, r: np.ndarray, k: int, cells: int = 1 << 19) -> np.ndarray:
    """The min(k, |r|) smallest distances of every query in rising order, by tables of at most ``cells`` distances."""
    centre = r[:1000].mean(axis=0)
    rows, asked = _Screen(r, centre), _Screen(q, centre)
    best = np.full((len(q), min(k, len(r))), np.inf)
    step = max(1, min(QUERY_ROWS, cells // REFERENCE_ROWS))
    for first in range(0, len(q), step):
        who = np.arange(first, min(first + step, len(q)))
        for start in range(0, len(r), REFERENCE_ROWS):
            _improve(best, asked, who, rows, start, min(start + REFERENCE_ROWS, len(r)))
    return _rooted(best)


def nearest_distances(queries: DataFrame, reference: DataFrame, id_col: str, k: int, *, vec: str = "vec", broadcast_limit: int | None = None) -> DataFrame:
    """``(id, distances)``: the k smallest Euclidean distances to the reference, exact.

    The reference is measured first. If it fits the broadcast limit every task scans
    it; otherwise both sides are ordered by the cells of a tree and cells are ruled out.
    """
    limit = broadcast_bytes(queries.sparkSession) if broadcast_limit is None else broadcast_limit
    size = reference.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    if not size["n"] or size["n"] < k:
        raise ValueError("largest k exceeds the number of reference rows")
    if size["n"] * size["d"] * 8 <= limit:
        return _nearest_broadcast(queries, reference, id_col, k, vec)
    return _nearest_partitioned(queries, reference, id_col, k, vec, int(size["n"]))


def _out_schema(queries: DataFrame, id_col: str) -> T.StructType:
    return T.StructType([queries.schema[id_col], T.StructField("distances", T.ArrayType(T.DoubleType()))])


def _nearest_broadcast(queries: DataFrame, reference: DataFrame, id_col: str, k: int, vec: str) -> DataFrame:
    rows = _matrix(reference.select(F.col(vec).cast("array<double>").alias("v")).toPandas()["v"])
    shared = queries.sparkSession.sparkContext.broadcast(rows)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({id_col: batch[id_col], "distances": list(_nearest(_matrix(batch[vec]), shared.value, k))})

    spread = queries.select(id_col, vec).repartition(compute_tasks(queries.sparkSession), id_col)
    return spread.mapInPandas(scan, _out_schema(queries, id_col))


class _Tree:
    """Halves space at medians of sampled rows; leaves are numbered so that neighbours in number are neighbours in space."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        axis, cut, kids, leaf = [], [], [], []
        self.depth = self.n = 0

        def grow(part: np.ndarray, budget: int, depth: int) -> int:
            node = len(axis)
            axis.append(0), cut.append(np.nan), kids.append((node, node)), leaf.append(-1)
            self.depth = max(self.depth, depth)
            if budget > 1 and len(part) > 1:
                spread = np.nan_to_num(part.var(axis=0), nan=-1.0, posinf=-1.0)
                for a in np.argsort(-spread, kind="stable"):
                    at = np.median(part[:, a])
                    low = part[:, a] < at
                    if low.any():
                        axis[node], cut[node] = int(a), float(at)
                        kids[node] = grow(part[low], budget // 2, depth + 1), grow(part[~low], budget - budget // 2, depth + 1)
                        return node
            leaf[node], self.n = self.n, self.n + 1
            return node

        grow(points, leaves, 0)
        self.axis, self.cut, self.kids, self.leaf = np.array(axis), np.array(cut), np.array(kids), np.array(leaf)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = self.kids[node, np.where(x[every, self.axis[node]] < self.cut[node], 0, 1)]
        return self.leaf[node]


class CellDirectory:
    """Reference rows in cells of a tree, and what is known of each cell: size, least and greatest value of every component."""

    def __init__(self, reference: DataFrame, id_col: str, vec: str, n: int) -> None:
        spark = reference.sparkSession
        self.reference, self.vec = reference.select(F.col(vec).cast("array<double>").alias(vec)), vec
        self.dims = reference.agg(F.max(F.size(vec))).first()[0]
        sampled = max(64, broadcast_bytes(spark) // (32 * self.dims))
        # the sample only says where cells end; all rows are searched
        sample = self.reference if n <= sampled else self.reference.where(F.rand(7) < sampled / n).limit(2 * sampled)
        points = _matrix(sample.toPandas()[vec])
        self.centre = points.mean(axis=0) if len(points) else np.zeros(self.dims)
        self.tree = _Tree(points, max(1, min(max(n // CELL_ROWS, math.isqrt(n)), sampled // 8)))
        shared = spark.sparkContext.broadcast(self.tree)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"cell": shared.value.leaf_of(_matrix(batch[vec])), vec: batch[vec]})

        rows = self.reference.mapInPandas(assign, f"cell int, {vec} array<double>")
        ends = lambda f: F.array(*[f(F.get(vec, F.lit(i))) for i in range(self.dims)])
        found = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), ends(F.min).alias("low"), ends(F.max).alias("high")).orderBy("cell").toPandas()
        self.cell, self.n = found["cell"].to_numpy(), found["n"].to_numpy()
        self.low, self.high = _matrix(found["low"]), _matrix(found["high"])

    def home(self, q: np.ndarray) -> np.ndarray:
        """The place among the cells with rows of the cell that a query lies in, or else of the next one in number."""
        return np.minimum(np.searchsorted(self.cell, self.tree.leaf_of(q)), len(self.cell) - 1)

    def least_squares(self, q: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances of every query to any row of ``some`` cells: those to the box around its rows."""
        return _box_squares(q, q, self.low[some], self.high[some])


def _box_squares(q_low: np.ndarray, q_high: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances between boxes, one dimension at a time."""
    out = np.zeros((len(q_low), len(low)))
    for d in range(q_low.shape[1]):
        gap = np.maximum(low[None, :, d] - q_high[:, d, None], q_low[:, d, None] - high[None, :, d])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        out += gap
    return out


def _within(least: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether squared distances of at least ``least`` may be below ``known``; the slack keeps rounding from dropping a cell on the boundary."""
    return ~(least > known * (1 + 1e-9) + 1e-300)


def routed_queries(queries: DataFrame, directory: CellDirectory, id_col: str, vec: str, own: bool) -> DataFrame:
    """``(id, vec, cell)``: with ``own`` the cell the query lies in, else all others that can hold a row within the query's ``known`` distance (null: any)."""
    shared = queries.sparkSession.sparkContext.broadcast(_shipped(directory))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        it = shared.value
        every = np.arange(len(it.cell))
        for batch in batches:
            for start in range(0, len(batch), ROUTED_ROWS):
                part = batch.iloc[start : start + ROUTED_ROWS]
                q = _matrix(part[vec])
                home = it.home(q)
                if own:
                    row, col = np.arange(len(part)), home
                else:
                    known = part["known"].to_numpy(dtype=np.float64, na_value=np.inf)
                    wanted = _within(it.least_squares(q, every), known[:, None] ** 2)
                    wanted[np.arange(len(part)), home] = False
                    row, col = np.nonzero(wanted)
                yield pd.DataFrame({id_col: part[id_col].to_numpy()[row], vec: part[vec].to_numpy()[row], "cell": it.cell[col]})

    schema = T.StructType([queries.schema[id_col], T.StructField(vec, T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])
    return queries.mapInPandas(route, schema)


def _shipped(directory: CellDirectory) -> CellDirectory:
    """What tasks need of a directory."""
    it = object.__new__(CellDirectory)
    it.tree, it.cell, it.n, it.low, it.high, it.centre, it.dims = (getattr(directory, a) for a in ("tree", "cell", "n", "low", "high", "centre", "dims"))
    return it


class _Packs:
    """The reference in packs of neighbouring cells, as files of the shared folder. Each is a matrix; ``cell`` and ``end`` of its pieces say which rows lie in which cell."""

    def __init__(self, directory: CellDirectory, vec: str) -> None:
        self.spark = directory.reference.sparkSession
        pieces = np.ceil(directory.n / REFERENCE_ROWS).astype(np.int64)  # a hot cell has several
        first = np.concatenate([[0], np.cumsum(pieces)])
        of_piece = np.repeat(np.arange(len(pieces)), pieces)
        before = np.cumsum(directory.n[of_piece] / pieces[of_piece]) - 1
        of_pack = (before * directory.dims * 8 // max(1, broadcast_bytes(self.spark) // 2)).astype(np.int64)
        # the pack that the first piece of each cell is in, counted without gaps
        of_pack = np.unique(of_pack, return_inverse=True)[1]
        self.own, self.n = of_pack[first[:-1]], int(of_pack.max()) + 1
        self.bytes = int(directory.n.sum()) * directory.dims * 8
        shared = self.spark.sparkContext.broadcast((_shipped(directory), pieces, first, of_pack))

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            it, pieces, first, pack_of = shared.value
            seen = 0
            for batch in batches:
                if len(batch):
                    home = it.home(_matrix(batch[vec]))
                    piece = first[home] + (seen + np.arange(len(batch))) % pieces[home]
                    seen += len(batch)
                    yield pd.DataFrame({"pack": pack_of[piece], "piece": piece, vec: batch[vec]})

        def packed(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("piece", kind="stable")
            piece, n = np.unique(rows["piece"].to_numpy(), return_counts=True)
            columns = {"pieces": [piece.astype("<i8").tobytes()], "ends": [np.cumsum(n).astype("<i8").tobytes()], "matrix": [_matrix(rows[vec]).astype("<f8").tobytes()]}
            return pd.DataFrame({"pack": rows["pack"].iloc[:1].to_numpy(), **columns})

        self.of_piece, self.path = of_piece, scratch_path(self.spark, "reference-packs")
        self.dims, self.schema = directory.dims, "pieces binary, ends binary, matrix binary, pack int"
        dealt = directory.reference.mapInPandas(deal, f"pack int, piece bigint, {vec} array<double>")
        done = dealt.groupBy("pack").applyInPandas(packed, "pack int, pieces binary, ends binary, matrix binary")
        done.write.partitionBy("pack").parquet(self.path)

    def shared(self, pack: int):
        """A broadcast of one pack: the matrix, and the cell (its place in the directory) and end of every piece."""
        row = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("pack") == pack).first()
        cell = self.of_piece[np.frombuffer(row["pieces"], dtype="<i8")]
        return self.spark.sparkContext.broadcast((np.frombuffer(row["matrix"], dtype="<f8").reshape(-1, self.dims), cell, np.frombuffer(row["ends"], dtype="<i8")))


def _loaded(shared):
    """The value of a broadcast, which is not kept in memory: a task needs one after the other."""
    value = shared.value
    if getattr(shared, "_path", None):
        shared.__dict__.pop("_value", None)
    return value


def _search_pack(best: np.ndarray, q: _Screen, it: CellDirectory, pack: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Improve ``best`` by the rows of a pack. Queries that follow each other are neighbours: cells beyond all of them are ruled out together."""
    matrix, cell, end = pack
    r, start = _Screen(matrix, it.centre), np.concatenate([[0], end[:-1]])
    for first in range(0, len(q.rows), QUERY_ROWS):
        who = np.arange(first, min(first + QUERY_ROWS, len(q.rows)))
        block = q.rows[who]
        far = _box_squares(block.min(axis=0)[None], block.max(axis=0)[None], it.low[cell], it.high[cell])[0]
        some = np.flatnonzero(_within(far, best[who, -1].max()))
        least = it.least_squares(block, cell[some])
        for j in np.argsort(least.min(axis=0), kind="stable"):
            asked = who[_within(least[:, j], best[who, -1])]
            if len(asked):
                _improve(best, q, asked, r, start[some[j]], end[some[j]])


def _nearest_partitioned(queries: DataFrame, reference: DataFrame, id_col: str, k: int, vec: str, n: int) -> DataFrame:
    """Queries, ordered by cell, meet the reference pack by pack, their own first; the k-th distance found so far says which cells can hold a nearer row.

    Neither side is copied by a shuffle: packs are broadcast, up to ``ROUND_LIMITS`` times the broadcast limit of them at a time, and a task holds one.
    Beyond that the k smallest distances of each query are written and taken up by the next round.
    """
    spark = queries.sparkSession
    collected(spark)  # the inputs may have left shuffle files
    directory = CellDirectory(reference, id_col, vec, n)
    packs = _Packs(directory, vec)
    limit = broadcast_bytes(spark)
    rounds = min(packs.n, max(1, math.ceil(packs.bytes / (ROUND_LIMITS * limit))))
    known = spark.sparkContext.broadcast((_shipped(directory), packs.own))
    held = max(QUERY_ROWS, limit // (8 * (directory.dims + k)))

    slim = queries.select(id_col, F.col(vec).cast("array<double>").alias(vec))
    state = routed_queries(slim, directory, id_col, vec, True)
    # the hash cuts a cell that many queries lie in
    state = state.repartitionByRange(compute_tasks(spark), "cell", F.xxhash64(id_col)).sortWithinPartitions("cell")
    schema = T.StructType([*state.schema.fields, T.StructField("best", T.ArrayType(T.DoubleType()))])
    for some in np.array_split(np.arange(packs.n), rounds):
        shared = {int(p): packs.shared(int(p)) for p in some}

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            it, pack_of = known.value

            def done(parts: list[tuple]) -> pd.DataFrame:
                ids, cells, matrix, best = (np.concatenate(p) for p in zip(*parts))
                q = _Screen(matrix, it.centre)
                own = pack_of[np.searchsorted(it.cell, cells[len(cells) // 2])]
                for p in sorted(shared, key=lambda p: abs(p - own)):
                    _search_pack(best, q, it, _loaded(shared[p]))
                return pd.DataFrame({id_col: ids, vec: list(matrix), "cell": cells, "best": list(best)})

            parts, rows = [], 0
            for batch in batches:
                if len(batch):
                    best = _matrix(batch["best"]) if "best" in batch else np.full((len(batch), k), np.inf)
                    parts.append((batch[id_col].to_numpy(), batch["cell"].to_numpy(), _matrix(batch[vec]), best))
                    rows += len(batch)
                if rows >= held:
                    yield done(parts)
                    parts, rows = [], 0
            if parts:
                yield done(parts)

        state = state.mapInPandas(search, schema)
        state = cut_lineage(state.select(id_col, "best") if some[-1] == packs.n - 1 else state)
        for one in shared.values():
            one.destroy()
        collected(spark)
    remove_path(spark, packs.path)
    root = F.transform("best", lambda x: F.when(x == float("inf"), F.lit(float("nan"))).otherwise(F.sqrt(x)))
    return state.select(id_col, root.alias("distances"))


def mean_distances(nearest: DataFrame, id_col: str, ks: Sequence[int]) -> DataFrame:
    """Mean distance to the k nearest for every k, from one search at the largest k."""
    def mean(k: int) -> Column:
        return F.aggregate(F.slice("distances", 1, k), F.lit(0.0), lambda a, v: a + v) / F.lit(float(k))

    return nearest.select(id_col, *[mean(k).alias(f"support_knn_k{k}") for k in ks])


@dataclass(frozen=True)
class ShrunkCovariance:
    """Location, shrinkage and precision of a Ledoit-Wolf estimate."""

    location: np.ndarray
    shrinkage: float
    precision: np.ndarray


def ledoit_wolf(vectors: DataFrame, vec: str = "vec") -> ShrunkCovariance:
    """Shrunk covariance from additive moments: mean first, then Gram matrix and sum of fourth powers of norms."""
    mean_row = vectors.select(F.posexplode(vec).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).orderBy("pos").collect()
    location = np.asarray([row["m"] for row in mean_row])
    p = len(location)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, fourth, n = np.zeros((p, p)), 0.0, 0
        for batch in batches:
            if len(batch):
                x = _matrix(batch[vec]) - location
                gram += x.T @ x
                fourth += float((np.einsum("ij,ij->i", x, x) ** 2).sum())
                n += len(x)
        yield pd.DataFrame({"moments": [np.concatenate([gram.ravel(), [fourth, n]])]})

    parts = vectors.select(vec).mapInPandas(partial, "moments array<double>")
    sums = parts.select(F.posexplode("moments").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).orderBy("pos").collect()
    flat = np.asarray([row["v"] for row in sums])
    n, fourth, s = flat[-1], flat[-2], flat[:-2].reshape(p, p) / flat[-1]
    mu = np.trace(s) / p
    frobenius = float((s * s).sum())
    delta = (frobenius - p * mu * mu) / p
    beta = min(delta, (fourth / n - frobenius) / (p * n))
    shrinkage = beta / delta if beta > 0 else 0.0
    covariance = (1 - shrinkage) * s + shrinkage * mu * np.eye(p)
    return ShrunkCovariance(location, float(shrinkage), np.linalg.pinv(covariance, hermitian=True))


def mahalanobis(vectors: DataFrame, fitted: ShrunkCovariance, id_col: str, vec: str = "vec") -> DataFrame:
    """Squared Mahalanobis distance of every row; vectorised per batch, no shuffle."""
    location, precision = fitted.location, fitted.precision

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch[vec]) - location
                yield pd.DataFrame({id_col: batch[id_col], "support_mahalanobis": np.einsum("ij,jk,ik->i", x, precision, x)})

    schema = T.StructType([vectors.schema[id_col], T.StructField("support_mahalanobis", T.DoubleType())])
    return vectors.select(id_col, vec).mapInPandas(score, schema)


def support_scores(
    df: DataFrame, fitted: SourceSupport, id_col: str, split_col: str, domain_col: str, evaluation_splits: Sequence[str], ks: Sequence[int],
) -> DataFrame:
    """Scores of the held-out rows, sorted by split and id."""
    held = df.where(F.col(split_col).isin(list(evaluation_splits)))
    vectors = fitted.vectors(held, id_col)
    reference = fitted.vectors(fitted.reference, id_col)
    near = mean_distances(nearest_distances(vectors, reference, id_col, max(ks)), id_col, ks)
    shrunk = mahalanobis(vectors, ledoit_wolf(reference), id_col)
    return held.select(id_col, domain_col, split_col).join(near, id_col).join(shrunk, id_col).orderBy(split_col, id_col)


def score_violations(scores: DataFrame, id_col: str, split_col: str, evaluation_splits: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Scores must be finite and not negative, ids unique, splits held out."""
    columns = [c for c in scores.columns if c.startswith("support_")]
    bad = F.lit(False)
    for c in columns:
        floor = -tolerance if c == "support_mahalanobis" else 0.0
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | (F.col(c) < floor)
    repeated = scores.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        scores.where(bad).select(*violation("score", F.col(id_col), F.lit("not finite or negative")))
        .unionByName(repeated.select(*violation("unique_key", F.col(id_col), F.col("n"))))
        .unionByName(
            scores.where(~F.col(split_col).isin(list(evaluation_splits))).select(*violation("split", F.col(id_col), F.col(split_col)))
        )
    )
