"""Exact top-k search by inner product with a pivot table.

Every vector keeps its distances to a few dozen pivots, computed once. For an ask ``q`` and a row ``x`` the triangle inequality gives
``|d(q, p) - d(x, p)| <= d(q, x)`` for each pivot; the greatest of these lower bounds ``L`` bounds the score from above, as
``q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 <= (|q|^2 + |x|^2 - L^2) / 2``. Rows are evaluated in the order of that bound, and the search of a
cell stops when the next bound is below the k-th score found. Blocks of rows are ruled out as a whole by the range of their distances.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.storage import stored
from driftgauge.llm.vectors import ZoneMap, best, choose, exact, first_k, id_array, ids, in_blocks, integer_vectors, matrix, meet, padded, zones

PIVOTS, SAMPLE = 32, 4096
FOUND = "ask bigint, ask_id bigint, vec_id bigint, score bigint"


def pick_pivots(rows: DataFrame, total: int, width: int, count: int, sample: int) -> np.ndarray:
    """``count`` vectors far from each other, from some ``sample`` rows drawn by a hash of the vector (a documented bound; 2 x ``sample`` at most)."""
    drawn = rows.where(F.pmod(F.xxhash64("v"), F.lit(max(1, total // sample))) == 0).select("v").distinct().limit(2 * sample)
    points = matrix(drawn.toArrow(), "v", width)
    if not len(points):
        points = np.zeros((1, width))
    points = points[np.lexsort(points.T[::-1])] if width else points
    chosen = [points[np.argmax((points**2).sum(axis=1))]]
    apart = np.full(len(points), np.inf)
    while len(chosen) < count:
        apart = np.minimum(apart, ((points - chosen[-1]) ** 2).sum(axis=1))
        chosen.append(points[np.argmax(apart)])
    return np.array(chosen)


def with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows(vec_id, v)`` with the squared norm, the distances ``far`` to the pivots, and the nearest pivot and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (pivots**2).sum(axis=1)
        for batch in batches:
            v = matrix(batch, "v", pivots.shape[1])
            norm = (v**2).sum(axis=1)
            far = np.sqrt(np.maximum(norm[:, None] + squares[None, :] - 2 * v @ pivots.T, 0))
            near = far.argmin(axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), len(pivots)).cast(pa.list_(pa.float64()))
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(norm), lists, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(v)), near])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "norm", "far", "near", "near_far"])

    return rows.mapInArrow(run, "vec_id bigint, v array<int>, norm double, far array<double>, near int, near_far double")


def _above(norms: np.ndarray, apart: np.ndarray, longest: float) -> np.ndarray:
    """Upper bounds of scores; widened by far more than the rounding of distances to the pivots (at most some 2^-22 of them)."""
    apart = np.maximum(apart - 4e-6 * (apart + np.sqrt(norms) + longest), 0)
    return (norms - apart**2) / 2 + 1e-9 * norms + 0.5


def _cell(width: int, count: int, k: int, longest: float):
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        asks, rows = exact(matrix(a, "v", width), matrix(b, "v", width))
        ask_far, row_far = matrix(a, "far", count, np.float32), np.ascontiguousarray(matrix(b, "far", count, np.float32).T)
        ask_norm, row_norm = np.asarray(a.column("norm")), np.asarray(b.column("norm"))
        ask_row, row_row, tie = np.asarray(a.column("row")), np.asarray(b.column("row")), ids(b)
        unknown = np.asarray(b.column("vec_id").is_null())
        least = np.asarray(a.column("least"))
        out_ask, out_id, out_null, out_score = [], [], [], []
        apart, gap = np.zeros(len(rows), np.float32), np.zeros(len(rows), np.float32)
        for i in range(len(asks)):
            apart[:] = 0
            for p in range(count):
                np.subtract(row_far[p], ask_far[i, p], out=gap)
                np.abs(gap, out=gap)
                np.maximum(apart, gap, out=apart)
            bound = _above(ask_norm[i] + row_norm, apart.astype(np.float64), longest)
            kth, size = least[i], 4 * k
            open_ = np.flatnonzero((bound >= kth) & (row_row != ask_row[i]))
            got, got_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
            # rows with the highest bounds first, until the best bound left is below the k-th score
            while len(open_):
                ahead = np.argpartition(-bound[open_], size) if len(open_) > size else np.arange(len(open_))
                part, rest = open_[ahead[:size]], open_[ahead[size:]]
                value = (rows @ asks[i])[part] if 4 * len(part) > len(rows) else rows[part] @ asks[i]
                got, got_score = np.concatenate([got, part]), np.concatenate([got_score, value.astype(np.int64)])
                keep = first_k(got_score, tie[got], k)
                got, got_score = got[keep], got_score[keep]
                if len(got) == k:
                    kth = max(kth, float(got_score[-1]))
                open_, size = rest[bound[rest] >= kth], 16 * size
            out_ask.append(np.full(len(got), i))
            out_id.append(tie[got])
            out_null.append(unknown[got])
            out_score.append(got_score)
        at = np.concatenate([*out_ask, np.zeros(0, np.int64)]).astype(np.int64)
        return pa.table({
            "ask": pa.array(ask_row[at]), "ask_id": a.column("vec_id").combine_chunks().take(pa.array(at)), "vec_id": id_array(out_id, out_null),
            "score": pa.array(np.concatenate([*out_score, np.zeros(0, np.int64)]).astype(np.int64)),
        })

    return run


def top_k(
    embeddings: DataFrame, asking: Column, k: int = 20, scale: int = 64, pivots: int = PIVOTS, sample: int = SAMPLE, vector_column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each row for which ``asking`` (a condition on ``vec_id``) holds, against all other rows.

    Components are ``floor(scale * x)``; the score is the integer inner product. Higher scores come first, ties by smaller vec_id. With fewer than ``k``
    other rows all are returned.

    Null vectors and vectors with null, non-finite or (2^28 or more after scaling) overlarge components take no part; shorter vectors are filled up with zeros.
    A repeated row is a candidate, and an ask, of its own. A null vec_id ranks last among ties. An empty table gives no rows. Other columns are not read.
    """
    base = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), integer_vectors(vector_column, scale).alias("v")).where("v is not null")
    base, width = padded(stored(base, "search-vectors"))
    total = base.count()
    chosen = pick_pivots(base, total, width, pivots, sample)
    rows = in_blocks(with_pivots(base, chosen), total, [F.col("near"), F.col("near_far"), F.col("vec_id")], "pivot-table")
    # the squared norm is one more dimension of the zones
    summary = ZoneMap(zones(rows.select("block", F.concat("far", F.array("norm")).alias("far")), "far", pivots + 1), pivots + 1)
    asks = rows.where(asking).select("block", "row", "vec_id", "v", "norm", "far", F.lit(float("-inf")).alias("least"))
    rows = rows.select("block", "row", "vec_id", "v", "norm", "far")
    # no distance to a pivot is longer than the norms of both together
    longest = float(np.sqrt((chosen**2).sum(axis=1)).max())
    cell = _cell(width, pivots, k, longest)
    home = stored(meet(asks, rows, summary, cell, FOUND), "search-home")
    known = home.groupBy("ask").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
    known = asks.join(known, asks["row"] == known["ask"], "left").withColumn("least", F.coalesce("kth", "least")).drop("ask", "kth")

    def wanted(zone_map: ZoneMap, batch: pa.RecordBatch) -> np.ndarray:
        far = matrix(batch, "far", pivots)
        apart = np.zeros((len(far), len(zone_map.block)))
        for p in range(pivots):
            np.maximum(apart, zone_map.lo[None, :, p] - far[:, p, None], out=apart)
            np.maximum(apart, far[:, p, None] - zone_map.hi[None, :, p], out=apart)
        # a nearer row of smaller norm is bounded too, as the bound grows with the norm
        norms = np.asarray(batch.column("norm"))[:, None] + zone_map.hi[None, :, pivots]
        return _above(norms, apart, longest) >= np.asarray(batch.column("least"))[:, None]

    visits = stored(choose(known, summary, wanted), "search-visits")
    found = home.unionByName(meet(visits, rows, summary, cell, FOUND))
    return best(found, ["ask"], k).select(F.col("ask_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
