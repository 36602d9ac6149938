"""Searches over integer vectors in blocks: what exact top-k search and hard-negative mining share.

Rows lie in blocks of about equal size, sorted so that neighbours are alike. Each asking row first looks through its own block, which bounds what it
still needs, and then meets those blocks whose summary does not rule them out. Asking rows and blocks meet in cells of bounded size.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftgauge.llm.storage import stored
from driftgauge.session import compute_tasks

# Components beyond this size take no part, as scores could leave the range of a long.
LARGEST = 1 << 28
BLOCK_ROWS, MOST_BLOCKS, CELL_ROWS, CELL_ASKS = 4096, 1 << 16, 1 << 16, 1024
Cell = Callable[[pa.Table, pa.Table], pa.Table]


def integer_vectors(column: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component, or null where the row takes no part."""
    vector = F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    return F.when(finite & usable, F.transform(vector, lambda x: x.cast("int")))


def padded(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows(v, ...)`` with vectors of one length, by zeros at the end, and that length."""
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(most) - F.size("v"))))
    return rows, most or 0


def matrix(table: pa.Table | pa.RecordBatch, name: str, width: int, kind: type = np.float64) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    column = table.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), width).astype(kind, copy=False)


def exact(asks: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in a type in which their inner products are exact: doubles while every sum is below 2^53, else 64-bit integers."""
    top = float(np.abs(asks).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(asks.shape[1], 1)
    kind = np.float64 if top < 2**53 else np.int64
    return asks.astype(kind, copy=False), rows.astype(kind, copy=False)


def in_blocks(rows: DataFrame, total: int, order: list[Column], name: str) -> DataFrame:
    """``rows`` cut by ranges of ``order`` into blocks, written as Parquet with a folder a block, plus ``block`` and the number ``row``."""
    count = max(1, min(MOST_BLOCKS, math.ceil(total / BLOCK_ROWS)))
    ranged = rows.repartitionByRange(count, *order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.spark_partition_id()), name, "block")


def zones(rows: DataFrame, column: str, width: int) -> DataFrame:
    """(block, n, lo, hi): rows of each block and, per dimension of ``column``, their least and greatest value."""

    def summary(block: int, n: int, lo: np.ndarray, hi: np.ndarray) -> dict:
        return {"block": block, "n": n, "lo": lo.tolist(), "hi": hi.tolist()}

    kind = pa.schema([("block", pa.int32()), ("n", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, values = np.asarray(batch.column("block")), matrix(batch, column, width)
            out = [summary(int(b), len(v), v.min(axis=0), v.max(axis=0)) for b in np.unique(blocks) for v in [values[blocks == b]]]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    def whole(table: pa.Table) -> pa.Table:
        lo, hi = matrix(table, "lo", width).min(axis=0), matrix(table, "hi", width).max(axis=0)
        return pa.Table.from_pylist([summary(table.column("block")[0].as_py(), sum(table.column("n").to_pylist()), lo, hi)], schema=kind)

    text = "block int, n bigint, lo array<double>, hi array<double>"
    return rows.select("block", column).mapInArrow(part, text).groupBy("block").applyInArrow(whole, text)


class ZoneMap:
    """The summaries of all blocks, at most ``MOST_BLOCKS``, for the tasks that choose blocks."""

    def __init__(self, table: DataFrame, width: int) -> None:
        held = table.toArrow().sort_by("block")
        self.block = np.asarray(held.column("block").combine_chunks())
        self.n = np.asarray(held.column("n").combine_chunks())
        self.lo, self.hi = matrix(held, "lo", width), matrix(held, "hi", width)

    def ranges(self, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each ask with any vector in each block, by interval arithmetic."""
        plus, minus = np.maximum(asks, 0), np.minimum(asks, 0)
        return plus @ self.lo.T + minus @ self.hi.T, plus @ self.hi.T + minus @ self.lo.T


def choose(asks: DataFrame, zone_map: ZoneMap, wanted: Callable[[ZoneMap, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """``asks`` once for each block that is ``wanted`` (a matrix of asks by blocks), but not its own; ``block`` is set to it."""
    shared = asks.sparkSession.sparkContext.broadcast(zone_map)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                hits = wanted(known, batch) & (known.block[None, :] != np.asarray(batch.column("block"))[:, None])
                lists = [known.block[h] for h in hits]
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "visits"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asks.schema) + ", visits array<int>"
    return asks.mapInArrow(run, fields).withColumn("block", F.explode("visits")).drop("visits")


def meet(asks: DataFrame, rows: DataFrame, zone_map: ZoneMap, cell: Cell, schema: str) -> DataFrame:
    """``cell(asks, rows)`` for the asks and rows of each block, in cells of bounded size.

    The asks of a block are dealt by their numbers to groups of some ``CELL_ASKS``, and large blocks to slices of some ``CELL_ROWS``; each group meets each slice.
    """
    most = asks.groupBy("block").count().agg(F.max("count"), F.count("*")).first()
    groups = max(1, math.ceil((most[0] or 0) / CELL_ASKS))
    slices = max(1, math.ceil(int(zone_map.n.max(initial=1)) / CELL_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    tasks = max(compute_tasks(asks.sparkSession), min(20_000, groups * slices * (most[1] or 1)))
    keys = ["block", "group", "slice"]
    left = asks.withColumn("group", dealt(groups)).withColumn("slice", every(slices))
    # asks may come from the table of rows: new names tell their columns apart
    left = left.select(*(F.col(c).alias(f"ask_{c}") for c in left.columns)).toDF(*left.columns).repartition(tasks, *keys)
    met = rows.join(F.broadcast(asks.select("block").distinct()), "block", "left_semi")  # at most MOST_BLOCKS numbers
    right = met.withColumn("slice", dealt(slices)).withColumn("group", every(groups)).repartition(tasks, *keys)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return cell(a, b)
        return cell(a.slice(0, 0), b.slice(0, 0))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of ``found(keys, vec_id, score)``: higher scores first, ties by smaller vec_id (null last), with their ``rank``."""
    ordered = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)


def first_k(score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k``: higher scores first, ties by smaller ``vec_id``."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
        return near[np.lexsort((vec_id[near], -score[near]))[:k]]
    return np.lexsort((vec_id, -score))[:k]


def ids(table: pa.Table) -> np.ndarray:
    """``vec_id`` with null as the largest number, for ties."""
    column = table.column("vec_id").combine_chunks()
    return np.asarray(column.fill_null(np.iinfo(np.int64).max))


def id_array(values: list[np.ndarray], nulls: list[np.ndarray]) -> pa.Array:
    value, null = (np.concatenate([*v, np.zeros(0, kind)]) for v, kind in ((values, np.int64), (nulls, bool)))
    return pa.array(value.astype(np.int64), mask=null.astype(bool))
