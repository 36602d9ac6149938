"""Exact ranks, quantiles and orderings that never put an unbounded group into one task.

Each operator has two forms with identical results. While every group is at most
``driftgauge.task.rows`` rows, one window or one built-in aggregate per group is the
cheapest plan. Beyond that, values are pre-aggregated to distinct values, range
partitioned, and a prefix sum over the (few) partition totals turns positions inside
a partition into positions inside the group. The size is measured, never assumed.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.functions import hash60
from driftgauge.session import bounded_broadcast, broadcast_bytes, cut_lineage, task_rows

BLOCK = "__block"


def largest_group(df: DataFrame, group_cols: Sequence[str]) -> int:
    """Rows in the largest group; one map-side-combined count."""
    counts = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"))
    return int(counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"])


def group_sizes(df: DataFrame, group_cols: Sequence[str], limit: int = 1000) -> dict[tuple, int] | None:
    """Rows per group, or None when there are more groups than a literal lookup should hold."""
    rows = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n")).limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return {tuple(row[c] for c in group_cols): int(row["n"]) for row in rows}


def needs_blocks(df: DataFrame, group_cols: Sequence[str]) -> bool:
    return largest_group(df, group_cols) > task_rows(df.sparkSession)


def _unbounded_before(window: W) -> W:
    return window.rowsBetween(W.unboundedPreceding, -1)


def range_blocks(df: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """Range partition and record the partition number; the checkpoint pins the numbers down."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(max(partitions, 2), *order_cols)
    return cut_lineage(ranged.withColumn(BLOCK, F.spark_partition_id()))


def _block_offsets(df: DataFrame, group_cols: Sequence[str], block: str, measure: Column) -> DataFrame:
    """Per (group, block): weight of earlier blocks and weight of the whole group."""
    totals = df.groupBy(*group_cols, block).agg(measure.alias("__mass"))
    ordered = W.partitionBy(*group_cols).orderBy(block)
    return totals.select(
        *group_cols,
        block,
        F.coalesce(F.sum("__mass").over(_unbounded_before(ordered)), F.lit(0)).alias("__offset"),
        F.sum("__mass").over(W.partitionBy(*group_cols)).alias("__total"),
    )


def value_ranks(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    weight_col: str | None = None,
    *,
    blocks: bool | None = None,
) -> DataFrame:
    """One row per (group, distinct value): ``mult`` rows there, ``below`` rows under it, ``total`` in the group."""
    group_cols = list(group_cols)
    weight = F.col(weight_col) if weight_col else F.lit(1)
    if blocks is None:
        blocks = needs_blocks(df, group_cols)
    distinct = df.groupBy(*group_cols, value_col).agg(F.sum(weight).cast("bigint").alias("mult"))
    if not blocks:
        ordered = W.partitionBy(*group_cols).orderBy(value_col)
        return distinct.select(
            *group_cols,
            value_col,
            "mult",
            F.coalesce(F.sum("mult").over(_unbounded_before(ordered)), F.lit(0)).alias("below"),
            F.sum("mult").over(W.partitionBy(*group_cols)).alias("total"),
        )
    pinned = range_blocks(distinct, [*group_cols, value_col])
    offsets = _block_offsets(pinned, group_cols, BLOCK, F.sum("mult"))
    inside = W.partitionBy(*group_cols, BLOCK).orderBy(value_col)
    return pinned.join(offsets, [*group_cols, BLOCK]).select(
        *group_cols,
        value_col,
        "mult",
        (F.col("__offset") + F.coalesce(F.sum("mult").over(_unbounded_before(inside)), F.lit(0))).alias("below"),
        F.col("__total").alias("total"),
    )


def with_average_rank(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    rank_col: str,
    weight_col: str | None = None,
    *,
    blocks: bool | None = None,
) -> DataFrame:
    """Attach the average-tie rank of ``value_col`` inside its group (copies counted by weight)."""
    if blocks is None:
        blocks = needs_blocks(df, group_cols)
    if not blocks:
        weight = F.col(weight_col) if weight_col else F.lit(1)
        ordered = W.partitionBy(*group_cols).orderBy(value_col)
        upto = F.sum(weight).over(ordered.rangeBetween(W.unboundedPreceding, W.currentRow))
        tied = F.sum(weight).over(ordered.rangeBetween(W.currentRow, W.currentRow))
        return df.withColumn(rank_col, (upto - tied) + (tied + 1) / 2.0)
    ranks = value_ranks(df, group_cols, value_col, weight_col, blocks=True).select(
        *group_cols, value_col, (F.col("below") + (F.col("mult") + 1) / 2.0).alias(rank_col)
    )
    return df.join(ranks, [*group_cols, value_col])


def with_order_block(
    df: DataFrame, group_cols: Sequence[str], value_col: str, n_blocks: int, block_col: str = "block",
    *, blocks: bool | None = None,
) -> DataFrame:
    """Attach a block number that never decreases with the value; blocks hold similar row counts."""
    if blocks is None:
        blocks = needs_blocks(df, group_cols)
    if not blocks:
        below = F.rank().over(W.partitionBy(*group_cols).orderBy(value_col)) - 1
        total = F.count(F.lit(1)).over(W.partitionBy(*group_cols))
        return df.withColumn(block_col, F.floor(below * F.lit(n_blocks) / total).cast("int"))
    ranks = value_ranks(df, group_cols, value_col, blocks=True).select(
        *group_cols, value_col, F.floor(F.col("below") * n_blocks / F.col("total")).cast("int").alias(block_col)
    )
    return df.join(ranks, [*group_cols, value_col])


def quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: Mapping[str, float],
    weight_col: str | None = None,
    *,
    blocks: bool | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``."""
    if blocks is None:
        blocks = needs_blocks(df, group_cols)
    if not blocks:
        wanted = F.array(*[F.lit(float(p)) for p in probs.values()])
        args = [F.col(weight_col)] if weight_col else []
        found = df.groupBy(*group_cols).agg(F.percentile(value_col, wanted, *args).alias("__q"))
        return found.select(*group_cols, *[F.col("__q")[i].alias(n) for i, n in enumerate(probs)])
    ranked = value_ranks(df, group_cols, value_col, weight_col, blocks=True)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("below") <= position) & (position < F.col("below") + F.col("mult")), F.col(value_col)))

    aggregates = []
    for name, p in probs.items():
        position = (F.col("total") - 1) * F.lit(float(p))
        share = F.max(position - F.floor(position))
        low, high = at(F.floor(position)), at(F.ceil(position))
        aggregates.append((low + share * (high - low)).alias(name))
    return ranked.groupBy(*group_cols).agg(*aggregates)


def order_statistics(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    *,
    blocks: bool | None = None,
) -> DataFrame:
    """The k-th smallest value per group, no interpolation; ``ranks`` maps a name to ``n -> k``.

    A rank outside 1..n gives null, which callers report as a violation.
    """
    ranked = value_ranks(df, group_cols, value_col, blocks=blocks)
    aggregates = [F.max("total").alias("n")]
    for name, rank_of in ranks.items():
        k = rank_of(F.col("total"))
        hit = (F.col("below") < k) & (k <= F.col("below") + F.col("mult"))
        aggregates += [F.max(k).alias(f"{name}_rank"), F.max(F.when(hit, F.col(value_col))).alias(name)]
    return ranked.groupBy(*group_cols).agg(*aggregates)


def hash_positions(
    df: DataFrame,
    group_cols: Sequence[str],
    id_col: str,
    seed: Column | str | int,
    *,
    position_col: str = "position",
    size_col: str = "size",
    blocks: bool | None = None,
) -> DataFrame:
    """Zero-based place of each row in its group's pseudo-random order, and the group size.

    The order is by the leading 60 bits of ``md5(seed:id)`` and then by id. The top bits
    cut a large group into equal buckets, so no task ever sorts a whole group.
    """
    group_cols = list(group_cols)
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    if blocks is None:
        blocks = needs_blocks(df, group_cols)
    keyed = df.withColumn("__key", hash60(seed, id_col))
    if not blocks:
        ordered = W.partitionBy(*group_cols).orderBy("__key", id_col)
        return (
            keyed.withColumn(position_col, F.row_number().over(ordered).cast("bigint") - 1)
            .withColumn(size_col, F.count(F.lit(1)).over(W.partitionBy(*group_cols)))
            .drop("__key")
        )
    keyed = keyed.withColumn(BLOCK, F.shiftright("__key", 44))
    offsets = _block_offsets(keyed, group_cols, BLOCK, F.count(F.lit(1)))
    inside = W.partitionBy(*group_cols, BLOCK).orderBy("__key", id_col)
    return (
        keyed.join(offsets, [*group_cols, BLOCK])
        .withColumn(position_col, F.col("__offset") + F.row_number().over(inside) - 1)
        .withColumnRenamed("__total", size_col)
        .drop("__key", BLOCK, "__offset")
    )


def boundary_keys(df: DataFrame, id_col: str, seeds: Sequence[int], cuts: Sequence[Column], largest: int) -> DataFrame:
    """``(__code, bounds)``: for each group of ``df(__code, __n, id)`` and seed, the rows at the places ``cuts`` of the order by hash, as ``bounds[seed][cut]`` of (key, id).

    Counts per bucket of leading hash bits, combined before the shuffle, give the bucket that holds each place; only the rows of those
    buckets are ordered. Buckets beyond a task's rows are cut by their next bits until they are not. ``cuts`` are expressions of ``__n``.
    """
    limit, shift = task_rows(df.sparkSession), 60 - max(0, min(16, math.ceil(math.log2(max(1, largest / 4096)))))
    tagged = df.select("__code", "__n", id_col, F.posexplode(F.array(*[F.lit(int(s)) for s in seeds])).alias("__repeat", "__seed"))
    keyed = tagged.select("__code", "__n", "__repeat", id_col, hash60("__seed", id_col).alias("__key"))
    one = ["__code", "__repeat"]
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), c.cast("bigint").alias("place")) for i, c in enumerate(cuts)])).alias("w")
    held, base = keyed, None
    while True:
        prefix = F.shiftright("__key", shift)
        keep = [] if base is None else ["__within", "__base"]
        counts = held.groupBy(*one, *keep, prefix.alias("__bucket")).agg(F.count(F.lit(1)).alias("n"), F.first("__n").alias("__n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy(*one, *keep[:1]).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("offset", before + (F.col("__base") if keep else F.lit(0)))
        targets = placed.select(*one, "__bucket", "offset", "n", wanted).where("w.place >= offset and w.place < offset + n")
        targets = cut_lineage(targets.select(*one, "__bucket", "offset", "n", "w.*"))
        most = targets.agg(F.max("n"), F.count("*")).first()
        buckets = bounded_broadcast(targets.select(*one, F.col("__bucket").alias("__within"), F.col("offset").alias("__base")).distinct(), most[1], 64)
        held = keyed.withColumn("__within", prefix).join(buckets, [*one, "__within"])
        if (most[0] or 0) <= limit or not shift:
            break
        base, shift = True, max(0, shift - 16)
    inside = W.partitionBy(*one, "__within").orderBy("__key", id_col)
    ranked = held.withColumn("place", F.col("__base") + F.row_number().over(inside) - 1)
    found = ranked.join(bounded_broadcast(targets.select(*one, "cut", "place"), most[1], 64), [*one, "place"])
    rows = found.groupBy(*one).agg(F.sort_array(F.collect_list(F.struct("cut", F.col("__key").alias("key"), F.col(id_col).alias("id")))).alias("b"))
    return rows.groupBy("__code").agg(F.transform(F.sort_array(F.collect_list(F.struct("__repeat", "b"))), lambda e: e["b"]).alias("bounds"))


def _parts_of(spark: SparkSession, bounds: Mapping[int, Sequence]) -> Callable[..., Column]:
    """Column function of (code, keys, id): for each key the number of ``bounds[code]`` before (key, id).

    By vectors, as forty comparisons with ties in one generated method are too many for the JVM to compile.
    """
    shared = spark.sparkContext.broadcast({c: [[(b["key"], b["id"]) for b in one] for one in each] for c, each in bounds.items()})

    @F.pandas_udf("array<int>")
    def parts(code: pd.Series, keys: pd.Series, ids: pd.Series) -> pd.Series:
        codes, own = code.to_numpy(), np.stack(keys.to_numpy()) if len(keys) else np.empty((0, 0), np.int64)
        out = np.zeros(own.shape, dtype=np.int32)
        for c in np.unique(codes):
            rows = np.flatnonzero(codes == c)
            for r, ends in enumerate(shared.value[int(c)]):
                mine = own[rows, r]
                for key, last in ends:
                    after = mine > key
                    for tie in np.flatnonzero(mine == key):
                        after[tie] = ids.iloc[rows[tie]] > last
                    out[rows, r] += after
        return pd.Series(list(out))

    return parts


def parts_by_boundaries(df: DataFrame, group_cols: Sequence[str], id_col: str, seeds: Sequence[int], cuts: Callable[[Column], Sequence[Column]], parts_col: str) -> DataFrame | None:
    """``df`` with ``parts_col``: per seed the number of cuts before the row in the order by hash of its group; None with too many groups for a lookup.

    Only boundaries are looked for and compared with, so no order of all rows is made and nothing of their number is shuffled.
    """
    sizes = group_sizes(df, group_cols)
    if sizes is None:
        return None
    spark, group_cols = df.sparkSession, list(group_cols)
    schema = T.StructType([*[T.StructField(f"__g{i}", df.schema[c].dataType) for i, c in enumerate(group_cols)], T.StructField("__code", T.IntegerType()), T.StructField("__n", T.LongType())])
    lookup = spark.createDataFrame([(*key, code, n) for code, (key, n) in enumerate(sizes.items())], schema)
    same = F.lit(True)
    for i, c in enumerate(group_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    # at most a thousand groups
    coded = df.join(F.broadcast(lookup), same).drop(*(f"__g{i}" for i in range(len(group_cols))))
    wanted = cuts(F.col("__n"))
    bounds = boundary_keys(coded.select("__code", "__n", id_col), id_col, seeds, wanted, max(sizes.values(), default=0))
    n_bounds, keys_of = len(sizes) * len(seeds) * len(wanted), F.array(*[hash60(F.lit(int(s)), id_col) for s in seeds])
    if n_bounds * 128 <= broadcast_bytes(spark):
        found = {row["__code"]: row["bounds"] for row in bounds.collect()}  # counted above
        return coded.withColumn(parts_col, _parts_of(spark, found)("__code", keys_of, F.col(id_col))).drop("__code", "__n")
    bounds = bounds.withColumnRenamed("__code", "__of")
    keys = coded.withColumn("__keys", keys_of).join(bounds, F.col("__code") == F.col("__of"))

    def part(r: int) -> Column:
        own, out = F.col("__keys")[r], F.lit(0)
        for j in range(len(wanted)):
            at = F.col("bounds")[r][j]
            out = out + ((own > at["key"]) | ((own == at["key"]) & (F.col(id_col) > at["id"]))).cast("int")
        return out

    return keys.withColumn(parts_col, F.array(*[part(r) for r in range(len(seeds))])).drop("__keys", "__code", "__n", "__of", "bounds")


def medians(df: DataFrame, group_cols: Sequence[str], value_cols: Sequence[str], *, blocks: bool | None = None) -> DataFrame:
    """Exact medians of several columns, ``median_<column>``."""
    group_cols = list(group_cols)
    if blocks is None:
        blocks = needs_blocks(df, group_cols)
    if not blocks:
        return df.groupBy(*group_cols).agg(*[F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in value_cols])
    parts = [quantiles(df, group_cols, c, {f"median_{c}": 0.5}, blocks=True) for c in value_cols]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, group_cols) if group_cols else out.join(F.broadcast(part))
    return out
