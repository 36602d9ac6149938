"""Connected components by alternating star contraction."""
from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.session import cut_lineage


def spanning_links(pairs: DataFrame, most: int = 1 << 18) -> DataFrame:
    """Pairs (a, b) with the same components as ``pairs`` and, of every ``most`` pairs dealt to a task, only those of a spanning forest.

    A group whose members are all linked with each other has a square of pairs; this leaves about as many as it has members.
    """
    total = pairs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for batch in batches:
            kept: tuple[list[int], list[int]] = ([], [])
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    kept[0].append(a)
                    kept[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in kept], ["a", "b"])

    dealt = pairs.select("a", "b").repartition(max(1, math.ceil(total / most)), F.xxhash64("a"))
    return dealt.mapInArrow(run, "a bigint, b bigint")


def components_in_task(pairs: DataFrame, most: int = 1 << 18) -> DataFrame:
    """:func:`connected_components` of ``pairs(a, b)``: up to ``most`` pairs, counted first, are joined up by one task without rounds."""
    if pairs.count() > most:
        return connected_components(spanning_links(pairs, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        for start in range(0, len(nodes), 10000):
            some = nodes[start : start + 10000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["node", "component"])

    return pairs.select("a", "b").repartition(1).mapInArrow(run, "node bigint, component bigint")


def _starred(edges: DataFrame, of: str, to: str) -> DataFrame:
    """Each edge ``(of, to)`` with the smallest neighbour of ``of`` (itself included) as ``least``.

    The minimum combines before the shuffle. The join may meet a node with very many edges; both sides are
    plain exchanges, which adaptive execution splits.
    """
    least = edges.groupBy(of).agg(F.least(F.min(to), F.col(of)).alias("least"))
    return edges.join(least, of)


def connected_components(pairs: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``pairs(a, b)``; the component is its smallest node.

    Large-star and small-star steps alternate until the edges no longer change. Each round is written to the
    checkpoint folder; the driver only sees two sums per round. Self-pairs and repeated pairs are harmless.
    """
    edges = cut_lineage(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    before = None
    for _ in range(most_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo"), F.col("hi")))
        large = _starred(both, "u", "v").where("v > u").select(F.col("v").alias("hi"), F.col("least").alias("lo")).distinct()
        small = _starred(large, "hi", "lo")
        linked = small.where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        edges = cut_lineage(linked.union(small.select("hi", F.col("least"))).where("hi <> lo").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components have not settled")
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
