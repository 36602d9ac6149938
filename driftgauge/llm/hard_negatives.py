"""Hard negatives from blocks in Hilbert order with zone maps.

Rows are sorted along a Hilbert curve through all dimensions and written as Parquet in a folder a block. The zone map of a block holds the least and greatest
value of every dimension, so interval arithmetic gives a range for the score of an anchor with any row of the block:
``sum(max(a_d * lo_d, a_d * hi_d))`` and the same with ``min``. Only blocks whose range meets what an anchor still needs are read for it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.storage import stored
from driftgauge.llm.vectors import ZoneMap, best, choose, exact, first_k, id_array, ids, in_blocks, integer_vectors, matrix, meet, padded, zones

POSITIVE = "ask bigint, anchor_id bigint, vec_id bigint, score bigint"
NEGATIVE = "ask bigint, positive_score bigint, vec_id bigint, score bigint"
CURVE_BITS = 4


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (unsigned coordinates of ``bits`` bits), as bytes, most significant first.

    The coordinates are turned plane by plane, from the highest bit: where a coordinate has the bit, the lower bits of the first one are
    inverted, elsewhere the bits in which both differ are exchanged. A Gray code of the planes gives the position.
    """
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    for bit in reversed(range(1, bits)):
        plane, low = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for d in range(dims):
            has = (x[d] & plane) != 0
            swapped = np.where(has, 0, (x[0] ^ x[d]) & low).astype(np.uint32)
            x[0] ^= np.where(has, low, swapped).astype(np.uint32)
            x[d] ^= swapped
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for bit in reversed(range(1, bits)):
        flip ^= np.where(x[-1] & np.uint32(1 << bit), np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= flip
    planes = np.stack([(x >> np.uint32(bit)) & 1 for bit in reversed(range(bits))])  # bits x dims x rows
    return np.packbits(planes.reshape(bits * dims, -1).T.astype(np.uint8), axis=1)


def with_curve(rows: DataFrame, lo: np.ndarray, hi: np.ndarray, bits: int = CURVE_BITS) -> DataFrame:
    """``rows(v, ...)`` with the position ``curve`` of the cell of ``v`` in a grid between ``lo`` and ``hi``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.maximum(hi - lo, 1)
        for batch in batches:
            cells = np.clip((matrix(batch, "v", len(lo)) - lo) * (1 << bits) // (step + 1), 0, (1 << bits) - 1)
            keys = hilbert_keys(cells, bits) if len(lo) else np.zeros((batch.num_rows, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], [*batch.schema.names, "curve"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", curve binary")


def _extent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of every dimension."""
    whole = ZoneMap(zones(rows.select(F.lit(0).alias("block"), "v"), "v", width), width)
    return (whole.lo[0], whole.hi[0]) if len(whole.block) else (np.zeros(width), np.zeros(width))


def _positives(width: int, k: int):
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        asks, rows = exact(matrix(a, "v", width), matrix(b, "v", width))
        score = (asks @ rows.T).astype(np.int64)
        own = np.asarray(a.column("row"))[:, None] == np.asarray(b.column("row"))[None, :]
        fits = (np.asarray(a.column("label"))[:, None] == np.asarray(b.column("label"))[None, :]) & ~own & (score >= np.asarray(a.column("least"))[:, None])
        tie, unknown = ids(b), np.asarray(b.column("vec_id").is_null())
        at, rows_at = [], []
        for i in range(len(asks)):
            held = np.flatnonzero(fits[i])
            held = held[first_k(score[i, held], tie[held], k)]
            at += [i] * len(held)
            rows_at.append(held)
        rows_at = np.concatenate([*rows_at, np.zeros(0, np.int64)]).astype(np.int64)
        at = np.array(at, np.int64)
        return pa.table({
            "ask": a.column("row").take(pa.array(at)), "anchor_id": a.column("vec_id").take(pa.array(at)), "vec_id": id_array([tie[rows_at]], [unknown[rows_at]]),
            "score": pa.array(score[at, rows_at].astype(np.int64)),
        })

    return run


def _negatives(width: int, k: int):
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        asks, rows = exact(matrix(a, "v", width), matrix(b, "v", width))
        score = (asks @ rows.T).astype(np.int64)
        other = np.asarray(a.column("label"))[:, None] != np.asarray(b.column("label"))[None, :]
        tie, unknown, windows, ask_row = ids(b), np.asarray(b.column("vec_id").is_null()), a.column("windows").to_pylist(), np.asarray(a.column("row"))
        out: list[list] = [[], [], [], []]
        for i in range(len(asks)):
            for w in windows[i]:
                held = np.flatnonzero(other[i] & (score[i] >= w["least"]) & (score[i] <= w["most"]))
                held = held[first_k(score[i, held], tie[held], k)]
                out[0] += [ask_row[i]] * len(held)
                out[1] += [w["most"]] * len(held)
                out[2].append(held)
                out[3].append(score[i, held])
        held = np.concatenate([*out[2], np.zeros(0, np.int64)]).astype(np.int64)
        return pa.table({
            "ask": pa.array(np.array(out[0], np.int64)), "positive_score": pa.array(np.array(out[1], np.int64)), "vec_id": id_array([tie[held]], [unknown[held]]),
            "score": pa.array(np.concatenate([*out[3], np.zeros(0, np.int64)]).astype(np.int64)),
        })

    return run


def hard_negatives(
    embeddings: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 5, scale: int = 256, floor_percent: int = 80, vector_column: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchors`` (a condition on ``vec_id``) holds.

    Scores are integer inner products of ``floor(scale * x)``; higher ones come first, ties by smaller vec_id. An anchor's positives are its first
    ``positives`` other rows of the same ``label`` (an expression over the columns of the table). For each, the first ``negatives`` rows of other labels
    follow whose score lies between ``floor_percent`` per cent of the positive's score and that score. Fewer are returned where there are no more; a
    negative positive score has an empty window.

    Rows with a null label, null vectors and vectors with null, non-finite or (2^28 or more after scaling) overlarge components take no part; shorter vectors are
    filled up with zeros. A repeated row counts each time, as an anchor too. A null vec_id ranks last among ties. An empty table gives no rows. Other
    columns are not read.
    """
    base = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), integer_vectors(vector_column, scale).alias("v"))
    base, width = padded(stored(base.where("v is not null and label is not null"), "negative-vectors"))
    total = base.count()
    rows = in_blocks(with_curve(base, *_extent(base, width)), total, [F.col("curve"), F.col("vec_id")], "curve-blocks").drop("curve")
    summary = ZoneMap(zones(rows, "v", width), width)
    asks = rows.where(anchors).withColumn("least", F.lit(float("-inf")))
    # positives: the own block first, its last score rules out blocks
    home = stored(meet(asks, rows, summary, _positives(width, positives), POSITIVE), "positives-home")
    known = home.groupBy("ask").agg(F.when(F.count("*") >= positives, F.min("score").cast("double")).alias("kth"))
    known = asks.join(known, asks["row"] == known["ask"], "left").withColumn("least", F.coalesce("kth", "least")).drop("ask", "kth")
    reach = lambda z, batch: z.ranges(matrix(batch, "v", width))[1] >= np.asarray(batch.column("least"))[:, None]
    visits = stored(choose(known, summary, reach), "positives-visits")
    more = meet(visits, rows, summary, _positives(width, positives), POSITIVE)
    chosen = stored(best(home.unionByName(more), ["ask"], positives).select("ask", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # negatives: one window for each different positive score; once the own block has filled it, only better rows are looked for
    least = F.ceil(F.col("positive_score") * floor_percent / 100).cast("bigint")
    exact_least = F.when(least * 100 < F.col("positive_score") * floor_percent, least + 1).when((least - 1) * 100 >= F.col("positive_score") * floor_percent, least - 1).otherwise(least)
    windows = chosen.where("positive_score >= 0").select("ask", F.col("positive_score").alias("most"), exact_least.alias("least")).distinct()
    asks = asks.drop("least")

    def asking(open_windows: DataFrame) -> DataFrame:
        lists = open_windows.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("most", "least"))).alias("windows"))
        return asks.join(lists, asks["row"] == lists["ask"]).drop("ask")

    first = stored(meet(asking(windows), rows, summary, _negatives(width, negatives), NEGATIVE), "negatives-home")
    filled = first.groupBy("ask", F.col("positive_score").alias("most")).agg(F.when(F.count("*") >= negatives, F.min("score")).alias("kth"))
    narrowed = windows.join(filled, ["ask", "most"], "left").select("ask", "most", F.coalesce("kth", "least").alias("least"))

    def overlap(zone_map: ZoneMap, batch: pa.RecordBatch) -> np.ndarray:
        low, high = zone_map.ranges(matrix(batch, "v", width))
        hits = np.zeros(low.shape, bool)
        for i, held in enumerate(batch.column("windows").to_pylist()):
            for w in held:
                hits[i] |= (high[i] >= w["least"]) & (low[i] <= w["most"])
        return hits

    visits = stored(choose(asking(narrowed), summary, overlap), "negatives-visits")
    found = first.unionByName(meet(visits, rows, summary, _negatives(width, negatives), NEGATIVE))
    ranked = best(found, ["ask", "positive_score"], negatives).select(
        "ask", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return chosen.join(ranked, ["ask", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
