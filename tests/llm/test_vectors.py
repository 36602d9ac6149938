import math
import random

import numpy as np
from pyspark.sql import functions as F

from driftgauge.llm import vectors
from driftgauge.llm.hard_negatives import hard_negatives, hilbert_keys
from driftgauge.llm.pivot_search import top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, block string, score int"


def table(seed=2, n=260, dims=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        rows.append((i, [float(np.float32(c + rng.gauss(0, 0.3))) for c in centre], rng.randrange(4), "x", "y", 1))
    common = [float(np.float32(c)) for c in centres[0]]
    # a hot vector, repeated rows, vectors that take no part, a short one
    rows += [(1000 + i, common, i % 2, "x", "y", 1) for i in range(90)]
    rows += [rows[0], rows[0], rows[7], (None, common, 1, "x", "y", 1), (None, common, 2, "x", "y", 1)]
    rows += [(2000, None, 1, "x", "y", 1), (2001, [1.0, None], 1, "x", "y", 1), (2002, [math.nan] * dims, 1, "x", "y", 1), (2003, [math.inf] * dims, 1, "x", "y", 1)]
    rows += [(2100, [1.0, 2.0], 1, "x", "y", 1), (2200, [], 1, "x", "y", 1), (2300, [3e38] * dims, 1, "x", "y", 1), (2400, common, None, "x", "y", 1)]
    return rows


def usable(rows, scale):
    out = []
    for vec_id, v, label, *_ in rows:
        if v is None or any(x is None or not math.isfinite(x) or abs(math.floor(scale * x)) > 1 << 28 for x in v):
            continue
        out.append((vec_id, [math.floor(scale * x) for x in v], label))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def order(pair):
    return -pair[0], pair[1] is None, pair[1] or 0


def test_top_k_against_brute_force(spark, monkeypatch):
    rows = table()
    held = usable(rows, 64)
    want = []
    for i, (q, v, _) in enumerate(held):
        if q is not None and q % 20 == 0:
            pairs = sorted(((dot(v, w), x) for j, (x, w, _) in enumerate(held) if j != i), key=order)[:20]
            want += [(q, r + 1, x, s) for r, (s, x) in enumerate(pairs)]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    for size in (4096, 40):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", size)
        monkeypatch.setattr(vectors, "CELL_ROWS", 4 * size)
        monkeypatch.setattr(vectors, "CELL_ASKS", 5)
        got = top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, pivots=5)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def relabelled(vec_id, label):
    return (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rows = table(5)
    held = [(i, v, relabelled(i, y)) for i, v, y in usable(rows, 256) if y is not None]
    want = []
    for i, (q, v, y) in enumerate(held):
        if q is None or q % 10:
            continue
        near = sorted(((dot(v, w), x) for j, (x, w, z) in enumerate(held) if j != i and z == y), key=order)[:5]
        for s, p in near:
            window = sorted(((t, x) for x, w, z in held for t in [dot(v, w)] if z != y and 80 * s <= 100 * t <= 100 * s), key=order)[:5]
            want += [(q, p, r + 1, x, s, t) for r, (t, x) in enumerate(window)]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    for size in (4096, 40):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", size)
        monkeypatch.setattr(vectors, "CELL_ROWS", 2 * size)
        got = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0, label)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert top_k(none, F.col("vec_id") % 20 == 0).collect() == []
    assert hard_negatives(none, F.col("vec_id") % 10 == 0, F.col("label")).collect() == []
    nulls = spark.createDataFrame([(20, None, 1, "x", "y", 1), (40, [1.0], None, "x", "y", 1)], SCHEMA)
    assert top_k(nulls, F.col("vec_id") % 20 == 0).collect() == []
    assert hard_negatives(nulls, F.col("vec_id") % 10 == 0, F.col("label")).collect() == []


def test_hilbert_neighbours_differ_in_one_coordinate():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        keys = [k.tobytes() for k in hilbert_keys(grid, bits)]
        assert len(set(keys)) == len(grid)
        path = grid[sorted(range(len(grid)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path.astype(int), axis=0)).sum(axis=1) == 1).all()


def test_blocks_are_ruled_out(spark, monkeypatch):
    """Far groups: a block of one group is not read for asks of another."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    rng = random.Random(1)
    rows = [(i, [100.0 * (i % 4 == d) + rng.random() for d in range(4)], 0, "x", "y", 1) for i in range(800)]
    seen = []
    real = vectors.choose
    from driftgauge.llm import pivot_search

    monkeypatch.setattr(pivot_search, "choose", lambda *a: seen.append(real(*a)) or seen[-1])
    top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, pivots=8).collect()
    assert seen[0].count() < 40 * 15 / 2
