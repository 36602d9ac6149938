import hashlib
import zlib
from collections import Counter

from driftgauge.llm.hash_ring import CELLS, VIRTUAL_NODES, assign_shards
from tests.llm.data import SCHEMA, empty, messy


def position(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def brute(rows, shards):
    """Rows enter one after the other in ring order and walk clockwise past full shards."""
    cell = lambda p: p >> (60 - CELLS.bit_length() + 1)
    nodes = {}
    for n in range(shards * VIRTUAL_NODES):
        at, shard = cell(position("node", n)), n // VIRTUAL_NODES
        nodes[at] = min(shard, nodes.get(at, shard))
    ring = sorted(nodes)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, out = [0] * shards, []
    queue = []
    for r in rows:
        text = (r[1] or "").encode()
        crc = zlib.crc32(text)
        queue.append((position("row", r[0] if r[0] is not None else "crc%d" % crc), r[0], crc, len(text) + 16))
    for p, i, crc, size in sorted(queue, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2], x[3])):
        start = next((k for k, at in enumerate(ring) if at >= cell(p)), 0)
        for k in range(len(ring)):
            shard = nodes[ring[(start + k) % len(ring)]]
            if used[shard] < room[shard]:
                out.append((i, size, crc, "rows", shard, used[shard], None))
                used[shard] += 1
                break
    return sorted(out, key=str)


def test_against_insertion_one_by_one(spark):
    df, rows = messy(spark)
    for shards in (40, 7, 1):
        got = sorted(map(tuple, assign_shards(df, shards).collect()), key=str)
        assert got == brute(rows, shards)
        counts = Counter(r[4] for r in got)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1


def test_more_rows_than_cells_and_fewer_than_shards(spark):
    rows = [(i, "t", "en", "s", 1, "x") for i in range(9000)]
    assert sorted(map(tuple, assign_shards(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows, 40)
    few = rows[:3]
    assert sorted(map(tuple, assign_shards(spark.createDataFrame(few, SCHEMA)).collect()), key=str) == brute(few, 40)


def test_empty(spark):
    assert assign_shards(empty(spark)).collect() == []
