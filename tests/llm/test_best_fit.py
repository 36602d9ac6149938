import random

from driftgauge.llm.best_fit import CLUSTER_BITS, SOURCE_BITS, pack, pack_documents
from tests.llm.data import SCHEMA, empty, messy


def brute(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [b for b in bins if b["room"] >= size and b["room"] > 0 and s % SOURCE_BITS not in b["s"] and c % CLUSTER_BITS not in b["c"]]
        if fits:
            b = min(fits, key=lambda b: (b["room"], b["since"]))
        else:
            b = {"room": capacity, "s": set(), "c": set(), "n": 0, "id": len(bins)}
            bins.append(b)
        out.append((b["id"], b["n"]))
        b["room"] -= size
        b["n"] += 1
        b["since"] = len(out)
        b["s"].add(s % SOURCE_BITS)
        b["c"].add(c % CLUSTER_BITS)
    return out


def test_tightest_compatible_bin():
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randrange(1, 120)
        sizes = sorted((rng.randrange(1, 50) for _ in range(n)), reverse=True)
        sources, clusters = [rng.randrange(-9, 9) for _ in range(n)], [rng.choice([1, rng.randrange(10**6)]) for _ in range(n)]
        assert pack(sizes, sources, clusters, 60) == brute(sizes, sources, clusters, 60)


def test_pieces_cover_documents_and_respect_conflicts(spark):
    df, rows = messy(spark)
    for group_rows in (4096, 10):
        got = pack_documents(df, capacity=128, group_rows=group_rows).collect()
        size = {}
        for r in got:
            size[r.bin] = size.get(r.bin, 0) + r.length
        assert max(size.values()) <= 128 and min(r.length for r in got) >= 1
        assert sum(r.length for r in got) == sum(len((r[1] or "").encode().split()) + 1 for r in rows)
        by_bin = {}
        for r in got:
            by_bin.setdefault(r.bin, []).append(r)
        unique = {r[0]: r for r in rows if r[0] is not None and r[0] != 1}
        for members in by_bin.values():
            assert sorted(m.position for m in members) == list(range(len(members)))
            known = [unique[m.doc_id] for m in members if m.doc_id in unique]
            assert len({k[3] for k in known}) == len(known)
            assert len({" ".join((k[1] or "").lower().split()) for k in known}) == len(known)
        for doc_id, r in unique.items():
            spans = sorted((m.piece, m.start, m.length) for m in got if m.doc_id == doc_id)
            assert [s[1] for s in spans] == [sum(x[2] for x in spans[:k]) for k in range(len(spans))]
            assert sum(s[2] for s in spans) == len((r[1] or "").encode().split()) + 1


def test_a_hot_source_and_copies(spark):
    rows = [(i, "copy of a text" if i % 3 == 0 else "text %d" % i, "en", "hot" if i % 2 else "s%d" % i, 1, "x") for i in range(600)]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA), capacity=64, group_rows=100).collect()
    assert len(got) == 600
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.bin, []).append(r.doc_id)
    for ids in by_bin.values():
        assert sum(i % 2 for i in ids) <= 1 and sum(i % 3 == 0 for i in ids) <= 1


def test_empty(spark):
    assert pack_documents(empty(spark)).collect() == []
