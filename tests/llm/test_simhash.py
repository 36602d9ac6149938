import random
import re

import xxhash

from driftgauge.llm.components import connected_components
from driftgauge.llm.simhash import links, near_duplicates
from tests.llm.data import empty, messy


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


def brute_near(prints):
    prints = sorted(set(prints))
    return [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3]


def test_against_brute_force(spark):
    df, rows = messy(spark)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = [brute_print(r[1]) for r in rows]
    of = components(set(prints), brute_near(prints))
    ids = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            ids[of[p]] = min(ids.get(of[p], r[0]), r[0])
    want = sorted((str(r[0]), format(p, "016x"), ids.get(of[p])) for r, p in zip(rows, prints))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_links_of_dense_groups(spark):
    """Also where keys are crowded and the balls of the other bits are enumerated."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = set()
    for _ in range(300):
        value = rng.choice(centres)
        for _ in range(rng.randrange(0, 5)):
            value ^= 1 << rng.choice(range(0, 64, 3))
        prints.add(value)
    prints |= {0, (1 << 64) - 1, 1 << 63, 7}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {tuple(sorted(map(signed, p))) for p in brute_near(prints)}
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    for hot in (1024, 6):
        got = [tuple(r) for r in links(table, hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_exploded_tables_are_not_broadcast(spark):
    """Probes are 34 times the prints, while Spark takes them to be as large as these; only the counted crowded keys may be broadcast."""
    rng = random.Random(4)
    table = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(500)] + [(i << 40 | 5,) for i in range(20)], "fp bigint")
    for hot, sent in ((1024, 0), (10, 1)):
        found = links(table, hot=hot)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        probed = [line for line in plan.splitlines() if re.search(r"(BroadcastHash|SortMerge|ShuffledHash)Join.*\[seg#\d+, key#\d+L\], \[seg#\d+, key#\d+L\], Inner", line)]
        assert len(probed) == 1 + sent and sum("SortMergeJoin" in line for line in probed) == 1, plan
    rows = near_duplicates(spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id bigint, text string"))
    rows.collect()
    final = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"SortMergeJoin.*salt#", final), final


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    rng = random.Random(1)
    rng.shuffle(path)
    pairs = path + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 200), (300, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 300: 200, 200: 200}


def test_empty(spark):
    assert near_duplicates(empty(spark)).collect() == []
