import random

from driftgauge.llm.wide_simhash import Index, NAMES, base_bounds, greatest_distance, planned_index, set_bounds, similar_components, similar_documents, wide_print
from tests.llm.data import empty, messy
from tests.llm.test_simhash import components


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)] if words else [])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, share):
    return [rng.choice(["new", "other"]) + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def corpus():
    """Groups of near copies, some with over a hundred members, and unrelated texts."""
    rng = random.Random(8)
    rows = []
    for group in range(14):
        base = [f"g{group}w{rng.randrange(4000)}" for _ in range(300)]
        for _ in range(120 if group < 2 else 3):
            rows.append((len(rows), " ".join(edited(rng, base, 0.006))))
    rows += [(len(rows) + i, " ".join(f"x{rng.randrange(10**5)}" for _ in range(200))) for i in range(60)]
    return rows


def test_groups_of_near_copies_against_jaccard(spark):
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    near = lambda least: [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= least]
    want = components(list(sets), near(0.8))
    for crowded in (64, 4):
        got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), crowded=crowded).collect()}
        assert len(got) == len(rows)
        # no unrelated text is joined, and what is clearly alike is
        loose, tight = components(list(sets), near(0.7)), components(list(sets), near(0.87))
        assert all(loose[i] == loose[got[i]] for i in got)
        assert all(got[i] == got[tight[i]] for i in got)
        assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got)


def test_components_are_those_of_links_under_a_common_key(spark):
    rows = corpus()
    prints = [(i, *map(int, wide_print(t, 5).view("int64"))) for i, t in rows]
    table = spark.createDataFrame(prints, "cid bigint, " + ", ".join(f"{n} bigint" for n in NAMES))
    most = greatest_distance(0.8)
    value = {p[0]: sum((w % 2**64) << 64 * i for i, w in enumerate(p[1:])) for p in prints}

    def meet(x, y):
        d = x ^ y
        return d.bit_count() <= most and any((d >> 24 * s & (2**24 - 1)).bit_count() <= 1 for s in range(24))

    want = {(a, b) for a in value for b in value if a < b and meet(value[a], value[b])}
    want = components(list(value), want)
    for crowded in (10**6, 8):
        got = {r.node: r.component for r in similar_components(table, most, Index(24, 24), crowded=crowded).collect()}
        assert {i: got.get(i, i) for i in value} == want


def test_two_groups_under_one_key_that_only_spared_classes_join(spark):
    """A chain of prints with one common segment: each is near the next few only, so few leaders leave several components."""
    most, value, rng = 30, {}, random.Random(3)
    bits = rng.sample(range(24, 768), 700)
    for i in range(70):
        value[i] = sum(1 << b for b in bits[: 10 * i])
    # a gap wider than the limit: two components
    for i in range(40, 70):
        value[i] ^= sum(1 << b for b in range(0, 24)) ^ sum(1 << b for b in bits[660:])
    rows = [(i, *((v >> 64 * w & (2**64 - 1)) - ((v >> 64 * w & (1 << 63)) << 1) for w in range(12))) for i, v in value.items()]
    table = spark.createDataFrame(rows, "cid bigint, " + ", ".join(f"{n} bigint" for n in NAMES))

    def meet(x, y):
        d = x ^ y
        return d.bit_count() <= most and any((d >> 24 * s & (2**24 - 1)).bit_count() <= 1 for s in range(24))

    want = components(list(value), {(a, b) for a in value for b in value if a < b and meet(value[a], value[b])})
    for crowded in (12,):
        got = {r.node: r.component for r in similar_components(table, most, Index(24, 24), crowded=crowded).collect()}
        assert {i: got.get(i, i) for i in value} == want


def test_awkward_rows(spark):
    df, rows = messy(spark)
    got = similar_documents(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert of[200] == of[201] == {1} and of[203] == of[204] == of[205] == {203} and 1 in of[1] and of[209] == {209}
    assert {(r.doc_id, r.component_id) for r in got if r.first and r.doc_id is None} == {(None, None)}
    assert similar_documents(empty(spark)).collect() == []


def test_stage_keeps_one_document_of_each_group(spark):
    import corpus_pipeline

    df, rows = messy(spark)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    left = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert ("None", "lost words " * 70) in left and ("1", "another text of the same id.") in left
    assert not {i for i, _ in left} & {"200", "201", "204", "205"} and sum(t == "" for _, t in left) == 1
    # both repeated rows of document 1 and the row itself
    assert [i for i, t in left if t == rows[0][1]] == ["1"] * 3
    assert corpus_pipeline.near_dedup(spark, empty(spark), "").collect() == []


def test_pairs_around_the_limit(spark):
    """Pairs at exactly 0.78, 0.80 and 0.82: the sets decide, not the prints."""
    rows, of = [], {}
    for similarity, shared, own in ((0.78, 390, 55), (0.80, 400, 50), (0.82, 410, 45)):
        for pair in range(30):
            base = [f"s{shared}p{pair}w{i}" for i in range(shared + 4)]
            both = [" ".join(base + [f"{side}{shared}p{pair}w{i}" for i in range(own)]) for side in "ab"]
            assert abs(jaccard(*map(shingles, both)) - similarity) < 1e-12
            of[len(rows)] = similarity
            rows += [(len(rows), both[0]), (len(rows) + 1, both[1])]
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    linked = {s: sum(got[i] == got[i + 1] for i in of if of[i] == s) for s in (0.78, 0.80, 0.82)}
    assert linked == {0.78: 0, 0.80: 30, 0.82: 30}


def test_set_bounds_lose_no_link_and_rule_out_most_pairs_of_a_group_of_edited_copies(spark):
    """Copies of one text with a few or many own words: no two with many are alike, and few of their pairs are left to compare."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    sets = {}
    for i in range(120):
        words = edited(rng, base, 0.002 if i < 20 else 0.04)
        sets[i] = sorted({hash(s) for s in shingles(" ".join(words))})
    sets[120], sets[121] = [1, 2, 3], [1, 2, 3]
    bounds, common = set_bounds(spark.createDataFrame(list(sets.items()), "cid bigint, hashes array<bigint>"), 0.8)
    known = {r.cid: r for r in bounds.collect()}
    shared = {(r.a, r.b) for r in common.collect()}
    assert all(known[i].size == len(s) for i, s in sets.items())
    pairs = [(a, b) for a in sets for b in sets if a < b]
    left = {p for p in pairs if p in shared or (known[p[0]].room >= known[p[1]].size and known[p[1]].room >= known[p[0]].size)}
    alike = {p for p in pairs if jaccard(set(sets[p[0]]), set(sets[p[1]])) >= 0.8}
    assert (120, 121) in alike and len(alike) > 100 and alike <= left
    assert len(left - alike) < (len(pairs) - len(alike)) / 3


def test_base_bounds_lose_no_link_and_leave_a_twentieth_of_the_pairs_of_a_group_of_edited_copies(spark):
    """Copies with about as many own words as a pair may have: most are within the limit of the base and beyond that of each other."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    sets = {i: sorted({hash(s) for s in shingles(" ".join(edited(rng, base, 0.03)))}) for i in range(1, 150)}
    sets[0] = sorted({hash(s) for s in shingles(" ".join(base))})
    # two that are far from the base and alike
    sets[150] = sorted({hash(s) for s in shingles(" ".join(base[:100] + [f"o{i}" for i in range(50)]))})
    sets[151] = sets[150][:-3] + [1, 2, 3]
    table = spark.createDataFrame(list(sets.items()), "cid bigint, hashes array<bigint>")
    bounds, links = base_bounds(table, spark.createDataFrame([(i, 0) for i in sets], "cid bigint, base bigint"), 0.8)
    known, linked = {r.cid: r for r in bounds.collect()}, {(r.a, r.b) for r in links.collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    alike = {p for p in pairs if jaccard(set(sets[p[0]]), set(sets[p[1]])) >= 0.8}
    assert linked <= alike and (150, 151) in linked and {p for p in alike if p[0] == 0} <= linked
    fits = {p for p in pairs if known[p[0]].room >= known[p[1]].size and known[p[1]].room >= known[p[0]].size}
    assert alike <= fits | linked
    of = components(list(sets), list(linked))
    # what a search by bounds has left to compare: pairs of different components that fit
    left = {p for p in fits - linked if of[p[0]] != of[p[1]]}
    assert len({p for p in pairs if of[p[0]] != of[p[1]]}) > 1000
    assert len(left) < (len(pairs) - len(alike)) / 20
