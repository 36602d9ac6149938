import hashlib
import random

from pyspark.sql import functions as F

from driftgauge.llm import multiset_hash as m
from tests.llm.data import SCHEMA, empty, messy


def prints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: r.p for r in df.select("i", m.printed(m.insert(m.zero(), m.units(F.col("t")))).alias("p")).collect()}


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))


def test_edited_texts(spark):
    df, rows = messy(spark)
    got = m.edited_fingerprints(df).collect()
    ordered = order(rows)
    want, edits = [], []
    for r, after in zip(ordered, ordered[1:] + ordered[:1]):
        text, nxt = r[1] or "", after[1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        edits.append(edited)
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((g.doc_id, g.n_chars, g.edited_sha256) for g in got), key=str) == sorted(want, key=str)
    # fingerprints made step by step are those of the whole edited texts
    direct, own = prints(spark, edits), prints(spark, [r[1] or "" for r in ordered])
    want = sorted((str(w[0]), w[2], own[i], direct[i]) for i, w in enumerate(want))
    assert sorted((str(g.doc_id), g.edited_sha256, g.fingerprint, g.edited_fingerprint) for g in got) == want
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    assert all(g.near_edited == 1 for g in got if g.fingerprint == g.edited_fingerprint)


def test_many_parts(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-(2**62), 2**62) if i % 2 else i, "text %d." % i, "en", "s", 1, "x") for i in range(300)] + [(None, "nothing", "en", "s", 1, "x")]
    got = {(r.doc_id, r.text): r.next_text for r in m.with_next(spark.createDataFrame(rows, SCHEMA), part_rows=7).collect()}
    ordered = order(rows)
    assert got == {(a[0], a[1]): b[1] for a, b in zip(ordered, ordered[1:] + ordered[:1])}
    dense = [(i, "t%d" % i, "en", "s", 1, "x") for i in range(500)]
    got = {r.doc_id: r.next_text for r in m.with_next(spark.createDataFrame(dense, SCHEMA), part_rows=10).collect()}
    assert got == {i: "t%d" % ((i + 1) % 500) for i in range(500)}


def test_order_free_and_incremental(spark):
    rng = random.Random(2)
    units = ["unit number %d" % rng.randrange(40) for _ in range(30)]
    shuffled = units[:]
    rng.shuffle(shuffled)
    joined = lambda us: "".join(u + ". " for u in us)
    a, b, c = prints(spark, [joined(units), joined(shuffled), joined(units[:-1])]).values()
    assert a == b != c
    df = spark.createDataFrame([(joined(units), units[-1] + ".", joined(units[:-1]))], "t string, u string, v string")
    vector = m.insert(m.zero(), m.units(F.col("t")))
    out = df.select(m.printed(m.insert(vector, m.units(F.col("u")), -1)).alias("less"), m.printed(m.combine(m.insert(m.zero(), m.units(F.col("v"))), m.insert(m.zero(), m.units(F.col("u"))))).alias("more")).first()
    assert out.less == c and out.more == a


def test_other_ends_give_other_fingerprints(spark):
    texts = ["Yes. It is.", "Yes? It is!", "It is.\nYes", "Yes. It is", "Yes.. It is.", "Yes.\nIt is.", "Yes.\n\nIt is."]
    got = list(prints(spark, texts).values())
    assert len(set(got)) == len(texts)


def test_likeness_follows_the_shared_part(spark):
    def pair(shared):
        return [". ".join("s%d x" % i for i in range(shared)) + ". " + ". ".join("%s%d y" % (side, i) for i in range(200 - shared)) for side in "ab"]

    rows = [(k, *pair(k)) for k in (0, 50, 100, 150, 200)]
    vec = lambda c: m.insert(m.zero(), m.units(F.col(c)))
    got = {r.k: r.n for r in spark.createDataFrame(rows, "k int, a string, b string").select("k", m.likeness(vec("a"), vec("b")).alias("n")).collect()}
    assert got[200] == 1 and all(abs(got[k] - k / 200) < 0.35 for k in got)


def test_one_row_and_empty(spark):
    one = m.edited_fingerprints(spark.createDataFrame([(None, "abcd", None, None, None, None)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abca").hexdigest()
    assert m.edited_fingerprints(empty(spark)).collect() == []
