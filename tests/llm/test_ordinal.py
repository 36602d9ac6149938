import random

import numpy as np

from driftgauge.llm.ordinal import Features, Model, Setup, classify
from tests.llm.data import SCHEMA, empty, messy, prose

SETUP = Setup(bits=14, tasks=3, rounds=12)


def graded(rng, i):
    grade = i % 3
    words = prose(rng, 60, 800).split()
    if grade == 0:
        words = [w + "###" for w in words]
    if grade == 1:
        words[rng.randrange(60)] = rng.choice(["bad", "worse", "worst"])
    return " ".join(words), grade


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    rows = [(i, *graded(rng, i)) for i in range(1800)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t, _ in rows], SCHEMA)
    marks = spark.createDataFrame([(i, g) for i, _, g in rows if i % 2] + [(1, 2), (None, 0)], "doc_id bigint, grade int")
    got = {r.doc_id: r for r in classify(docs, marks, setup=SETUP).select("row.*", "expected_grade", "top_probability", "kept").collect()}
    right = [got[i]["kept"] == (g == 2) for i, _, g in rows if i % 2 == 0]
    assert np.mean(right) > 0.97
    mean = [np.mean([got[i]["expected_grade"] for i, _, g in rows if g == k and i % 2 == 0]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_awkward_rows_pass_through(spark):
    df, rows = messy(spark)
    marks = spark.createDataFrame([(r[0], (r[0] or 0) % 3) for r in rows], "doc_id bigint, grade int")
    out = classify(df, marks, setup=SETUP).select("row.*", "expected_grade", "top_probability", "kept")
    assert out.columns == [*df.columns, "expected_grade", "top_probability", "kept"]
    got = out.collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(rows, key=str)
    assert all(0 <= r["top_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    same = {}
    for r in got:
        assert same.setdefault(r.text, r["top_probability"]) == r["top_probability"]


def test_tails_fall_with_the_grade():
    model = Model(np.random.default_rng(0).normal(size=1 << 10), np.array([-1.0, 0.5, 2.0]))
    tails = model.tails(Features(10)("some Words 12 here ###"))
    assert all(tails[:-1] > tails[1:])


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, grade int")
    df, rows = messy(spark)
    assert classify(df, none, setup=SETUP).where("kept").count() == len(rows)
    assert classify(empty(spark), none, setup=SETUP).collect() == []
