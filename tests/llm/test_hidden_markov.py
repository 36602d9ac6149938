import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np

from driftgauge.llm.hidden_markov import Model, Setup, _blocks, expected_counts, forward_log, score_documents
from tests.llm.data import SCHEMA, empty, messy

SMALL = Setup(states=3, own=30, shared=16, dictionary=60, rounds=3)


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]


def test_base_scores_and_counts(spark):
    df, rows = messy(spark)
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    counts = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        own = tokens(r[1])
        want.append((str(r[0]), held(r[0]), len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)))
    got = score_documents(df, SMALL).collect()
    key = lambda x: (x[0], x[2], x[5])
    got_rows = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(got_rows, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert any(held(r[0]) for r in rows)


def tiny(rng):
    m = Model(rng.random(2), rng.random((2, 2)), rng.random((4, 2)))
    return Model(m.start / m.start.sum(), m.step / m.step.sum(axis=1, keepdims=True), m.emit / m.emit.sum(axis=0))


def by_paths(s, m):
    """Likelihood and expected counts by going through all state paths."""
    total, counts = 0.0, np.zeros(2 + 4 + 8)
    for path in itertools.product(range(2), repeat=len(s)):
        p = m.start[path[0]] * m.emit[s[0], path[0]]
        for t in range(1, len(s)):
            p *= m.step[path[t - 1], path[t]] * m.emit[s[t], path[t]]
        total += p
        counts[path[0]] += p
        for t in range(1, len(s)):
            counts[2 + 2 * path[t - 1] + path[t]] += p
        for t in range(len(s)):
            counts[6 + 2 * s[t] + path[t]] += p
    return total, counts / total


def test_recursions_against_all_paths():
    rng = np.random.default_rng(3)
    model = tiny(rng)
    texts = [rng.integers(0, 4, size=n).astype(np.uint16) for n in (1, 1, 2, 5, 7, 7, 3)]
    want = np.zeros(14)
    got = np.zeros(14)
    for at, block in _blocks(texts):
        logs = forward_log(block, model)
        expected_counts(block, model, got)
        for i, log in zip(at, logs):
            likelihood, counts = by_paths(texts[i], model)
            assert math.isclose(log, math.log(likelihood), rel_tol=1e-12)
            want += counts
    assert np.allclose(got, want)


def test_the_model_is_a_distribution(spark):
    """Over all one-word texts, unseen words included, probabilities add up to at most one and EM beats the unigram model."""
    rng = random.Random(0)
    rows = []
    for i in range(700):
        topic = "abcde" if i % 2 else "vwxyz"
        rows.append((i, " ".join(rng.choice(topic) + rng.choice("123") for _ in range(rng.randrange(5, 40))), "en", "s", 1, "x"))
    got = score_documents(spark.createDataFrame(rows, SCHEMA), SMALL).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"] * 0.9
    words = [(1000 + i, w, "en", "s", 1, "x") for i, w in enumerate(["a1", "z3", "new", "other", "unseen words here"])]
    # the new ids must not be trained on: compare tables that differ only in held-out rows
    held = [r for r in words if zlib.crc32(str(r[0]).encode()) % 7 == 2]
    assert all(math.isfinite(r.score) for r in score_documents(spark.createDataFrame(rows + held, SCHEMA), SMALL).collect())


def test_empty(spark):
    assert score_documents(empty(spark), SMALL).collect() == []
