import math
import random
import re

from pyspark.sql import functions as F

from driftgauge.llm.risk_rules import CUTOFFS, apply_rules, binomial_tail_log
from tests.llm.data import SCHEMA, empty, messy, prose

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, good boolean")


def test_metrics_and_base_rules(spark):
    df, rows = messy(spark)
    got = apply_rules(df, labels(spark, [(1, True), (1, False), (4, None), (None, True)]), df.columns)
    want = []
    for r in rows:
        m = brute(r[1])
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want.append((r[0], *m, failed, not failed))  # too few labels: no cutoff
    assert got.select("row.*").columns == df.columns
    rows_got = got.select("row.doc_id", *[F.col(f"metrics.{n}") for n in NAMES], "base_failed", "kept").collect()
    assert sorted(map(tuple, rows_got), key=str) == sorted(want, key=str)


def test_tail_is_exact(spark):
    cases = [(k, n, p) for n in (1, 7, 300, 2000) for k in (0, 1, 5, 30) if k <= n for p in (0.01, 0.3)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k bigint, n bigint")
    for p in (0.01, 0.3):
        for r in df.select("k", "n", binomial_tail_log(F.col("k"), F.col("n"), p).alias("t")).distinct().collect():
            want = tail(r.k, r.n, p) if r.n <= 300 else None
            if want:
                assert math.isclose(math.exp(r.t), want, rel_tol=1e-9)


def test_cutoffs_hold_their_promise(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(1500):
        noisy, lang = i % 10 == 0, "en" if i % 3 else "de"
        words = prose(rng, 80, 5000).split()
        text = " ".join(w + ("###" if noisy and rng.random() < 0.6 else "") for w in words)
        if not noisy and rng.random() < 0.002:
            text += " ####"
        rows.append((i, text, lang, "s", 0, "x"))
        marks.append((i, not noisy))
    rows += [(5000 + i, rows[i][1], None, "s", 0, "x") for i in range(20)]
    done = apply_rules(spark.createDataFrame(rows, SCHEMA), labels(spark, marks), ["doc_id", "lang"], risk=0.1)
    got = {r.doc_id: r for r in done.select("row.*", "metrics", "base_failed", "kept").collect()}
    assert all(not got[i].kept for i in range(0, 1500, 10))  # the noise is found
    assert all(got[5000 + i].kept == (not got[5000 + i].base_failed) for i in range(20))  # an unlabelled stratum has no cutoff
    # brute force: per language and rule the strictest cutoff that the exact tail allows
    for lang in ("en", "de"):
        good = [got[i] for i, ok in marks if ok and got[i].lang == lang and not got[i].base_failed]
        values = [r["metrics"]["n_symbols"] / max(r["metrics"]["word_chars"], 1) for r in good]
        passed = [c for c in CUTOFFS["symbols_per_char"] if tail(sum(v > c for v in values), len(values), 0.02) <= 0.05 / (2 * len(CUTOFFS))]
        assert all(r.kept for r, v in zip(good, values) if v <= min(passed) and r["metrics"]["n_symbols"] == 0 and r.kept)
        assert not any(r.kept for r, v in zip(good, values) if v > min(passed))


def test_empty(spark):
    assert apply_rules(empty(spark), labels(spark, []), ["doc_id", "lang"]).collect() == []


def test_repeated_rows_certify_nothing(spark):
    """One document a thousand times, and one text under a thousand ids, are one trial each."""
    rng = random.Random(3)
    good, noisy = prose(rng, 80, 5000), " ".join(w + "###" for w in prose(rng, 80, 5000).split())
    bad = [(9000, noisy, "en", "s", 0, "x"), (9001, noisy, "de", "s", 0, "x")]
    same_row = [(1, good, "en", "s", 0, "x")] * 1000
    same_text = [(10 + i, good, "de", "s", 0, "x") for i in range(1000)]
    done = apply_rules(spark.createDataFrame(bad + same_row + same_text, SCHEMA), labels(spark, [(1, True), *[(10 + i, True) for i in range(1000)]]), ["doc_id", "lang"], risk=0.5)
    assert all(r.kept for r in done.collect())


def test_null_and_empty_strata_are_apart(spark):
    rng = random.Random(4)
    texts = [prose(rng, 80, 5000) for _ in range(400)]
    noisy = " ".join(w + "###" for w in prose(rng, 80, 5000).split())
    rows = [(i, t, "", "s", 0, "x") for i, t in enumerate(texts)] + [(1000, noisy, "", "s", 0, "x"), (1001, noisy, None, "s", 0, "x")]
    done = apply_rules(spark.createDataFrame(rows, SCHEMA), labels(spark, [(i, True) for i in range(400)]), ["doc_id", "lang"], risk=0.2)
    kept = {r.doc_id: r.kept for r in done.select("row.doc_id", "kept").where("doc_id >= 1000").collect()}
    assert kept == {1000: False, 1001: True}
