"""Quality classifier: ordinal cumulative-link regression on hashed text features.

P(grade > k) is a logistic function of ``w . x - threshold[k]``: one weight vector for all grades and ordered thresholds. Features
are hashed words and word beginnings (whether present) and hashed shapes of words (their share of the text in steps). The model is fitted on a
bounded sample of labelled rows. Features are screened first: only those whose counts differ between grades by more than chance (a z-score over
all sampled rows) get a weight, so that rare words are not learnt by heart. Then every task takes gradient steps over its rows from the shared
parameters, and Spark averages the results of the tasks, round after round. Scores give the expected grade and the probability of the top grade.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.llm.storage import stored
from driftgauge.llm.text import LOWER_BYTES

CACHE_WORDS = 300_000
STEM = 5
MARKS = b".,;:!?()[]\"'"
PLAIN = (b"a", b"Aa", b",a", b".a")
KINDS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))


@dataclass(frozen=True)
class Setup:
    bits: int = 18
    grades: int = 3
    sample: int = 30_000  # labelled rows the fit may see, chosen by hash of the id
    tasks: int = 4
    rounds: int = 10
    rate: float = 0.25
    decay: float = 1e-4
    screen: float = 5.0  # least z-score of a feature


def _shape(word: bytes) -> bytes:
    """The kinds of characters in a word: capital, small letter, digit, and any other byte as itself."""
    return bytes(sorted(set(word.translate(KINDS))))


def _slot(key: bytes, bits: int) -> int:
    return zlib.crc32(key) & ((1 << bits) - 1)


class Features:
    """Slots of a whole text: words, beginnings of words, shapes and repetition; only those ``wanted``.

    What a word gives is kept in a bounded cache; a word of small letters that gives nothing costs one look-up.
    """

    NOTHING = ((), None)

    def __init__(self, bits: int, wanted: bytes | None = None) -> None:
        self.bits = bits
        self.wanted = wanted
        self.cache: dict[bytes, tuple[tuple[int, ...], bytes | None]] = {}

    def _of(self, word: bytes) -> tuple[tuple[int, ...], bytes | None]:
        bare = word.translate(LOWER_BYTES).strip(MARKS)
        slots = {_slot(b"w" + bare, self.bits)}
        if len(bare) > STEM:
            slots.add(_slot(b"p" + bare[:STEM], self.bits))
        shape = _shape(word)
        found = tuple(s for s in slots if self.wanted is None or self.wanted[s])
        hit = (found, None if shape in PLAIN else shape)
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = hit = hit if hit != self.NOTHING else self.NOTHING
        return hit

    def __call__(self, text: str | None) -> np.ndarray:
        counts = Counter(text.encode("utf-8").split()) if text else Counter()
        total, shapes, seen = sum(counts.values()), {}, set()
        get, nothing = self.cache.get, self.NOTHING
        for word, n in counts.items():
            hit = get(word) or self._of(word)
            if hit is nothing:
                continue
            seen.update(hit[0])
            if hit[1] is not None:
                shapes[hit[1]] = shapes.get(hit[1], 0) + n
        keys = [b"s%d" % int(step * 100) + shape for shape, n in shapes.items() for step in (0.02, 0.05, 0.1, 0.2, 0.4) if n >= step * total]
        # a word that makes up much of a text, and how much of the text is repetition
        top = max(counts.values(), default=0)
        keys += [b"top%d" % i for i, step in enumerate((0.1, 0.2, 0.4)) if top > step * total]
        keys += [b"distinct%d" % i for i, step in enumerate((0.1, 0.2, 0.3, 0.5)) if len(counts) < step * total]
        keys += [b"short%d" % i for i, step in enumerate((1, 10, 20, 50)) if total < step]
        seen.update(s for s in (_slot(k, self.bits) for k in keys) if self.wanted is None or self.wanted[s])
        return np.array(sorted(seen), dtype=np.int32)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pass(rows: list[tuple[int, np.ndarray]], weights: np.ndarray, thresholds: np.ndarray, squares: np.ndarray, setup: Setup) -> None:
    """One pass of adaptive gradient steps on the sum of the cumulative logistic losses."""
    ks = np.arange(setup.grades - 1)
    t_squares = np.ones(setup.grades - 1)
    for grade, slots in rows:
        z = weights[slots].sum()
        error = _sigmoid(z - thresholds) - (grade > ks)
        g = error.sum()
        squares[slots] += g * g
        weights[slots] -= setup.rate * (g / np.sqrt(squares[slots]) + setup.decay * weights[slots])
        t_squares += error * error
        thresholds += setup.rate * error / np.sqrt(t_squares)
        thresholds.sort()


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def wanted(self) -> bytes:
        return (self.weights != 0).astype(np.uint8).tobytes()

    def tails(self, slots: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return _sigmoid(self.weights[slots].sum() - self.thresholds)


def sample_rows(documents: DataFrame, grades: DataFrame, setup: Setup) -> DataFrame:
    """(doc_id, grade, slots) of at most ``setup.sample`` labelled documents: those whose id hashes below a bound set from the number of labels.

    The bound aims 3 % below the sample, some five deviations, so the limit after it hardly ever takes anything and no task sorts labels.
    """
    graded = grades.where("doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    total, scale = graded.count(), 1 << 40
    if total > setup.sample:
        graded = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * 0.97 * setup.sample / total))
    chosen = graded.limit(setup.sample)
    # the sample is bounded, so its ids are broadcast and no text is shuffled
    joined = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    bits = setup.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            slots = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int32()))], ["doc_id", "grade", "slots"])

    return joined.select("doc_id", "grade", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, grade int, slots array<int>")


def screened(rows: DataFrame, setup: Setup) -> bytes:
    """A byte per slot: one where, for some cut of the grades, the slot's count above the cut is off by ``setup.screen`` deviations."""
    table = rows.select("grade", F.explode("slots").alias("slot")).groupBy("slot", "grade").agg(F.count("*").alias("n")).toArrow()  # fixed size
    counts = np.zeros((1 << setup.bits, setup.grades))
    counts[table.column("slot").to_numpy(), table.column("grade").to_numpy()] = table.column("n").to_numpy()
    of_grade = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    shares = np.array([of_grade.get(g, 0) for g in range(setup.grades)]) / sum(of_grade.values())
    seen, z = counts.sum(axis=1), np.zeros(1 << setup.bits)
    for cut in range(1, setup.grades):
        share = shares[cut:].sum()
        expected = seen * share
        z = np.maximum(z, np.abs(counts[:, cut:].sum(axis=1) - expected) / np.sqrt(seen * share * (1 - share) + 0.5))
    return (z >= setup.screen).astype(np.uint8).tobytes()


def fit(documents: DataFrame, grades: DataFrame, setup: Setup = Setup()) -> Model:
    """Fit on ``documents(doc_id, text)`` with ``grades(doc_id, grade)``; a document with several grades has the lowest.

    Without labelled documents the thresholds make every text the top grade.
    """
    size, cuts = 1 << setup.bits, setup.grades - 1
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(setup.tasks)).cast("int").alias("part")
    rows = stored(sample_rows(documents, grades, setup).repartition(setup.tasks, part).sortWithinPartitions("doc_id", "grade"), "graded-sample")
    weights, thresholds, squares = np.zeros(size), np.linspace(-1.0, 1.0, cuts) if cuts > 1 else np.zeros(1), np.ones(size)
    if not rows.take(1):
        return Model(weights, np.full(cuts, -10.0))
    wanted = screened(rows, setup)
    for turn in range(setup.rounds):
        shared = rows.sparkSession.sparkContext.broadcast((weights, thresholds, squares))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            w, t, q = (x.copy() for x in shared.value)
            keep = np.frombuffer(wanted, dtype=np.bool_)
            data = [(g.as_py(), x[keep[x]]) for b in batches for g, s in zip(*b.columns) for x in [s.values.to_numpy(zero_copy_only=False)]]
            if not data:
                return
            order = np.random.default_rng(turn).permutation(len(data))
            _pass([data[i] for i in order], w, t, q, setup)
            # only what this task has touched
            moved = np.flatnonzero(q != shared.value[2])
            cells = np.concatenate([moved, size + np.arange(cuts)])
            values = np.concatenate([w[moved] - shared.value[0][moved], t - shared.value[1]])
            grown = np.concatenate([q[moved] - shared.value[2][moved], np.zeros(cuts)])
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(values), pa.array(grown)], ["cell", "delta", "grown"])

        deltas = rows.select("grade", "slots").mapInArrow(run, "cell int, delta double, grown double")
        # mean over the tasks that have touched a weight; fixed size
        table = deltas.groupBy("cell").agg(F.avg("delta").alias("delta"), F.avg("grown").alias("grown")).toArrow()
        cells = table.column("cell").to_numpy()
        delta, grown = table.column("delta").to_numpy(), table.column("grown").to_numpy()
        own = cells < size
        weights[cells[own]] += delta[own]
        squares[cells[own]] += grown[own]
        thresholds[cells[~own] - size] += delta[~own]
        thresholds.sort()
    return Model(weights, thresholds)


def score_texts(documents: DataFrame, model: Model, setup: Setup = Setup()) -> DataFrame:
    """(row, expected_grade, top_probability) of ``documents``, whose columns are in ``row``, so their names cannot clash.

    Null and blank texts have the one feature of an empty text. Columns pass through untouched.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at, bits = documents.columns.index("text"), setup.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits, shared.value.wanted)
        for batch in batches:
            tails = [shared.value.tails(features(t.as_py())) for t in batch.column(0).field(at)]
            expected = pa.array([float(t.sum()) for t in tails], pa.float64())
            top = pa.array([float(t[-1]) for t in tails], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), expected, top], ["row", "expected_grade", "top_probability"])

    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    schema = T.StructType([*packed.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("top_probability", T.DoubleType())])
    return packed.mapInArrow(run, schema)


def classify(documents: DataFrame, grades: DataFrame, least: float = 0.5, setup: Setup = Setup()) -> DataFrame:
    """(row, expected_grade, top_probability, kept): a document is kept when its probability of the top grade is at least ``least``.

    Rows, repeated ones too, are scored one by one; an empty table gives no rows. ``row`` has the columns of ``documents``.
    """
    model = fit(documents, grades, setup)
    return score_texts(documents, model, setup).withColumn("kept", F.col("top_probability") >= least)
