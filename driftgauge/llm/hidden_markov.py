"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

Emissions are over word classes: the most frequent words are classes of their own, the others share classes by the checksum
of their last three bytes, the end of a text is one more. Within a shared class a word has its add-one share of the
training counts, so the model is a distribution over all words, unseen ones included. Every EM round runs forward-backward over
all training texts and adds up the expected counts of the partitions; parameters have a fixed size. Scores come from the
scaled forward recursion over the whole text and are exact.

Words that are not in the bounded dictionary sent to tasks get their counts by a shuffle join; each of these words
is rare by construction, so no key of that join is hot.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.storage import stored
from driftgauge.llm.text import lower_words

BLOCK_TOKENS = 300_000


@dataclass(frozen=True)
class Setup:
    states: int = 8
    own: int = 4096  # frequent words with a class of their own
    shared: int = 256  # classes for all other words
    dictionary: int = 65_536  # most words whose counts are sent to tasks
    rounds: int = 4
    seed: int = 7

    @property
    def end(self) -> int:
        return self.own + self.shared

    @property
    def classes(self) -> int:
        return self.own + self.shared + 1


def held_out(doc_id: Column) -> Column:
    """Texts that training must not see: crc32 of the id's text modulo 7 is 2."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 7 == 2


def shared_class(word: bytes, setup: Setup) -> int:
    return setup.own + zlib.crc32(word[-3:]) % setup.shared


def word_counts(texts: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word, c) over ``texts(text)``; counted per partition in bounded tables, then summed."""

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(lower_words(text.as_py()))
                if len(counts) >= flush:
                    yield emit(counts)
                    counts = Counter()
        if counts:
            yield emit(counts)

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], int]:
    """The words with count >= the returned bound, at most ``most`` of them, by falling count.

    The bound comes from counts of counts in eighth-octave steps, a table of a few hundred rows.
    """
    step = F.floor(F.log2("c") * 8)
    table = sorted(((r[0], r["n"], r["least"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    bound, total = 1 << 62, 0
    for _, n, least in table:
        total += n
        if total > most:
            break
        bound = least
    rows = counts.where(F.col("c") >= bound).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0])), bound


def encode(documents: DataFrame, known: dict[bytes, tuple[int, int]], setup: Setup) -> DataFrame:
    """Class sequences of ``documents(doc_id, held_out, text)``, with what the dictionary says about their words."""
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast({w: (i, math.log10(c + 1)) for w, (i, c) in known.items()})
    names = ["doc_id", "held_out", "n_tokens", "n_known", "log_known", "log_shared", "classes", "rare", "times", "per_class"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]

    def one(tokens: list[bytes], get, memo: dict[bytes, int]):
        sequence = np.empty(len(tokens) + 1, dtype=np.uint16)
        log_known, n_known, log_shared, rare = [], 0, [], []
        for at, word in enumerate(tokens):
            hit = get(word)
            if hit is not None:
                sequence[at] = hit[0]
                log_known.append(hit[1])
                if hit[0] >= setup.own:
                    log_shared.append(hit[1])
            else:
                rare.append(word)
                suffix = word[-3:]
                kind = memo.get(suffix)
                if kind is None:
                    if len(memo) > 100_000:
                        memo.clear()
                    kind = memo[suffix] = setup.own + zlib.crc32(suffix) % setup.shared
                sequence[at] = kind
        sequence[-1] = setup.end
        return sequence, math.fsum(log_known), len(log_known), math.fsum(log_shared), Counter(rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, memo = table.value.get, {}
        for whole_batch in batches:
            for batch in (whole_batch.slice(i, 500) for i in range(0, whole_batch.num_rows, 500)):
                rows = []
                for held, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                    sequence, log_known, n_known, log_shared, rare = one(lower_words(text.as_py()), get, memo)
                    shared = sequence[(sequence >= setup.own) & (sequence < setup.end)] - setup.own
                    per_class = np.bincount(shared, minlength=setup.shared).astype(np.uint32)
                    nonzero = np.flatnonzero(per_class)
                    packed = np.stack([nonzero.astype(np.uint32), per_class[nonzero]]).tobytes()
                    rows.append((held, len(sequence), n_known, log_known, log_shared, sequence.tobytes(), list(rare), list(rare.values()), packed))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    schema = (
        f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, log_known double, log_shared double, classes binary, "
        "rare array<binary>, times array<bigint>, per_class binary"
    )
    return documents.select("doc_id", "held_out", "text").mapInArrow(run, schema)


@dataclass
class Model:
    start: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: np.ndarray  # classes x states

    @staticmethod
    def first(background: np.ndarray, setup: Setup) -> Model:
        """Sticky states whose emissions are the background with multiplicative noise."""
        rng = np.random.default_rng(setup.seed)
        emit = background[:, None] * rng.gamma(0.7, size=(setup.classes, setup.states))
        step = np.full((setup.states, setup.states), 0.1 / setup.states) + 0.9 * np.eye(setup.states)
        return Model(np.full(setup.states, 1 / setup.states), step, emit / emit.sum(axis=0))

    @staticmethod
    def from_counts(counts: np.ndarray, background: np.ndarray, setup: Setup) -> Model:
        """Expected counts with a little of the background added, so that nothing has probability zero."""
        k = setup.states
        start, step, emit = counts[:k] + 0.1, counts[k : k + k * k].reshape(k, k) + 0.1, counts[k + k * k :].reshape(setup.classes, k)
        emit = emit + background[:, None] * 10.0
        return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _blocks(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Indices and sequences in blocks of bounded padded size, longest first."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        take = order[at : at + max(1, BLOCK_TOKENS // longest)]
        yield np.array(take), [sequences[i] for i in take]
        at += len(take)


def _by_time(block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols ordered by time, then text, and the number of texts alive at each time."""
    lengths = np.array([len(s) for s in block])
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    starts = np.concatenate([[0], np.cumsum(alive)])
    flat = np.empty(starts[-1], dtype=np.intp)
    for i, s in enumerate(block):
        flat[starts[: len(s)] + i] = s
    return flat, alive


def forward_log(block: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural log likelihood of each sequence; scaled at every step."""
    flat, alive = _by_time(block)
    out = np.zeros(len(block))
    at, alpha = 0, None
    for n in alive:
        seen = model.emit[flat[at : at + n]]
        alpha = seen * model.start if alpha is None else (alpha[:n] @ model.step) * seen
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        out[:n] += np.log(scale)
        at += n
    return out


def expected_counts(block: list[np.ndarray], model: Model, counts: np.ndarray) -> None:
    """Add the Baum-Welch counts of a block: starts, steps, emissions."""
    k = len(model.start)
    flat, alive = _by_time(block)
    starts = np.concatenate([[0], np.cumsum(alive)])
    alphas, scales = np.empty((len(flat), k)), np.empty(len(flat))
    seen = model.emit[flat]
    alpha = None
    for t, n in enumerate(alive):
        a, b = starts[t], starts[t] + n
        alpha = seen[a:b] * model.start if alpha is None else (alpha[:n] @ model.step) * seen[a:b]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        alphas[a:b], scales[a:b] = alpha, scale
    steps = np.zeros((k, k))
    beta = np.ones((alive[-1], k))
    gammas = alphas  # overwritten from the end
    for t in range(len(alive) - 2, -1, -1):
        n, m = alive[t], alive[t + 1]
        a, c = starts[t], starts[t + 1]
        later = seen[c : c + m] * beta / scales[c : c + m, None]
        steps += alphas[a : a + m].T @ later
        gammas[c : c + m] *= beta
        beta = np.ones((n, k))
        beta[:m] = later @ model.step.T
    gammas[: alive[0]] *= beta
    counts[:k] += gammas[: alive[0]].sum(axis=0)
    counts[k : k + k * k] += (steps * model.step).ravel()
    emitted = counts[k + k * k :].reshape(-1, k)
    for s in range(k):
        emitted[:, s] += np.bincount(flat, weights=gammas[:, s], minlength=len(emitted))


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in column]


def train(encoded: DataFrame, background: np.ndarray, setup: Setup) -> Model:
    """EM rounds over ``encoded(classes)``; each task adds up the counts of its texts, Spark those of the tasks."""
    model = Model.first(background, setup)
    size = setup.states * (1 + setup.states + setup.classes)
    for _ in range(setup.rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(size)
            for batch in batches:
                for _, block in _blocks(_sequences(batch.column(0))):
                    expected_counts(block, shared.value, counts)
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full])], ["cell", "value"])

        table = encoded.select("classes").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()  # fixed size
        counts = np.zeros(size)
        counts[table.column("cell").to_numpy()] = table.column("value").to_numpy()
        model = Model.from_counts(counts, background, setup)
    return model


def forward_scores(encoded: DataFrame, model: Model, class_totals: np.ndarray) -> DataFrame:
    """``encoded`` without its sequences, with ``hidden``: log10 likelihood of the classes, less log10 of the totals of shared classes."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, np.log10(class_totals)))
    kept = ["doc_id", "row", "held_out", "n_tokens", "n_known", "log_known", "log_shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs = shared.value
        for batch in batches:
            sequences, out = _sequences(batch.column(0)), np.zeros(batch.num_rows)
            for at, block in _blocks(sequences):
                out[at] = forward_log(block, model) / math.log(10)
            for i, packed in enumerate(batch.column(1)):
                kinds, times = np.frombuffer(packed.as_buffer(), dtype=np.uint32).reshape(2, -1)
                out[i] -= float((times * logs[kinds]).sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out)], [*kept, "hidden"])

    source = encoded.select("classes", "per_class", *kept)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in kept)
    return source.mapInArrow(run, schema + ", hidden double")


def score_documents(documents: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``documents(doc_id, text)``.

    Tokens are the words and one end. ``base_score`` is the add-one unigram log10 probability, ``score`` that of the hidden
    Markov model. Null text counts as empty (one end token). Repeated rows are trained on and scored like any other; a null
    doc_id counts as the empty id. Without training texts all counts are zero. Other columns are not read.
    """
    rows = documents.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = stored(word_counts(rows.where("not held_out")), "word-counts")
    n_train = rows.where("not held_out").count()
    shared_of = (F.lit(setup.own) + F.crc32(F.expr("substring(word, -3, 3)")) % setup.shared).cast("int")
    by_class = counts.groupBy(shared_of.alias("kind")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # one row per shared class
    n_tokens = sum(r["c"] for r in by_class) + n_train
    n_words = sum(r["v"] for r in by_class) + (1 if n_train else 0)
    top, bound = frequent(counts, setup.dictionary)
    known = {w: (i if i < setup.own else shared_class(w, setup), c) for i, (w, c) in enumerate(top)}
    # totals of the shared classes: the words left in them, each with one added, and one for what was never seen
    totals = np.ones(setup.shared)
    for r in by_class:
        totals[r["kind"] - setup.own] += r["c"] + r["v"]
    background = np.full(setup.classes, 1.0)
    for i, (w, c) in enumerate(top[: setup.own]):
        totals[shared_class(w, setup) - setup.own] -= c + 1
        background[i] = c + 1
    background[setup.own : setup.end], background[setup.end] = totals, n_train + 1
    background /= background.sum()

    # writing the table fixes the row numbers
    encoded = stored(encode(rows, known, setup).withColumn("row", F.monotonically_increasing_id()), "encoded-texts")
    model = train(encoded.where("not held_out"), background, setup)
    hidden = forward_scores(encoded, model, totals)

    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    rare = rare.join(counts.where(F.col("c") < bound), "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log_rare"), F.sum("times").alias("n_rare")
    )
    log_rare, n_rare = F.coalesce("log_rare", F.lit(0.0)), F.coalesce("n_rare", F.lit(0))
    base = F.col("log_known") + log_rare + math.log10(n_train + 1) - F.col("n_tokens") * math.log10(n_tokens + n_words + 1)
    return hidden.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + n_rare + (1 if n_train else 0)).cast("bigint").alias("n_known"),
        F.lit(n_tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"),
        (F.col("hidden") + F.col("log_shared") + log_rare).alias("score"),
    )
