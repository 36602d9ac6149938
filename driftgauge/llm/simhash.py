"""SimHash fingerprints of word shingles, and links between them by multi-index hashing."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.components import connected_components
from driftgauge.llm.text import lower_words
from driftgauge.session import bounded_broadcast, cut_lineage

BITS = 64
SEED = 42  # fixed value: the seed of the shingle hash
BLOCK = 1 << 15


def shingle_hashes(tokens: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles, repeats included, in bounded blocks."""
    if not tokens:
        return
    if len(tokens) < width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], dtype=np.uint64)
        return
    digest, last = xxhash.xxh64_intdigest, len(tokens) - width + 1
    for start in range(0, last, BLOCK):
        part = tokens[start : min(start + BLOCK, last) + width - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(width))))
        yield np.array([digest(s, SEED) for s in joined], dtype=np.uint64)


def fingerprint(text: str | bytes | None, width: int) -> int:
    """A bit is one if it is set in over half of the shingle hashes; no word gives zero."""
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    for block in shingle_hashes(lower_words(text), width):
        bits = np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed BIGINT) for ``documents(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            prints = np.array([fingerprint(t.as_py(), width) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, fingerprint bigint"
    )


def _segment(print_column, index: int, width: int):
    """Bits ``index*width`` and up of the fingerprint, as a non-negative BIGINT."""
    return F.shiftrightunsigned(F.col(print_column), index * width).bitwiseAND(F.lit((1 << width) - 1))


def _flips(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m | (1 << b) for m in masks for b in range(width)}
    return sorted(masks)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(distinct: DataFrame, radius: int = 3, segments: int = 2, hot: int = 1024) -> DataFrame:
    """Pairs (a, b), a < b, of ``distinct(fp)`` that differ in at most ``radius`` bits, each once.

    Two such prints differ by at most ``radius // segments`` bits in one of the segments. Every print is stored
    under each of its segments; it looks up the keys of the small Hamming ball around each segment, and
    complete distances are verified. Only balls in which no one-bit is cleared are needed for balls of one bit:
    of two segments that differ in one bit, the one with the zero finds the other.

    A key that holds over ``hot`` prints is not fetched. There the look-up goes to the whole prints instead: the
    ball of the other bits, with what is left of the radius, is enumerated and matched exactly. The
    cost per print is then bounded by the size of that ball whatever the size of the group, and no link is lost.

    Spark takes a table to be about as large after an explode as before and would send the probes, some 34 times the
    prints, through the driver; joins with exploded tables are therefore told to shuffle.
    """
    width = BITS // segments
    ball = radius // segments
    if BITS % segments or ball > 1:
        raise ValueError("segments must divide 64 and leave balls of at most one bit")
    prints = distinct.select("fp").distinct()
    entries = prints.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _segment("fp", i, width).alias("key")) for i in range(segments)])).alias("e")
    ).select("fp", "e.seg", "e.key")
    masks = F.array(*[F.lit(m).cast("bigint") for m in _flips(width, ball)])
    probes = entries.select("fp", "seg", "key", F.explode(masks).alias("mask")).where(F.col("key").bitwiseAND(F.col("mask")) == 0)
    probes = probes.select(F.col("fp").alias("p"), "seg", F.col("key").bitwiseOR(F.col("mask")).alias("key"), "mask").hint("merge")
    sizes = entries.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    crowded = cut_lineage(sizes.select("seg", "key"))
    n_crowded = crowded.count()
    crowded = bounded_broadcast(crowded, n_crowded, 128)
    few = entries.join(crowded, ["seg", "key"], "left_anti") if n_crowded else entries
    distance = F.bit_count(F.col("p").bitwiseXOR(F.col("fp")))
    near = probes.join(few, ["seg", "key"]).where((distance <= radius) & (F.col("p") != F.col("fp"))).select("p", "fp")
    found = near
    if n_crowded:
        # masks over the other bits: at most radius - (bits used in the segment), as signed 64-bit numbers
        other = [[b for b in range(BITS) if not i * width <= b < (i + 1) * width] for i in range(segments)]
        full: list[tuple[int, int, int]] = []
        for i in range(segments):
            level, seen = {0}, {0}
            full.append((i, 0, 0))
            for bits in range(1, radius + 1):
                level = {m | (1 << b) for m in level for b in other[i] if not m >> b & 1}
                seen |= level
                full += [(i, bits, _signed(m)) for m in level]
        spark = distinct.sparkSession
        flips = F.broadcast(spark.createDataFrame(full, "seg int, bits int, flip bigint"))  # fixed size: set by the parameters
        hit = probes.join(crowded, ["seg", "key"]).select(
            "p", "seg", F.bit_count("mask").alias("used"), F.col("p").bitwiseXOR(F.expr(f"shiftleft(mask, seg * {width})")).alias("moved")
        )
        asked = hit.join(flips, "seg").where(F.col("bits") + F.col("used") <= radius)
        asked = asked.select("p", F.col("moved").bitwiseXOR(F.col("flip")).alias("fp")).where("p <> fp")
        found = near.union(asked.join(prints, "fp", "left_semi").select("p", "fp"))
    return found.select(F.least("p", "fp").alias("a"), F.greatest("p", "fp").alias("b")).distinct()


def near_duplicates(documents: DataFrame, width: int = 3, radius: int = 3, segments: int = 2) -> DataFrame:
    """(doc_id, fingerprint in 16 hex digits, component_id) for every row of ``documents(doc_id, text)``.

    ``component_id`` is the smallest doc_id that links reach. Rows with the same fingerprint are one class, so
    copies are never paired with each other. Null and blank texts have fingerprint zero and are linked like any other.
    Repeated rows stay. A null doc_id keeps its row; it takes part in its class and names it only
    where the class has no other id (then the component is null). Other columns are not read.
    """
    prints = cut_lineage(fingerprints(documents, width))
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    pairs = links(classes.select(F.col("fingerprint").alias("fp")), radius, segments)
    joined = connected_components(pairs).select(F.col("node").alias("fingerprint"), "component")
    grouped = classes.join(joined, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of = grouped.join(least, "component").select("fingerprint", "component_id")
    # rows of one class may be a third of the table: they are dealt over salts, the class rows copied to each
    salts = 16
    rows = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    wide = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(wide.hint("merge"), ["fingerprint", "salt"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
