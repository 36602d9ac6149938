"""Near-duplicates by a similarity of shingle sets: wide SimHash prints, multi-index hashing and an exact check.

A print of 64 bits is too coarse for a similarity: two sets of shingles with Jaccard similarity 0.8 differ in about 10 of its bits. Here
a print has 768 bits. The share of bits in which two prints differ estimates the angle between the sets: a Jaccard
similarity J is at ``768 * acos(2J / (1 + J)) / pi`` bits on average (116 for 0.8, with a standard deviation of 10). Prints only find
candidates, up to 4 deviations beyond that mean (7 for sets of under 32 shingles, whose prints lie farther apart); then the shingle sets themselves decide. Two prints are compared if they differ by at most one bit in one
of the indexed segments, whose width and number follow the number of different prints (:func:`planned_index`).
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.components import components_in_task
from driftgauge.llm.simhash import shingle_hashes
from driftgauge.llm.storage import collected, dropped, stored
from driftgauge.llm.text import lower_words, whole
from driftgauge.session import measured_broadcast

WORDS = 12
BITS = 64 * WORDS
# pairs at the limit that meet under no key, classes met by chance, segments joined at a time, and the number of classes below which keys do not get narrower
MISS, CHANCE, TURN, LEAST_CLASSES = 0.003, 16, 12, 1 << 20
# sets of fewer shingles are small
SMALL = 32
NAMES = [f"w{i}" for i in range(WORDS)]
BLOCK = 255 * 64
Exact = Callable[[DataFrame], DataFrame]
# takes classes with their bases (cid, base) and gives stored tables of what base_bounds says of their sets
Bounds = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def _spread(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` independent 64-bit words per hash, by the splitmix64 finaliser."""
    z = hashes[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _different(text: str | None, width: int) -> np.ndarray:
    """Hashes of the different shingles."""
    blocks = list(shingle_hashes(lower_words(text), width))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, dtype=np.uint64)


def wide_print(text: str | None, width: int) -> np.ndarray:
    """The print as ``WORDS`` unsigned words; each different shingle counts once, no word gives zeros."""
    return _print_of(_different(text, width))


def _print_of(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(WORDS, dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), BLOCK):
        part = _spread(hashes[start : start + BLOCK]).astype("<u8", copy=False)
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        # sums of up to 255 rows fit a byte
        for low in range(0, len(bits), 255):
            ones += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def wide_prints(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, small, w0 ... w11) for every row of ``documents(doc_id, text)``; ``small`` tells sets of under ``SMALL`` shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, small = np.zeros((batch.num_rows, WORDS), dtype=np.uint64), np.zeros(batch.num_rows, dtype=bool)
            for i, text in enumerate(batch.column(2)):
                hashes = _different(text.as_py(), width)
                prints[i], small[i] = _print_of(hashes), len(hashes) < SMALL
            prints = prints.view(np.int64)
            columns = [pa.array(np.ascontiguousarray(prints[:, i])) for i in range(WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small), *columns], ["doc_id", "text_hash", "small", *NAMES])

    text = whole(F.col("text"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, text_hash bigint, small boolean, " + ", ".join(f"{n} bigint" for n in NAMES))


def greatest_distance(least: float) -> int:
    return math.floor(BITS * math.acos(2 * least / (1 + least)) / math.pi)


def candidate_distance(least: float, deviations: int) -> int:
    """Bits within which pairs at ``least`` lie; sets of four and five shingles are the farthest, at 144 on average for 0.8."""
    share = math.acos(2 * least / (1 + least)) / math.pi
    return math.ceil(BITS * share + deviations * math.sqrt(BITS * share * (1 - share)))


@dataclass(frozen=True)
class Index:
    """``segments`` keys of ``bits`` bits for each print."""

    bits: int
    segments: int

    @property
    def masks(self) -> list[int]:
        """The ball of one bit: flips of a key that has zeros there, and the key itself."""
        return [0, *(1 << b for b in range(self.bits))]


def planned_index(classes: int, least: float, miss: float = MISS, chance: int = CHANCE) -> Index:
    """Key width and number of segments for so many classes.

    The width is the smallest at which a class meets ``chance`` others by chance, so candidates grow in proportion to the classes. Two prints at
    ``least`` differ in a share ``q`` of their bits; a key of ``b`` bits finds them with probability ``(1-q)^b + b q (1-q)^(b-1)``, and there are as many
    segments as it takes for them to meet in none with probability ``miss`` (taking segments as independent).
    """
    q, classes = math.acos(2 * least / (1 + least)) / math.pi, max(classes, LEAST_CLASSES)
    for bits in range(12, 44):
        met = (1 - q) ** bits + bits * q * (1 - q) ** (bits - 1)
        segments = math.ceil(math.log(miss) / math.log1p(-met))
        if classes * segments * (bits + 1) / 2**bits <= chance:
            break
    return Index(bits, segments)


def with_keys(classes: DataFrame, index: Index) -> DataFrame:
    """(cid, keys): the number of each segment above its bits. Segments take the bits of the print in turn, then in the order of further fixed draws."""
    per_turn = BITS // index.bits
    rng, order = np.random.default_rng(BITS), []
    while len(order) < index.segments:
        turn = rng.permutation(BITS) if order else np.arange(BITS)
        order += [turn[i * index.bits : (i + 1) * index.bits] for i in range(per_turn)]
    picked = np.concatenate(order[: index.segments])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.left_shift(np.int64(1), np.arange(index.bits, dtype=np.int64))
        numbers = np.arange(index.segments, dtype=np.int64) << index.bits
        for whole_batch in batches:
            for batch in (whole_batch.slice(i, 1024) for i in range(0, whole_batch.num_rows, 1024)):
                prints = np.stack([np.asarray(batch.column(n)) for n in NAMES], axis=1).astype("<i8")
                bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, picked]
                keys = bits.reshape(len(prints), index.segments, index.bits) @ values + numbers
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), index.segments).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["cid", "keys"])

    return classes.select("cid", *NAMES).mapInArrow(run, "cid bigint, keys array<bigint>")


def _verified(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """The different pairs (a, b, distance) whose complete prints differ in at most ``most`` bits, or in the limit ``most`` of either class if they have one."""
    own = F.col("most") if "most" in classes.columns else F.lit(most)
    side = lambda of: classes.select(F.col("cid").alias(of), own.alias(f"{of}_most"), *(F.col(n).alias(f"{of}_{n}") for n in NAMES))
    joined = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    distance = sum((F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in NAMES), F.lit(0))
    return joined.where(distance <= F.greatest("a_most", "b_most")).select("a", "b", distance.alias("distance"))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(cid, hashes) with the different shingle hashes of ``texts(cid, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, text in zip(batch.column(0), batch.column(1)):
                hashes = _different(text.as_py(), width).view(np.int64)
                one = pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([pa.array([cid.as_py()], pa.int64()), one], ["cid", "hashes"])

    return texts.mapInArrow(run, "cid bigint, hashes array<bigint>")


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The different pairs (a, b) whose sets in ``sets(cid, hashes)`` have a Jaccard similarity of ``least`` or more."""
    side = lambda of: sets.select(F.col("cid").alias(of), F.col("hashes").alias(f"{of}_set"))
    joined = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("a_set", "b_set"))
    return joined.where(both / (F.size("a_set") + F.size("b_set") - both) >= least).select("a", "b")


def set_bounds(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(cid, size, room) of ``sets(cid, hashes)`` and the pairs (a, b) that have a hash of two or three sets in common.

    Two sets with no such hash share at most the hashes that lie in four sets or more. For a Jaccard similarity of ``least`` the number of these in either set has to
    be ``least / (1 + least)`` of both sizes: so ``room`` is the largest size of a set that may be alike, and other pairs need no comparison.
    """
    one = sets.select("cid", F.lit(0).cast("bigint").alias("base"), F.size("hashes").alias("n"), F.col("hashes").alias("apart"))
    bounds, common = _delta_bounds(one, least)
    return bounds.drop("base"), common


def base_bounds(sets: DataFrame, based: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(cid, base, size, room) of ``based(cid, base)``, and the links (a, b) of classes with their bases and with others of the base that have a rare difference from it in common.

    ``sets(cid, hashes)`` has the classes and the bases. With the hashes in which each of two sets differs from a base, the two differ in all but those that both have.
    They are alike if they differ in at most ``(1 - least) / (1 + least)`` of both sizes, so how many differences they need in common follows from a number of each set: ``size``, which is
    below zero for sets close to the base. Copies of one text with own edits have few differences in common, and most of their pairs are ruled out (``room``, as in :func:`set_bounds`).
    """
    bases = sets.join(based.select(F.col("base").alias("cid")).distinct(), "cid", "left_semi").select(F.col("cid").alias("base"), F.col("hashes").alias("base_hashes"))
    both = sets.join(based, "cid").join(bases, "base")
    apart = F.concat(F.array_except("hashes", "base_hashes"), F.array_except("base_hashes", "hashes"))
    deltas = stored(both.select("cid", "base", F.size("hashes").alias("n"), F.size("base_hashes").alias("base_n"), apart.alias("apart")), "wide-deltas")
    same = (F.col("n") + F.col("base_n") - F.size("apart")) / 2
    near = deltas.where((F.col("cid") != F.col("base")) & (same / (F.col("n") + F.col("base_n") - same) >= least))
    bounds, common = _delta_bounds(deltas, least)
    links = stored(near.select(*_pair("cid", "base")).union(alike(common, sets, least)), "wide-base-links")
    dropped(deltas, common)
    return bounds, links


def _delta_bounds(deltas: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(cid, base, size, room) and the pairs (a, b) with a rare difference in common of ``deltas(cid, base, n, apart)``: sets of ``n`` hashes that differ in ``apart`` from a base."""
    rows = deltas.select("cid", "base", F.explode("apart").alias("hash"))
    of = rows.groupBy("base", "hash").agg(F.count("*").alias("n"), F.min("cid").alias("low"), F.max("cid").alias("high"), F.bit_xor("cid").alias("all"))
    # of three ids, all but the lowest and the highest
    middle = F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    rare = stored(of.where("n <= 3").select("n", "low", "high", F.when(F.col("n") == 3, middle).alias("middle")), "wide-rare")
    ids = F.when(F.col("n") == 1, F.array("low")).when(F.col("n") == 2, F.array("low", "high")).otherwise(F.array("low", "middle", "high"))
    own = rare.select(F.explode(ids).alias("cid")).groupBy("cid").agg(F.count("*").alias("own"))
    sizes = deltas.select("cid", "base", "n", F.size("apart").alias("differ")).join(own, "cid", "left")
    shared = F.col("differ") - F.coalesce("own", F.lit(0))
    # a set that differs from its base in all its hashes, as from an empty one, has its number of hashes as its size
    size = F.round((F.col("differ") - F.col("n") * ((1 - least) / (1 + least))) * ((1 + least) / (2 * least)), 6)
    bounds = stored(sizes.select("cid", "base", size.alias("size"), (shared * ((1 + least) / least) - size + 1e-5).alias("room")), "wide-bounds")
    two = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    pairs = F.when(F.col("n") == 2, F.array(two("low", "high"))).otherwise(F.array(two("low", "middle"), two("low", "high"), two("middle", "high")))
    common = stored(rare.where("n > 1").select(F.explode(pairs).alias("pair")).select("pair.*").distinct(), "wide-common")
    dropped(rare)
    return bounds, common


def _possible(bounds: DataFrame | None, other: str) -> Column:
    """Whether a class (base, size, room) and one with the prefix ``other`` may be alike; true where they have no common base."""
    if bounds is None:
        return F.lit(True)
    fits = (F.col("room") >= F.col(f"{other}size")) & (F.col(f"{other}room") >= F.col("size"))
    return F.coalesce((F.col("base") != F.col(f"{other}base")) | fits, F.lit(True))


def _sized(bounds: DataFrame | None, prefix: str = "") -> list[Column]:
    return [] if bounds is None else [F.col(n).alias(prefix + n) for n in ("base", "size", "room")]


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _contracted(joined: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of ``links`` together with those of ``joined(node, component)``."""
    pairs = links.select("a", "b")
    return stored(components_in_task(pairs if joined is None else joined.toDF("a", "b").union(pairs)), "wide-components")


def _placed(table: DataFrame, joined: DataFrame | None, bounds: DataFrame | None = None) -> DataFrame:
    """``table(cid, ...)`` with the component of each class, which is the class itself while it has no link, and its ``bounds(cid, base, size, room)``, null where unknown."""
    if bounds is not None:
        table = table.join(bounds, "cid", "left")
    if joined is None:
        return table.withColumn("of", F.col("cid"))
    found = table.join(joined.toDF("cid", "component"), "cid", "left")
    return found.withColumn("of", F.coalesce("component", "cid")).drop("component")


def _apart(pairs: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Those of ``pairs(a, b)`` whose classes are of different components."""
    if joined is None:
        return pairs.select("a", "b")
    swapped = pairs.distinct().select(F.col("b"), F.col("a").alias("cid"))
    one = _placed(swapped, joined).select(F.col("b").alias("cid"), F.col("cid").alias("a"), F.col("of").alias("a_of"))
    return _placed(one, joined).where("a_of <> of").select("a", F.col("cid").alias("b"))


def _phases(segments: int) -> Iterator[tuple[int, int]]:
    """Ranges of segments after which components are found; each ends eight times as far as the one before."""
    start, end = 0, 2
    while start < segments:
        yield start, min(end, segments)
        start, end = end, end * 8


def _probed(entries: DataFrame, index: Index) -> DataFrame:
    """Every entry under the keys of its ball."""
    masks = F.array(*(F.lit(m).cast("bigint") for m in index.masks))
    balls = entries.withColumn("mask", F.explode(masks)).where(F.col("key").bitwiseAND(F.col("mask")) == 0)
    return balls.withColumn("key", F.col("key").bitwiseOR(F.col("mask"))).drop("mask")


def _bases(near: DataFrame, failed: DataFrame, known: DataFrame | None) -> DataFrame:
    """(cid, base) for the classes of ``failed(a, b)`` and of ``known``, stored: one base for each group that they join, the one that most have already, else the class with most pairs in ``near(a, b)``."""
    pairs, before = failed.select("a", "b"), None if known is None else known.select("cid", "base")
    groups = stored(components_in_task(pairs if before is None else pairs.union(before)).toDF("cid", "group"), "wide-near-groups")
    rated = near.select("a").union(near.select("b")).toDF("cid").groupBy("cid").agg(F.count("*").alias("n")).withColumn("was", F.lit(False))
    if before is not None:
        rated = rated.union(before.groupBy("base").agg(F.count("*").alias("n")).withColumn("was", F.lit(True)))
    best = groups.join(rated, "cid").groupBy("group").agg(F.max(F.struct("was", "n", "cid"))["cid"].alias("base"))
    return stored(groups.join(best, "group").select("cid", "base"), "wide-based")


def _rebased(near: DataFrame, failed: DataFrame, known: DataFrame | None, joined: DataFrame | None, bounds: Bounds) -> tuple[DataFrame | None, DataFrame]:
    """Components and bounds once the classes of ``failed`` pairs are compared with the bases of their groups, and those with a rare difference in common with each other."""
    based = _bases(near, failed, known)
    found, links = bounds(based)
    if links.take(1):
        joined = _contracted(joined, links)
    dropped(*([known] if known else []), based, links)
    return joined, found


def _led(members: DataFrame) -> DataFrame:
    """The pairs (a, b) of each class of ``members(cid, key)`` with one other: the class that is under most keys leads a key, and each class takes the leader that is under most."""
    rated = stored(members.join(members.groupBy("cid").agg(F.count("*").alias("n")), "cid"), "crowded-rated")
    # a row for each crowded key
    first = measured_broadcast(stored(rated.groupBy("key").agg(F.max(F.struct("n", "cid")).alias("first")), "crowded-first"), 64)
    best = rated.select("cid", "key").join(first, "key").groupBy("cid").agg(F.max("first")["cid"].alias("leader"))
    return best.where("cid <> leader").select(*_pair("cid", "leader"))


def _checked(pairs: DataFrame, exact: Exact | None) -> DataFrame:
    """Those of ``pairs(a, b)`` that are links, stored."""
    pairs = pairs.select("a", "b").distinct()
    return exact(pairs) if exact else stored(pairs, "wide-links")


def _sparse(
    keyed: DataFrame, classes: DataFrame, joined: DataFrame | None, known: DataFrame | None, most: int, index: Index, hint: DataFrame, exact: Exact | None, bounds: Bounds | None
) -> tuple[DataFrame | None, DataFrame | None]:
    """Components (node, component) once the pairs under keys that are not crowded (``hint``) are links too, and what is known of the sets; only pairs of different components that may be alike are compared."""
    for begin, end in _phases(index.segments):
        parts = []
        # some segments at a time, so that the balls of all segments never lie on disk together
        for start in range(begin, end, TURN):
            some = _placed(keyed.select("cid", F.slice("keys", start + 1, min(TURN, end - start)).alias("keys")), joined, known)
            some = some.select("cid", "of", *_sized(known), F.explode("keys").alias("key"))
            probes = _probed(some, index).select("key", F.col("cid").alias("p"), F.col("of").alias("p_of"), *_sized(known, "p_"))
            met = probes.join(some.join(hint, "key", "left_anti"), "key").where((F.col("p_of") != F.col("of")) & _possible(known, "p_"))
            parts.append(stored(_verified(met.select(*_pair("p", "cid")), classes, most), "wide-candidates"))
            collected(classes.sparkSession)
        found = stored(reduce(DataFrame.unionByName, parts).distinct(), "wide-found")
        dropped(*parts)
        if found.take(1):
            links = _checked(found, exact)
            if links.take(1):
                joined = _contracted(joined, links)
            if bounds and end < index.segments:
                # classes that were near another without being alike, as in a large group of edited copies: later phases would meet their pairs again
                failed = stored(found.select("a", "b").join(links.select("a", "b"), ["a", "b"], "left_anti"), "wide-failed")
                if failed.take(1):
                    joined, known = _rebased(found, failed, known, joined, bounds)
                dropped(failed)
            dropped(links)
        dropped(found)
        collected(classes.sparkSession)
    return joined, known


def _crowded(
    members: DataFrame, classes: DataFrame, joined: DataFrame | None, known: DataFrame | None, most: int, crowded: int, exact: Exact | None
) -> DataFrame | None:
    """Components (node, component) once the pairs under the crowded keys of ``members(cid, key)`` are links too."""
    left, spared, pending, turn = members, None, None, 0
    while True:
        sizes = stored(left.groupBy("key").agg(F.count("*").alias("n")), "crowded-sizes")
        counted = stored(left.join(measured_broadcast(sizes, 64), "key"), "crowded-counted")
        # some ``crowded`` leaders a key, by a draw that is the same under every key, or all classes once they are no more than that
        draw = F.pmod(F.xxhash64("cid", F.lit(turn)), F.lit(1 << 30)) * F.col("n") < F.lit(crowded << 30)
        leaders = stored(counted.where(draw).select("key", "cid"), "crowded-leaders")
        led = measured_broadcast(_placed(leaders, joined, known).select("key", F.col("cid").alias("leader"), F.col("of").alias("leader_of"), *_sized(known, "leader_")), 64)
        met = _placed(members, joined, known).join(led, "key").where((F.col("of") != F.col("leader_of")) & _possible(known, "leader_")).select(*_pair("cid", "leader"))
        near = stored(_verified(met, classes, most), "crowded-near")
        # only the nearest partner of each class is checked now; the others matter where components stay apart
        sides = near.union(near.select("b", "a", "distance")).toDF("cid", "leader", "distance")
        nearest = sides.groupBy("cid").agg(F.min(F.struct("distance", "leader"))["leader"].alias("leader"))
        links = _checked(nearest.select(*_pair("cid", "leader")), exact)
        if links.take(1):
            joined = _contracted(joined, links)
        pending = near.select("a", "b") if pending is None else pending.union(near.select("a", "b"))
        going = stored(counted.where(F.col("n") > crowded).select("cid", "key"), "crowded-going")
        if not going.take(1):
            break
        rest = _placed(going.join(measured_broadcast(leaders, 64), ["cid", "key"], "left_anti"), joined)
        settled = measured_broadcast(_placed(leaders, joined).select("key", "of").distinct(), 64)
        met = stored(rest.join(settled, ["key", "of"], "left_semi").select("cid", "key"), "crowded-met")
        spared = met if spared is None else spared.union(met)
        left = stored(rest.join(settled, ["key", "of"], "left_anti").select("cid", "key"), "crowded-open")
        collected(classes.sparkSession)
        turn += 1
    more = _apart(pending, joined)
    if spared is not None:
        parts = stored(_placed(spared, joined, known), "crowded-parts")
        counts = parts.groupBy("key", "of").agg(F.count("*").alias("n"))
        largest = counts.groupBy("key").agg(F.max(F.struct("n", "of"))["of"].alias("main"), F.count("*").alias("components"))
        split = stored(largest.where("components > 1").select("key", "main"), "crowded-split")
        if split.take(1):
            parts = parts.join(measured_broadcast(split, 64), "key")
            outside = parts.where("of <> main").select("key", F.col("cid").alias("p"), F.col("of").alias("other"), *_sized(known, "p_"))
            asked = parts.join(outside, "key").where((F.col("of") != F.col("other")) & _possible(known, "p_")).select(*_pair("p", "cid"))
            asked = _verified(asked, classes, most).select("a", "b")
            more = more.union(asked)
    more = _checked(stored(more, "crowded-apart"), exact)
    return _contracted(joined, more) if more.take(1) else joined


def similar_components(classes: DataFrame, most: int, index: Index, crowded: int = 16, exact: Exact | None = None, bounds: Bounds | None = None) -> DataFrame:
    """(node, component) for the classes of ``classes(cid, w0 ... w11)`` that have links.

    Links join classes whose prints differ in at most ``most`` bits and meet under a key and, with ``exact``, pass its check: it takes
    different pairs (a, b) and gives a stored table of those that are links. Every class is stored under
    its segments and looks up the keys in the ball of one bit (only zeros are set: of two segments that differ in one bit, the
    one with the zero finds the other). Segments are taken in phases, and components are found after each: later phases compare only
    classes of different components, so a large group of similar texts, which the first phase joins, is not paired again. Under a key with
    up to ``crowded`` classes all such pairs are verified. Under a larger one about ``crowded`` leaders are drawn from all who look the
    key up and compared with all of other components, those that are then in the component of a leader are spared, and the next leaders
    are drawn from the others until none is left. Two spared classes, or a class and a leader that was not its nearest, are checked
    only if they ended in different components: of spared ones, all that are outside the largest component under the key with all of other
    components. So the components are those of all pairs that meet under a key. With ``bounds`` (:func:`base_bounds`), classes under crowded keys are first compared with one base for each
    group, and later also those that were near another without being alike; from then on, classes of one base are compared only where their differences from it leave room for a link; those that share a rare difference are checked at once.
    """
    keyed = stored(with_keys(classes, index), "wide-keys")
    entries = keyed.select("cid", F.explode("keys").alias("key"))
    shared = stored(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("key"), "crowded-keys")
    hint = measured_broadcast(shared, 64)
    joined = known = members = None
    if shared.take(1):
        members = stored(_probed(entries, index).join(hint, "key", "left_semi").select("cid", "key"), "crowded-members")
        if bounds:
            # any class serves as a base, also one that is far, so that classes at the edge of a group have one
            near = stored(_led(members), "crowded-led")
            joined, known = _rebased(near, near, known, joined, bounds)
            dropped(near)
            collected(classes.sparkSession)
    joined, known = _sparse(keyed, classes, joined, known, most, index, hint, exact, bounds)
    if members:
        # keys whose classes are all of one component have nothing to add
        kinds = _placed(members, joined).groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high"))
        several = stored(kinds.where("low <> high").select("key"), "crowded-several")
        if several.take(1):
            open_keys = stored(members.join(measured_broadcast(several, 64), "key", "left_semi"), "crowded-open-keys")
            joined = _crowded(open_keys, classes, joined, measured_broadcast(known, 64) if known else None, most, crowded, exact)
    dropped(keyed)
    return classes.sparkSession.createDataFrame([], "node bigint, component bigint") if joined is None else joined


def similar_documents(documents: DataFrame, width: int = 5, least: float = 0.8, crowded: int = 16) -> DataFrame:
    """(doc_id, text_hash, component_id, first) for every row of ``documents(doc_id, text)``.

    ``component_id`` is the smallest doc_id that links reach, ``first`` marks the one document of the group that has it (of
    several texts of that id, the one with the smallest hash). Links join texts whose sets of ``width``-word shingles have a
    Jaccard similarity of ``least`` or more, by the sets themselves (as 64-bit hashes); texts with fewer words are one shingle. Equal prints are one class, so copies are never paired
    with each other. Null and blank texts are one class. Repeated rows stay and are all marked alike. A null doc_id ranks
    last: it names its group only where there is no other (the component is then null). Other columns are not read.
    """
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    prints = stored(wide_prints(documents, width), "wide-prints")
    totals = prints.groupBy(*NAMES).agg(F.min(place).alias("least"), F.count("*").alias("n"), F.max("small").alias("small"))
    near, far = candidate_distance(least, 4), candidate_distance(least, 7)
    totals = totals.withColumn("most", F.when(F.col("small"), far).otherwise(near)).drop("small")
    classes = stored(totals.withColumn("cid", F.monotonically_increasing_id()), "wide-classes")

    def sets_of(asked: DataFrame) -> DataFrame:
        one = stored(classes.join(asked, "cid", "left_semi").select("cid", F.col("least.id").alias("__id"), F.col("least.hash").alias("__hash")), "wide-asked")
        text = whole(F.col("text"))
        texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
        sets = stored(shingle_sets(texts.join(measured_broadcast(one, 64), same).select("cid", "text").dropDuplicates(["cid"]), width), "wide-sets")
        dropped(one)
        return sets

    def exact(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select("a").union(pairs.select("b")).toDF("cid").distinct())
        links = stored(alike(pairs, sets, least), "wide-links")
        dropped(sets)
        return links

    def bounds(based: DataFrame) -> tuple[DataFrame, DataFrame]:
        sets = sets_of(based.select("cid").union(based.select("base")).distinct())
        found = base_bounds(sets, based, least)
        dropped(sets)
        return found

    index = planned_index(classes.count(), least)
    joined = similar_components(classes, far, index, crowded, exact, bounds).select(F.col("node").alias("cid"), "component")
    grouped = classes.join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    names = grouped.groupBy("component").agg(F.min("least").alias("leader"))
    of = stored(grouped.join(names, "component").select(*NAMES, "n", "leader"), "wide-groups")
    # fewer than 1000 classes can have over a thousandth of the rows each: these are broadcast, so no task meets all rows of one
    bound = max(1000, (of.agg(F.sum("n")).first()[0] or 0) // 1000)
    large = F.broadcast(of.where(F.col("n") > bound).drop("n"))
    prints = prints.drop("small")
    rows = prints.join(large, NAMES)
    others = prints.join(large.select(*NAMES), NAMES, "left_anti").join(of.where(F.col("n") <= bound).drop("n"), NAMES)
    both = rows.unionByName(others)
    return both.select("doc_id", "text_hash", F.col("leader.id").alias("component_id"), place.eqNullSafe(F.col("leader")).alias("first"))
