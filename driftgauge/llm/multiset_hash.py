"""Document fingerprints as a homomorphic multiset hash of paragraph pieces.

A text is a multiset of units (paragraphs cut after line ends and after sentence ends, which belong to them). Each unit is hashed to a wide vector and the vectors are
added: ``WIDE`` lanes modulo 2^32 decide equality, ``SIGNS`` lanes of +1 and -1 modulo 2^16 estimate the size of differences. The
sum does not depend on the order of units, and units can be added to or taken from a fingerprint without the text.
Only DataFrame expressions are used.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from driftgauge.llm.text import whole

ENDS = "\n.!?"
WIDE, SIGNS = 8, 64
MOD_WIDE, MOD_SIGN = 1 << 32, 1 << 16
LANES = WIDE + SIGNS


def units(text: Column) -> Column:
    """Pieces up to and with each line or sentence end, without surrounding spaces; empty ones are left out. A unit has its end, so another end is another unit."""
    pieces = F.transform(F.split(text, f"(?<=[{ENDS}])", -1), lambda u: F.trim(u))
    return F.filter(pieces, lambda u: u != "")


def unit_vector(unit: Column) -> Column:
    wide = [h for j in range(WIDE // 2) for x in [F.xxhash64(unit, F.lit(j))] for h in (x.bitwiseAND(F.lit(MOD_WIDE - 1)), F.shiftrightunsigned(x, 32))]
    signs = F.transform(F.sequence(F.lit(0), F.lit(SIGNS - 1)), lambda b: F.getbit(F.xxhash64(unit, F.lit(WIDE)), b).cast("bigint") * 2 - 1)
    return F.concat(F.array(*wide), signs)


def zero() -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), LANES)


def insert(vector: Column, pieces: Column, sign: int = 1) -> Column:
    """Add the units to a vector of lane sums (take them out with ``sign=-1``)."""
    return F.aggregate(pieces, vector, lambda acc, u: F.zip_with(acc, unit_vector(u), lambda a, b: a + b * sign))


def combine(left: Column, right: Column) -> Column:
    """Fingerprint sums of the union of two multisets."""
    return F.zip_with(left, right, lambda a, b: a + b)


def reduced(vector: Column) -> Column:
    return F.transform(vector, lambda v, i: F.pmod(v, F.when(i < WIDE, F.lit(MOD_WIDE)).otherwise(F.lit(MOD_SIGN))))


def printed(vector: Column) -> Column:
    """Lower-case hexadecimal lanes: eight digits for a wide one, four for a sign one."""
    text = F.transform(reduced(vector), lambda v, i: F.lpad(F.lower(F.hex(v)), F.when(i < WIDE, F.lit(8)).otherwise(F.lit(4)), F.lit("0")))
    return F.array_join(text, "")


def likeness(left: Column, right: Column) -> Column:
    """Estimated likeness of two multisets in [0, 1]: twice the product over the sum of squares of the sign lanes."""
    centred = lambda v: F.transform(F.slice(reduced(v), WIDE + 1, SIGNS), lambda x: F.when(x >= MOD_SIGN // 2, x - MOD_SIGN).otherwise(x).cast("double"))
    a, b = centred(left), centred(right)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    product = total(F.zip_with(a, b, lambda x, y: x * y))
    squares = total(F.zip_with(a, b, lambda x, y: x * x + y * y))
    value = F.when(squares > 0, 2 * product / squares).otherwise(F.lit(0.0))
    same = reduced(left) == reduced(right)
    return F.when(same, F.lit(1.0)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def with_next(documents: DataFrame, most_parts: int = 1 << 16, part_rows: int = 2000, **made: Column) -> DataFrame:
    """(doc_id, text, next_text) in ascending order of doc_id; the last document is followed by the first.

    Columns ``made`` from the text are made once and come along, those of the next text as ``next_<name>``.

    Ids are cut into parts of equal width, a row's part being known from its id alone, and texts are
    shuffled once, by part. The first row of a part is also sent to the part before, so no part needs to look into another.
    Null ids come first; equal ids are ordered by the digest of their text.
    """
    text = whole(F.col("text"))
    docs = documents.select("doc_id", text.alias("text"))
    names = ["text", *made]
    span = docs.agg(F.count("*").alias("n"), F.min("doc_id").cast("double").alias("low"), F.max("doc_id").cast("double").alias("high")).first()
    parts = max(1, min(most_parts, math.ceil(span["n"] / part_rows)))
    low, width = span["low"] or 0.0, max(((span["high"] or 0.0) - (span["low"] or 0.0) + 1) / parts, 1.0)
    part = F.coalesce(F.floor((F.col("doc_id").cast("double") - low) / width).cast("int"), F.lit(-1))
    docs = docs.withColumn("part", part)
    # at most most_parts + 1 rows, so the window and the broadcast are bounded
    firsts = docs.groupBy("part").agg(F.min("doc_id").alias("first_id"), F.lit(1).alias("one"))
    around = W.Window.partitionBy("one").orderBy("part")
    whole_ring = around.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    firsts = firsts.select("part", "first_id", F.coalesce(F.lag("part").over(around), F.last("part").over(whole_ring)).alias("part_before"))
    opens = F.col("doc_id").eqNullSafe(F.col("first_id"))
    places = F.when(opens, F.array(F.struct("part", F.lit(0).alias("guest")), F.struct(F.col("part_before").alias("part"), F.lit(1).alias("guest")))).otherwise(
        F.array(F.struct("part", F.lit(0).alias("guest")))
    )
    docs = docs.select("doc_id", "part", "text", *(c.alias(n) for n, c in made.items()))
    rows = docs.join(F.broadcast(firsts), "part").select("doc_id", *names, F.explode(places).alias("at")).select("doc_id", *names, "at.part", "at.guest")
    order = W.Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.md5("text"))
    nexts = {f"next_{n}": F.lead(n).over(order) for n in names}
    return rows.withColumns(nexts).where("guest = 0").select("doc_id", *names, *nexts)


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, with their likeness and that to the next document.

    The edited text has the last ``floor(n_chars / 4)`` code points replaced by the first as many of the next document by
    ascending doc_id (:func:`with_next`). Its fingerprint is made from that of the text: the units after the last unit end before
    the edit are taken out and the new ones added. Null text counts as empty; a text without units has the zero
    fingerprint. A repeated row is followed by its copy, a table of one document by itself. An empty table gives no rows. Other
    columns are not read.
    """
    cut_ends = lambda c: F.translate(c, ENDS, "\n" * len(ENDS))
    df = with_next(documents, vector=insert(zero(), units(F.col("text")))).withColumn("n_chars", F.length("text").cast("bigint"))
    quarter = F.expr("cast(n_chars div 4 as int)")
    df = df.select(
        "doc_id", "n_chars", "text", F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter).alias("kept"),
        F.substring("next_text", F.lit(1), quarter).alias("head"), "vector", "next_vector",
    )
    # the unit that the edit cuts starts after the last unit end of what is kept
    df = df.withColumn("closed", F.length("kept") - F.length(F.substring_index(cut_ends(F.col("kept")), "\n", -1)))
    df = df.withColumn("edited", F.concat("kept", "head")).drop("kept", "head")
    tail = lambda c: units(F.substring(c, F.col("closed") + 1, F.length(c)))
    edited = insert(insert(F.col("vector"), tail(F.col("text")), -1), tail(F.col("edited")))
    df = df.select("doc_id", "n_chars", "vector", "next_vector", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), edited.alias("edited_vector"))
    return df.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("vector")).alias("fingerprint"), printed(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
