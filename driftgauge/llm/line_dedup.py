"""Substring dedup by hashed units: the earliest occurrence of a repeated passage stays, later ones are cut out.

Units are the sentences of lines, of any length. Digests of all normalised units are grouped globally; a unit is repeated when its earliest
occurrence is elsewhere. Runs of neighbouring repeated units with enough words are cut, so single short sentences that happen to recur stay.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.storage import dropped, stored
from driftgauge.llm.text import LOWER_BYTES, whole

# where a unit ends: a line break, or an end of sentence before a blank
ENDS = re.compile(r"[.!?]+(?=[ \t\n\x0b\f\r]|\Z)[ \t\x0b\f\r]*\n?|\n")
UNITS = "doc_id bigint, text_hash bigint, at int, h bigint, g bigint"
NO_SPANS = "array<struct<start:bigint,stop:bigint,first_doc_id:bigint>>"


def text_units(text: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, stop, words) of the units of a text that have words.

    Offsets count code points; ``stop`` takes in the blanks or the line break after it. Words have A-Z lower-cased, and the last one is without ``.!?`` at its end.
    """
    start, n = 0, len(text)
    while start < n:
        end = ENDS.search(text, start)
        stop = end.end() if end else n
        words = text[start:stop].encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
        if words:
            last = words[-1].rstrip(b".!?")
            words[-1:] = [last] if last else []
            if words:
                yield start, stop, words
        start = stop


def units(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at, h, g): the digest of every unit as two numbers, ``at`` counting the units of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])
        md5 = hashlib.md5
        for batch in batches:
            ids, hashes, places, digests = [], [], [], []

            def packed() -> pa.RecordBatch:
                pairs = pa.py_buffer(b"".join(digests))
                both = pa.Array.from_buffers(pa.int64(), 2 * len(digests), [None, pairs])
                h, g = (both.take(pa.array(range(i, 2 * len(digests), 2))) for i in (0, 1))
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), h, g], schema=kind)

            for i, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for at, (_, _, words) in enumerate(text_units(text.as_py())):
                    digests.append(md5(b" ".join(words), usedforsecurity=False).digest())
                    ids.append(i)
                    hashes.append(text_hash)
                    places.append(at)
                if len(digests) >= 20_000:
                    yield packed()
                    ids, hashes, places, digests = [], [], [], []
            if digests:
                yield packed()

    text = whole(F.col("text"))
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, UNITS)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], counted: str) -> DataFrame:
    """``left`` joined to ``right``, whose column ``counted`` says how many rows of ``left`` have its key.

    At most 1000 keys can hold over a thousandth of these rows each: they are broadcast, so no task meets all rows of one; the others are small enough for a shuffle.
    """
    bound = max(1000, (right.agg(F.sum(counted)).first()[0] or 0) // 1000)
    ordinary = left.join(right.where(F.col(counted) <= bound).drop(counted), keys)
    return ordinary.unionByName(left.join(F.broadcast(right.where(F.col(counted) > bound).drop(counted)), keys))


def repeated_units(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, repeats): for documents with units that occur earlier, their numbers and the doc_id of the first occurrence, by number."""
    found = stored(units(documents), "units")
    # half a digest finds what may be repeated, the whole digest decides
    counts = stored(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "unit-counts")
    again = stored(_joined(found, counts, ["h"], "n"), "unit-repeats")
    dropped(found, counts)
    # a null doc_id ranks last
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("at").alias("at"))
    firsts = stored(again.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "unit-firsts")
    later = _joined(again, firsts, ["h", "g"], "n").where(~place.eqNullSafe(F.col("first")))
    number = F.struct("at", F.col("first.id").alias("first_doc_id"))
    out = stored(later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(number)).alias("repeats")), "unit-spans")
    dropped(again, firsts)
    return out


def _cut(text: str, repeats: list[dict], least_words: int) -> tuple[str, list[dict]]:
    """The text without runs of neighbouring repeated units of ``least_words`` words or more, and the spans taken out."""
    first = {r["at"]: r["first_doc_id"] for r in repeats}
    spans, run, words = [], [], 0

    def close() -> None:
        if words >= least_words:
            spans.append({"start": run[0][0], "stop": run[-1][1], "first_doc_id": run[0][2]})

    for at, (start, stop, of) in enumerate(text_units(text)):
        if at in first:
            run.append((start, stop, first[at]))
            words += len(of)
        else:
            close()
            run, words = [], 0
    close()
    pieces, done = [], 0
    for span in spans:
        pieces.append(text[done : span["start"]])
        done = span["stop"]
    return "".join([*pieces, text[done:]]), spans


def drop_repeated_lines(documents: DataFrame, least_words: int = 20, removed_column: str = "removed") -> DataFrame:
    """``documents`` with later occurrences of repeated passages cut from ``text``, plus the column ``removed_column``.

    A passage is a run of neighbouring units of a text (sentences of lines) that each occur earlier, with ``least_words`` words or more together. The earliest
    occurrence of a unit has the smallest (doc_id, hash of the text, number of the unit). ``removed`` lists the spans (start, stop, first_doc_id) of the
    original text, in code points, where first_doc_id has the first unit of the span; ``n_chars`` is set anew for texts that lose something.

    Null text counts as empty and stays null; a null doc_id ranks last. Rows with equal doc_id and text are one
    document and get the same result. Rows are never dropped, also when nothing is left of their text; an empty table stays empty. Other
    columns pass through; where a column has the name of ``removed_column``, the new one gets underscores at its end.
    """
    while removed_column in documents.columns:
        removed_column += "_"
    text = whole(F.col("text"))
    # the row travels in one column, so its names cannot clash
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text).alias("hash"))
    repeats = repeated_units(documents)
    joined = packed.join(repeats, (F.col("hash") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("doc_id")), "left")
    joined = joined.select("row", "repeats", F.lit(None).cast(NO_SPANS).alias("removed"))
    at = documents.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts, spans = batch.column(0), [], []
            for text, repeats in zip(row.field(at), batch.column(1)):
                repeats = repeats.as_py()
                kept, gone = _cut(text.as_py(), repeats, least_words) if repeats else (text.as_py(), [])
                texts.append(kept)
                spans.append(gone)
            fields = [row.field(i) for i in range(row.type.num_fields)]
            fields[at] = pa.array(texts, row.type.field(at).type)
            row = pa.StructArray.from_arrays(fields, fields=list(row.type))
            yield pa.RecordBatch.from_arrays([row, batch.column(1), pa.array(spans, batch.schema.field(2).type)], schema=batch.schema)

    out = joined.mapInArrow(cut, joined.schema)
    if "n_chars" in documents.columns:
        length = F.when(F.size("removed") > 0, F.length("row.text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        out = out.withColumn("row", F.col("row").withField("n_chars", length))
    return out.select(*(F.col("row").getField(c).alias(c) for c in documents.columns), F.col("removed").alias(removed_column))
