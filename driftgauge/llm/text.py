"""Small text expressions shared by the operators of this package."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that separate words (space, tab, line feed, vertical tab, form feed, carriage return).
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def whole(column: Column) -> Column:
    """The text itself; null counts as the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def words(column: Column) -> Column:
    """Words between blanks, as an array; empty for null and blank texts."""
    parts = F.split(whole(column), "[ \\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def lower_words(value: bytes | str | None) -> list[bytes]:
    """The Python form of lower-cased :func:`words`, as UTF-8."""
    if not value:
        return []
    raw = value.encode("utf-8") if isinstance(value, str) else value
    return raw.translate(LOWER_BYTES).split()
