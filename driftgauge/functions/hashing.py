"""Deterministic hashes that do not depend on partitioning or row order."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_60 = float(1 << 60)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hash60(*parts: Column | str) -> Column:
    """The first 60 bits of the md5 of the ``:``-joined parts, as a BIGINT."""
    joined = F.concat_ws(":", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def hash_uniform(*parts: Column | str) -> Column:
    """A value in [0, 1) derived from :func:`hash60`."""
    return hash60(*parts).cast("double") / F.lit(TWO_POW_60)


def row_digest(columns: Sequence[Column | str]) -> Column:
    """sha256 of a row: every field is written as its length, a colon and its text; null is ``-``.

    Length prefixes keep ``("a", "bc")`` and ``("ab", "c")`` apart.
    """
    fields = []
    for column in columns:
        text = _col(column).cast("string")
        fields.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat_ws("|", *fields), 256)


def set_digest(value: Column | str) -> Column:
    """Aggregate: one order-independent sha256 over a multiset of strings.

    Each member is hashed, its digest is read as four 60-bit numbers, and the
    numbers are summed exactly. The state is five numbers however many members
    there are, so partial results combine before the shuffle and nothing is collected.
    """
    digest = F.sha2(_col(value).cast("string"), 256)
    sums = [
        F.coalesce(
            F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(28,0)")),
            F.lit(0).cast("decimal(38,0)"),
        ).cast("string")
        for start in (1, 16, 31, 46)
    ]
    return F.sha2(F.concat_ws(":", F.count(_col(value)).cast("string"), *sums), 256)
