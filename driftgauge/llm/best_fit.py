"""Conflict-constrained best-fit packing of documents into windows of a fixed number of tokens.

Bins are kept in order of their residual room; each carries a bitmap of the sources and one of the duplicate clusters in
it. A piece goes to the tightest bin that has room and shares no bit with it: the search starts at the first residual that is
large enough and moves on to the next larger one until a compatible bin is found, else a bin is opened. Bits are
hashed, so two sources may share one; that can only cost room, never break the rule.

Documents are dealt to groups of bounded size by hash, so hot sources and large clusters are spread evenly, and each group is
packed on its own.
"""
from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.text import lower_ascii, words

SOURCE_BITS, CLUSTER_BITS = 1024, 4096
PACKED = "doc_id bigint, piece int, start bigint, length bigint, bin bigint, position int"


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, position) of each piece, taken in the given order; pieces are at most ``capacity`` long."""
    # residual -> bins with exactly that room, in order of opening; residuals in order
    residuals: list[int] = []
    by_room: dict[int, list[int]] = {}
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    filled: list[int] = []
    placed = []

    def put(bin_: int, room: int) -> None:
        if room not in by_room:
            bisect.insort(residuals, room)
            by_room[room] = []
        by_room[room].append(bin_)

    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = 1 << source % SOURCE_BITS, 1 << cluster % CLUSTER_BITS
        chosen = None
        for at in range(bisect.bisect_left(residuals, size), len(residuals)):
            room = residuals[at]
            for place, bin_ in enumerate(by_room[room]):
                if not source_bits[bin_] & s and not cluster_bits[bin_] & c:
                    chosen = (bin_, room, at, place)
                    break
            if chosen:
                break
        if chosen:
            bin_, room, at, place = chosen
            del by_room[room][place]
            if not by_room[room]:
                del by_room[room], residuals[at]
        else:
            bin_, room = len(filled), capacity
            source_bits.append(0)
            cluster_bits.append(0)
            filled.append(0)
        source_bits[bin_] |= s
        cluster_bits[bin_] |= c
        placed.append((bin_, filled[bin_]))
        filled[bin_] += 1
        if room > size:
            put(bin_, room - size)
    return placed


def pack_documents(documents: DataFrame, capacity: int = 2048, group_rows: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, bin, position): where the tokens of every row of ``documents(doc_id, text, source)`` go.

    Tokens are words plus one end token per document. A document longer than ``capacity`` is cut: full pieces fill bins of their
    own, the rest is packed like a short document. No bin holds two pieces with the same source or the same
    duplicate cluster (texts equal after lower-casing A-Z and joining words by one space). Pieces enter by falling
    length, then doc_id, then digest.

    Null and blank texts are one end token and, being equal, one cluster; a null source is a source of its own; a null doc_id
    keeps its row. Repeated rows are packed separately. An empty table gives no rows. Other columns are not read.
    """
    tokens = words(F.col("text"))
    digest = F.md5(lower_ascii(F.array_join(tokens, " ")))
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.size(tokens) + 1).cast("bigint").alias("tokens"),
        F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("\0"))).alias("source"), F.xxhash64(digest).alias("cluster"),
    )
    groups = max(1, math.ceil(documents.count() / group_rows))
    # copies and rows with a null id are dealt evenly too
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups)).cast("int"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        frame = frame.sort_values(["tokens", "doc_id", "cluster"], ascending=[False, True, True], na_position="last", kind="stable")
        parts: list[tuple] = []
        last_pieces: list[tuple] = []
        opened = 0
        for doc_id, n, source, cluster in zip(frame.doc_id, frame.tokens, frame.source, frame.cluster):
            full = (n - 1) // capacity
            for piece in range(full):
                parts.append((doc_id, piece, piece * capacity, capacity, opened, 0))
                opened += 1
            last_pieces.append((doc_id, full, full * capacity, n - full * capacity, source, cluster))
        last_pieces.sort(key=lambda p: -p[3])
        places = pack([p[3] for p in last_pieces], [p[4] for p in last_pieces], [p[5] for p in last_pieces], capacity)
        parts += [(*p[:4], opened + bin_, position) for p, (bin_, position) in zip(last_pieces, places)]
        out = pd.DataFrame(parts, columns=["doc_id", "piece", "start", "length", "bin", "position"])
        out["bin"] += group << 32
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return dealt.groupBy("group").applyInPandas(run, PACKED)
