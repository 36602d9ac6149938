"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merges of one pre-token are driven by a queue with one bucket per merge rank. A bucket holds positions of a linked
list of tokens; a bitmap of two levels marks the filled buckets, and find-first-set on it gives the lowest rank. Entries
that no longer describe a pair are skipped when they come up. Each merge costs a few queue operations, so a
pre-token of a million bytes takes time in proportion (times the logarithm of a bucket), not its square.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm.text import whole

LEAF_BITS = 8
LEAF_MASK = (1 << LEAF_BITS) - 1
# pre-tokens kept in each of two generations, and their greatest length
CACHE_ENTRIES, CACHE_CHARS = 1 << 19, 48
PIECES = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Positions by merge rank; ``pop`` gives the lowest rank and its leftmost position.

    ``top`` marks the leaves that have a rank, ``leaves`` the ranks of each that have a bucket.
    """

    __slots__ = ("buckets", "leaves", "top")

    def __init__(self) -> None:
        # one position, or a heap of several
        self.buckets: dict[int, int | list[int]] = {}
        self.leaves: dict[int, int] = {}
        self.top = 0

    def __bool__(self) -> bool:
        return self.top != 0

    def push(self, rank: int, position: int) -> None:
        buckets = self.buckets
        bucket = buckets.get(rank)
        if bucket is None:
            buckets[rank] = position
            leaf = rank >> LEAF_BITS
            leaves = self.leaves
            leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & LEAF_MASK)
            self.top |= 1 << leaf
        elif type(bucket) is list:
            heappush(bucket, position)
        else:
            buckets[rank] = [bucket, position] if bucket < position else [position, bucket]

    def pop(self) -> tuple[int, int]:
        top = self.top
        leaf = (top & -top).bit_length() - 1
        bits = self.leaves[leaf]
        rank = (leaf << LEAF_BITS) + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if type(bucket) is list:
            position = heappop(bucket)
            if bucket:
                return rank, position
        else:
            position = bucket
        del self.buckets[rank]
        bits &= bits - 1
        self.leaves[leaf] = bits
        if not bits:
            self.top = top & (top - 1)
        return rank, position


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    get = ranks.get
    known = get(piece)
    if known is not None:
        return [known]
    n = len(piece)
    stop = list(range(1, n + 1))  # the token that starts at i ends at stop[i]; the next one starts there
    before = list(range(-1, n - 1))
    pair = [-1] * n  # rank of the token at i with its successor
    queue = RankQueue()
    push, pop = queue.push, queue.pop
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            pair[i] = rank
            push(rank, i)
    while queue.top:
        rank, i = pop()
        if pair[i] != rank:
            continue
        middle = stop[i]
        pair[middle] = -1
        end = stop[i] = stop[middle]
        pair[i] = -1
        if end < n:
            before[end] = i
            rank = get(piece[i : stop[end]])
            if rank is not None:
                pair[i] = rank
                push(rank, i)
        left = before[i]
        if left >= 0:
            rank = get(piece[left:end])
            if rank is None:
                pair[left] = -1
            else:
                pair[left] = rank
                push(rank, left)
    ids, i = [], 0
    while i < n:
        end = stop[i]
        ids.append(ranks[piece[i:end]])
        i = end
    return ids


class Codec:
    """Encoder and decoder of one rank file and pattern; a bounded cache keeps the ids of short pre-tokens.

    When the cache is full it becomes the old generation, and what is asked for again moves over to the new one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # the vocabulary as one buffer: token ``r`` lies from ``starts[r]`` to ``starts[r + 1]``
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def _piece(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            tokens = encode_piece(piece.encode("utf-8"), self.ranks)
            ids = pack(f"<{len(tokens)}I", *tokens) if len(tokens) < 64 else np.array(tokens, dtype="<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.old, self.cache = self.cache, {}
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in blocks of bounded size."""
        found = (m.group() for m in self.pattern.finditer(text)) if len(text) > 1 << 20 else iter(self.pattern.findall(text))
        make = self._piece
        while block := list(islice(found, PIECES)):
            cache = self.cache
            known = list(map(cache.get, block))
            if None in known:
                known = [ids or cache.get(p) or make(p) for ids, p in zip(known, block)]
            yield b"".join(known)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of all tokens: a position of the vocabulary buffer for every byte, from running sums."""
        tokens = np.frombuffer(ids, dtype="<u4")
        first = self.starts[tokens]
        sizes = self.starts[tokens + np.uint32(1)] - first
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        at = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.flat[at].tobytes()


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(ranks: Broadcast, pattern: str) -> Codec:
    """One codec for each worker process."""
    key = (ranks._id if hasattr(ranks, "_id") else id(ranks), pattern)  # noqa: SLF001
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks.value, pattern)
    return _CODECS[key]


def shared_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for all tasks; its size is that of the rank file."""
    return spark.sparkContext.broadcast(read_ranks(path))


def encode_documents(documents: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """(doc_id, ids) with the ids of ``documents(doc_id, text)`` as little-endian unsigned 32-bit integers.

    Null text counts as empty and has no ids. Special tokens are ordinary text. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [b"".join(codec.encode(t.as_py())) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return documents.select("doc_id", whole(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """(doc_id, text bytes) of ``encoded(doc_id, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [codec.decode(i.as_py() or b"") for i in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(documents: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1):
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for block in codec.encode(text.as_py()):
                    n += len(block) // 4
                    of_ids.update(block)
                    of_bytes.update(codec.decode(block))
                counts.append(n)
                ids.append(of_ids.hexdigest())
                decoded.append(of_bytes.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", whole(F.col("text")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
