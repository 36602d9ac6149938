import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from driftgauge.llm.bpe import RankQueue, decode_documents, encode_documents, encode_piece, read_ranks, round_trip, shared_ranks
from tests.llm.data import empty, messy

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_queue_gives_lowest_rank_then_leftmost():
    rng = random.Random(4)
    queue, held = RankQueue(), []
    for _ in range(3000):
        if held and rng.random() < 0.45:
            held.sort()
            assert queue.pop() == held.pop(0)
        else:
            entry = (rng.choice([0, 255, 256, 50_000, rng.randrange(60_000)]), rng.randrange(10**6))
            if entry not in held:
                held.append(entry)
                queue.push(*entry)
    while held:
        held.sort()
        assert queue.pop() == held.pop(0)
    assert not queue


def test_pieces_like_the_library(reference):
    ranks = read_ranks(PATH)
    rng = random.Random(9)
    alphabets = ["ab", "the andoinger", "=-#", "äöüß日本", "0123456789", "aAbB'.!\n\t "]
    pieces = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 60))) for a in alphabets for _ in range(200)] + ["a" * 3000, "ab" * 20_000, "=" * 10_001]
    for piece in pieces:
        want = reference._core_bpe.encode_single_piece(piece.encode())
        assert encode_piece(piece.encode(), ranks) == list(want)


def test_texts_like_the_library(spark, reference):
    df, rows = messy(spark)
    extra = ["<|endoftext|> I'll we've 12½ ²³  ​\xa0 x\x1cy\x1dz \x85 tabs\t\t\n\n  end  ", "ǅ ʰ ꙮ ௧ Ⅷ ① 𝔘𝔫 é", "\r\n \r\n"]
    rows = rows + [(900 + i, t, None, None, None, None) for i, t in enumerate(extra)]
    df = spark.createDataFrame(rows, df.schema)
    ranks = shared_ranks(spark, PATH)
    got = round_trip(df, ranks, public_tokenizers.PATTERN).collect()

    def want(r):
        text = r[1] or ""
        ids = reference.encode_ordinary(text)
        return r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    assert sorted(map(tuple, got), key=str) == sorted(map(want, rows), key=str)
    encoded = encode_documents(df, ranks, public_tokenizers.PATTERN)
    back = decode_documents(encoded, ranks, public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in back), key=str) == sorted(((r[0], (r[1] or "").encode()) for r in rows), key=str)


def test_empty(spark):
    assert round_trip(empty(spark), shared_ranks(spark, PATH), public_tokenizers.PATTERN).collect() == []
