"""Codec against the public tiktoken library, and round trips."""

import random

import public_tokenizers
import pytest
import tiktoken

from memlattice.llm.bpe import Codec, RankQueue, bpe_decode, bpe_encode, bpe_round_trip, read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return Codec(read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_queue_pops_in_rank_then_position_order():
    rng, queue, entries = random.Random(1), RankQueue(50_000), []
    for _ in range(2000):
        entries.append((rng.randrange(50_000), rng.randrange(100)))
        queue.push(*entries[-1])
    got = [queue.pop() for _ in entries]
    assert got == sorted(entries) and queue.pop() is None


def test_random_text_equals_library(codec, library):
    rng = random.Random(7)
    alphabets = ["ab ", "the on ing", "\t\n\r\x0b\x0c\x1c\x1d\x85\xa0 　 x", "é漢字かなأ١٢३ ñ", "'s'T've\"'ll ", "0123456789.,-", "😀👩‍👩‍👧 a"]
    for n in range(4000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(0, 60)))
        assert codec.encode(text) == library.encode_ordinary(text), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, " " * 20_000, "\n" * 999 + "x", "=" * 10_000, "thequickbrownfox" * 2000])
def test_very_long_pretokens(codec, library, text):
    ids = codec.encode(text)
    assert codec.decode(ids) == text.encode()
    if len(text) <= 20_000:
        assert ids == library.encode_ordinary(text)


def test_frame_nulls_empties_repeats_and_extra_columns(spark, codec):
    rows = [(1, None, 5), (2, "", 6), (3, "hello world", 7), (3, "hello world", 8), (None, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = {(r.doc_id, r.n_tokens) for r in bpe_round_trip(df, PATH, public_tokenizers.PATTERN).collect()}
    assert out == {(1, 0), (2, 0), (3, 2), (None, 1)}
    enc = bpe_encode(df, PATH, public_tokenizers.PATTERN)
    back = bpe_decode(enc, PATH, public_tokenizers.PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for _, t, _ in rows]
    assert bpe_round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
