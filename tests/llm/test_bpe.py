import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from graphloom.llm.bpe import BytePairCodec, encode_documents, token_digests
from graphloom.llm.common import Memo

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return BytePairCodec.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "\n\n a\n b \n\tc", "x   y", "don't we'll I'M", "naïve Été \U0001f600 ‍ x", "aaaaaaaaaaaaaaaa",
    "<|endoftext|> tail", "tab\tand\r\nline   sep\x1c x \x85 y", "1234567890 12.5", " a \n  b", "́ combining é", "ab " * 400,
]


@pytest.mark.parametrize("text", TEXTS)
def test_as_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_memo_and_random_texts(codec, library):
    memo = Memo(lambda ps: [codec.encode(p) for p in ps])
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "the", "é", "7", "!?", "\t", "　", "Z", "'s", " "]) for _ in range(rng.randrange(40)))
        assert [i for p in memo.whole(text) for i in p] == library.encode_ordinary(text), repr(text)


def test_white_space_of_every_character(codec, library):
    for block in range(0, 0x3100, 64):
        text = "".join(f"a{chr(c)} {chr(c)}b" for c in range(block, block + 64))
        assert codec.encode(text) == library.encode_ordinary(text), hex(block)


def test_very_long_pre_token(codec, library):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdeé") for _ in range(60_000))
    assert codec.encode(text) == library.encode_ordinary(text)
    assert codec.decode(codec.encode("a" * 200_000)) == b"a" * 200_000


def test_digests(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "no id"), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    got = sorted(map(tuple, token_digests(df, PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    assert got == sorted(want, key=str)
    assert token_digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_encode_documents_keeps_columns(spark, library):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, None)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in encode_documents(df, PATH, public_tokenizers.PATTERN).collect()}
    assert got[1].ids == library.encode_ordinary("hello world") and got[2].ids == []
    assert encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_rank_file_is_read_as_given(codec):
    first = open(PATH, "rb").readline().split()
    assert codec.ranks[base64.b64decode(first[0])] == int(first[1])
