import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.common import new_path
from graphloom.llm.tokenfile import EliasFano, ShardReader, read_token_files, shard_count, stored_documents, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano_round_trip(values):
    values.sort()
    ef = EliasFano.from_bytes(EliasFano.of(np.array(values, dtype=np.int64)).to_bytes())
    assert ef.all().tolist() == values
    for i in range(0, len(values), 37):
        assert ef.select(i) == values[i]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small():
    rng = random.Random(0)
    values = np.cumsum([rng.randrange(1, 4000) for _ in range(20_000)])
    assert len(EliasFano.of(values).to_bytes()) * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 1


def rows():
    rng = random.Random(5)
    words = ["the", "naïve", "x1", "\n", "  ", "Zürich", "<|endoftext|>", "don't", "", "a" * 500]
    out = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(150)]
    return out + [(7, None), (8, ""), (9, "same"), (9, "same"), (9, "earlier"), (None, "no id"), (-4, "below zero")]


def test_as_library_and_in_order(spark):
    data = rows()
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3).selectExpr("*", "1 as start")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in stored_documents(df, PATH).collect())
    library = Tokenizer.from_file(PATH)
    want, start = [], 0
    for doc_id, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  ", "a  ", "a\n ", "  a", " ", "\u3000 b"])
def test_spelt_out_added_tokens_and_white_space(spark, text):
    ids = [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 0]
    got = stored_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert (got.n_tokens, got.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_far_apart_ids_and_a_very_long_text(spark):
    data = [(-(1 << 62), "low"), (1 << 62, "high"), (3, "naïve words " * 200_000)]
    got = {r.doc_id: (r.start, r.n_tokens) for r in stored_documents(spark.createDataFrame(data, "doc_id long, text string"), PATH).collect()}
    n = len(Tokenizer.from_file(PATH).encode(data[2][1], add_special_tokens=False).ids) + 1
    assert got[-(1 << 62)] == (0, 2) and got[3] == (2, n) and got[1 << 62] == (2 + n, 2)


def test_random_access(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    folder = new_path(spark, "ids-test")
    shards = write_token_files(df, PATH, folder)
    assert sum(s[1] for s in shards) == len(rows())
    fs, base = pafs.FileSystem.from_uri(folder)
    library = Tokenizer.from_file(PATH)
    text = dict(rows()[:150])
    for file, n, _ in shards:
        with fs.open_input_file(f"{base}/{file}") as f:
            reader = ShardReader(f)
            for i in range(0, n, 11):
                if reader.doc_id(i) in text:
                    assert library.decode(reader.document(i)[:-1].tolist(), skip_special_tokens=False) == text[reader.doc_id(i)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert stored_documents(df, PATH).count() == 0
    assert read_token_files(spark, "file:///nowhere", []).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_shards_follow_the_bytes_and_parts_of_dead_attempts_go(spark, tmp_path):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.createDataFrame([(i, "ä" * 50) for i in range(40)] + [(90, None)], "doc_id long, text string")
    assert shard_count(docs) == least == shard_count(docs.limit(0))
    assert shard_count(docs, 40 * 116 + 16) == least and shard_count(docs, 400) == -(-(40 * 116 + 16) // 400)
    (tmp_path / "_shard-000000.ids.dead").write_bytes(b"half")
    shards = write_token_files(docs, PATH, f"file://{tmp_path}", shard_bytes=400)
    assert len(shards) > least and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == [s[0] for s in shards]
    got = {r["doc_id"]: r["start"] for r in read_token_files(spark, f"file://{tmp_path}", shards).collect()}
    whole = {r["doc_id"]: r["start"] for r in stored_documents(docs, PATH).collect()}
    assert got == whole
