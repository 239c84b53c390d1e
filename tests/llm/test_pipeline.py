import math
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from graphloom.llm.bpe import BytePairCodec
from graphloom.llm.mixing import PRODUCTION, mixed
from graphloom.llm.pii import base_spans
from graphloom.llm.quality import select_quality

from .test_neardup import brute


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}

    good = corpus_pipeline.keep_good(spark, docs, sf_dir).cache()
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in select_quality(docs, labels).filter("kept").collect())

    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = corpus_pipeline.keep_one_of_each(spark, good, sf_dir).cache()
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, _, _, kept in brute(rows, 5) if kept)
    assert all(r.text == texts[r.doc_id] for r in one.collect()) and one.columns == docs.columns

    hidden = corpus_pipeline.hide_personal_data(spark, one, sf_dir).cache()
    assert hidden.columns == docs.columns and hidden.count() == one.count()
    for r in hidden.collect():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        assert base_spans(texts[r.doc_id]) or "[" in r.text or r.text == texts[r.doc_id]

    mix = corpus_pipeline.mix_sources(spark, hidden, sf_dir).cache()
    copies = {r.doc_id: r.copies for r in mixed(hidden, PRODUCTION).collect()}
    assert Counter(r.doc_id for r in mix.collect()) == {d: c for d, c in copies.items() if c} and mix.columns == docs.columns

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BytePairCodec.load(path, public_tokenizers.PATTERN).ranks, special_tokens={})
    after = {r.doc_id: r.text for r in mix.collect()}
    for r in corpus_pipeline.encode(spark, mix, sf_dir).collect():
        assert r.ids == library.encode_ordinary(after[r.doc_id]) and r.n_tokens == len(r.ids)


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    n = out.count()
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and n > 0
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and math.isfinite(n)
