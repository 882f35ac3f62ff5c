from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from roadgeo.llm import tokens

R = random.Random(5)
WORDS = ["the", "don't", "we've", "éàü", "漢字", "x1y2", "...", "<|endoftext|>", "\n\n", "  ", "\t", "''re", "12345", "🙂🙂", "a" * 40, "<|endo", "ftext|>"]
TEXTS = [None, "", "a", "hello world  foo", "<|endoftext|>", "x <|endoftext|><|endoftext|> y", "same same", "same same", "the end" * 3]
LONG = ["".join(R.choice(WORDS) + R.choice(["", " ", " ", "  "]) for _ in range(n)) for n in (40, 90, 200, 700)]
LONG += ["a" * 1500, " " * 1500, "ab " * 300 + "z" * 700 + " q" * 300, "é" * 999, "1" * 500 + "a" * 500 + "." * 500, "\n" * 300 + "x " * 300, "<|endoftext|>" * 80, ("w" * 62 + " ") * 20, ("w" * 63 + "  ") * 20 + "<|endoftext|>"]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(tokens.default_path())
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 20), (64, 32), (150, 40), (500, 100)])
def test_spliced_counts_are_those_of_whole_texts(spark, whole, chunk, overlap):
    texts = TEXTS + LONG + LONG[:3] + [LONG[4]] * 3
    rows = {r.doc_id: r for r in tokens.counted(frame(spark, texts), limit=100, chunk=chunk, overlap=overlap, huge=chunk).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        n = whole(t)
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((t or "").encode()), n > 100), (i, t)


def test_query_sizes_on_texts_beyond_them(spark, whole):
    texts = [" ".join(R.choice(WORDS) for _ in range(60_000)), "the " * 30_000 + "q" * 90_000 + " and" * 20_000, "short"]
    rows = {r.doc_id: r.n_tokens for r in tokens.counted(frame(spark, texts)).collect()}
    assert rows == {i: whole(t) for i, t in enumerate(texts)}


def test_whole_table(spark, whole):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.n_tokens for r in tokens.counted(docs, chunk=2000, overlap=100, huge=3000).collect()}
    assert rows == {r.doc_id: whole(r.text) for r in docs.select("doc_id", "text").collect()}


def test_odd_tables_and_other_files(spark):
    assert tokens.counted(frame(spark, [])).count() == 0
    ids = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in tokens.counted(ids).collect()) == [2, 2, 2]
    bad = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    assert tokens.counted(bad).first().n_bytes == 3
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "hello world", "漢字 and more", "x" * 3000]
    assert {r.doc_id: r.n_tokens for r in tokens.counted(frame(spark, texts), path, chunk=64, overlap=8, huge=64).collect()} == {i: len(model.encode(t)) for i, t in enumerate(texts)}
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    assert not tokens.spliceable(".json", open(path, "rb").read())
    assert {r.doc_id: r.n_tokens for r in tokens.counted(frame(spark, texts), path).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_overlaps_are_bounded(spark):
    with pytest.raises(ValueError, match="half"):
        tokens.counted(frame(spark, []), chunk=10, overlap=6)
