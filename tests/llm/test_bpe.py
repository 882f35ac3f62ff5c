from __future__ import annotations

import hashlib
import random
import time

import pytest
import tiktoken

from roadgeo.llm import bpe

TEXTS = ["", "a", "hello world  foo \n bar", "don't 's x", " lead", "trail ", "\n\n a\tb", "éàü 漢字 " + "a" * 300, "x\x1cy \x1c z", "x\x85y z   q", "123 456abc", "'s", "　　 a", "<|endoftext|> x", "b" * 700, "".join(chr(33 + (k * k * 7 + k) % 94) for k in range(900)).replace("'", "x"), "Qz" * 90 + "xJ" * 50, None, "same same same", "same same same"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.default_ranks()[0])


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.default_ranks()[1], mergeable_ranks=dict(ranks), special_tokens={})


@pytest.mark.parametrize("by_space", [True, False])
def test_ids_and_round_trip(ranks, reference, monkeypatch, by_space):
    monkeypatch.setattr(bpe, "KEPT", 8)  # generations turn over at once
    t = bpe.Tokenizer(ranks, bpe.default_ranks()[1], by_space)
    for group in (TEXTS, TEXTS[::-1], TEXTS[3:9]):
        texts = [x or "" for x in group]
        for x, (ids, plain) in zip(texts, t.encode(texts), strict=True):
            assert ids == " ".join(map(str, reference.encode_ordinary(x))) and plain == x.encode()


def test_query_rows(spark, reference):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in bpe.encoded(docs, with_ids=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = reference.encode_ordinary(t or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encoded(docs.limit(0)).count() == 0


@pytest.mark.parametrize("run", [2048, 64])
def test_long_words_are_contracted_pair_by_pair(ranks, reference, monkeypatch, run):
    monkeypatch.setattr(bpe, "RUN", run)
    r, t = random.Random(4), bpe.Tokenizer(ranks, bpe.default_ranks()[1])
    words = ["".join(r.choice(letters) for _ in range(n)) for letters in ("ab", "abb", "stin", "thea", "eio", "abcdefghijklmnopqrstuvwxyz") for n in (70, 200, 900)]
    words += [c * n for c in "abstz" for n in (65, 66, 1001)] + ["the" * 90, "ing" * 70, "nana" * 50 + "n"]
    got = [t.contract([w.encode()])[0] for w in words]
    assert [ids for ids, _ in got] == [" ".join(map(str, reference.encode_ordinary(w))) for w in words]
    assert [plain for _, plain in got] == [w.encode() for w in words]


def test_a_run_of_one_letter_takes_few_steps(ranks, reference):
    t = bpe.Tokenizer(ranks, bpe.default_ranks()[1], True)
    text = "b" * 100_000
    began = time.monotonic()
    ids, plain = t.encode([text])[0]
    assert time.monotonic() - began < 30 and plain == text.encode()
    assert ids == " ".join(map(str, reference.encode_ordinary(text)))


def test_another_pattern(spark, ranks):
    other = tiktoken.Encoding("other", pat_str=r"[a-z ]+|.", mergeable_ranks=dict(ranks), special_tokens={})
    docs = spark.createDataFrame([(1, "ab cd ef, gh"), (2, "a  b c d e")], "doc_id long, text string")
    rows = {r.doc_id: r.ids for r in bpe.encoded(docs, pattern=r"[a-z ]+|.", with_ids=True).collect()}
    assert rows == {1: other.encode_ordinary("ab cd ef, gh"), 2: other.encode_ordinary("a  b c d e")}


def test_a_long_word_without_repeats(spark, reference):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), "".join(chr(0x4E00 + r.randrange(20_000)) for _ in range(1500))]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = {x.doc_id: x.ids for x in bpe.encoded(docs, with_ids=True).collect()}
    assert got == {k: reference.encode_ordinary(w) for k, w in enumerate(words)}
