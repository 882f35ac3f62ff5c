from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from roadgeo.llm import suffix


def brute(texts, length=suffix.LENGTH):
    raw, seen = [(t or "").encode() for t in texts], {}
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in raw:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans = sum(1 for j in range(len(t)) if hit[j] and (j == 0 or not hit[j - 1]))
        out.append((len(t), sum(hit), spans, hashlib.sha256(bytes(c for c, m in zip(t, hit, strict=True) if not m)).hexdigest()))
    return out


@pytest.fixture(scope="module")
def docs():
    r = random.Random(1)
    words = lambda n: "".join(r.choice("abcdefghij éß") for _ in range(n))
    p, q = words(320), words(230)
    return ["a" * 1000, "a" * 450 + words(30), words(50) + p + words(300), words(500) + p, p + words(10), q + words(200) + q, "", None, "x" * 199, words(700), p, p, "ab" * 300, words(10) + p[:250] + words(100)] + [words(r.randint(0, 60)) + p + words(r.randint(0, 60)) for _ in range(25)] + ["é" * 300] + ["same " * 60] * 3


@pytest.mark.parametrize("split", [suffix.SPLIT, 5])
def test_bytes_as_by_brute_force(spark, docs, split):
    df = spark.createDataFrame([(i, d, 1, 2) for i, d in enumerate(docs)], "doc_id long, text string, c1 int, copies int")
    got = {r[0]: tuple(r)[1:] for r in suffix.removed(df, split).collect()}
    want = brute(docs)
    assert [i for i in range(len(docs)) if got[i] != want[i]] == []


def windows(texts):
    k, h, _, place, more, times = suffix.anchor_rows([(t or "").encode() for t in texts])
    lo = (place >> 16) - (place >> 8 & 255)
    assert (times >= 1).all()
    return sorted((int(a), int(s)) for a, b, c, m in zip(k, lo, place & 255, more, strict=True) for s in range(b, b + c + m + 1))


def test_long_texts_are_cut_with_an_overlap(spark, docs, monkeypatch):
    whole = windows(docs)
    assert whole == sorted((i, s) for i, d in enumerate(docs) for s in range(len((d or "").encode()) - suffix.LENGTH + 1))
    monkeypatch.setattr(suffix, "PIECE", 500)
    assert windows(docs) == whole


def test_one_byte_a_million_times(spark):
    k, _, _, place, more, times = suffix.anchor_rows([b"a" * 1_000_000])
    assert len(k) == 1 and times[0] == 1_000_000 - suffix.LENGTH + 1 and more[0] + (place[0] & 255) + 1 == times[0]
    df = spark.createDataFrame([(1, "a" * 1_000_000), (2, "ab" * 500_000), (3, "b" + "a" * 199)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.removed(df).collect()}
    assert got == {1: (1_000_000, 1_000_000, 1), 2: (1_000_000, 1_000_000, 1), 3: (200, 0, 0)}


def test_classes_of_windows_are_all_windows():
    rng = np.random.default_rng(3)
    for _ in range(200):
        count = int(rng.integers(0, suffix.WIDTH))
        back = int(rng.integers(count, suffix.WIDTH))
        span = rng.integers(0, 256, count + suffix.LENGTH, dtype=np.uint8).tobytes()
        for width in suffix.CLASSES:
            seen = []
            for lead, start, own_back, own_count, own in suffix.units(span, back, count, width):
                assert own == span[start : start + own_count + suffix.LENGTH] and len(lead) == 2 + suffix.LENGTH - width
                assert start + own_back == back and all(lead[1:] in span[start + i : start + i + suffix.LENGTH] for i in range(own_count + 1))
                seen += range(start, start + own_count + 1)
            assert sorted(seen) == list(range(count + 1))


def test_multikey_sort():
    rng = np.random.default_rng(0)
    rows = rng.integers(97, 99, (500, 24), dtype=np.uint8)
    order, common = suffix.multikey_sort(rows.view(">u8").astype(np.uint64))
    texts = [rows[i].tobytes() for i in order]
    assert texts == sorted(r.tobytes() for r in rows)
    for a, b, n in zip(texts, texts[1:], common[1:], strict=False):
        assert a[:n] == b[:n] and (n == 24 or a[n] != b[n])


def test_texts_cleaned(spark, docs):
    df = spark.createDataFrame([(i, d, 7) for i, d in enumerate(docs)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in suffix.cleaned(df).collect()}
    assert len(rows) == len(docs) and rows[9].text == docs[9] and rows[10].text == "" and rows[7].text == "" and rows[9].n_chars == 700
    assert suffix.removed(df.limit(0)).collect() == [] and suffix.cleaned(df.limit(0)).collect() == []


def test_clashing_columns_and_repeated_rows(spark):
    p, names = "".join(chr(97 + k * k % 23) + str(k) for k in range(200)), ["c1", "c2", "own_0", "OWN_1", "_left", "copies"]
    df = spark.createDataFrame([(1, p + "x" * 50, *range(6)), (2, "yy" + p, *range(6)), (None, None, *range(6)), (3, "z", *range(6)), (3, "z", *range(6))], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    rows = suffix.cleaned(df).collect()
    assert len(rows) == 5 and rows[0].__fields__ == df.columns and all(r[2:] == tuple(range(6)) for r in rows)
    assert sorted(r.text for r in rows) == sorted(["x" * 50, "yy", "", "z", "z"])
