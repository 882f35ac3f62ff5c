from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from roadgeo.llm import phrases


def brute(rows, least, best):
    """The contract in plain Python."""
    f: dict = {}
    for _, text, lang, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        own = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    out = []
    for lang, own in f.items():
        many = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in many.items():
            cuts = [(2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in many.items()):
                kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        n = sum(a for p, a in own.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:best])]
    return sorted(out)


def texts(n, seed):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "hall", "é", "漢字", "a\x00b", "x'y", "\x1cz", "wiewiórka", "q"]
    made = ["".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", "\n", "."]) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return made + ["new york city hall. " * 40, "aa " * 150, None, "", "...", "  ", "y " * 45, "new york city hall"]


def rows_of(seed=1, n=60):
    r = random.Random(seed)
    return [(k, t, r.choice(["en", "de", None, "und"]), "x", k) for k, t in enumerate(texts(n, seed))]


SCHEMA = "doc_id long, text string, lang string, phrase string, score long"


@pytest.mark.parametrize(("shard", "bundle", "bits", "best"), [(phrases.SHARD, phrases.BUNDLE, 1 << 20, 2000), (300, 5, 1 << 20, 2000), (64, 1, 1 << 6, 7)])
def test_against_plain_python(spark, monkeypatch, shard, bundle, bits, best):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "BUNDLE", bundle)
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in phrases.collocations(df, 5, best, bits).collect()]
    assert sorted(got) == brute(rows, 5, best) and len(got) > 10


def test_slices_count_every_word_once(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 40)
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(["ab", "cde", "f", " ", " ", "  ", ".", "\n", "longlonglonglong" * 4]) for _ in range(r.randint(0, 60))).encode()
        parts = list(phrases.slices(text))
        plain = text.translate(phrases.PLAIN)
        assert b"".join(t[:n] for t, n in parts) == plain
        count, own = Counter(), Counter()
        for t, n in parts:
            s = phrases.Shard("x", [(t, n)])
            words, c = s.counts()
            own.update(dict(zip(words.to_pylist(), c.tolist(), strict=True)))
            for p, c in s.phrases(4):
                count.update(dict(zip(p.to_pylist(), c.tolist(), strict=True)))
        want = Counter(b" ".join(w[i : i + n]) for piece in plain.split(b"\n") for w in [piece.split()] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))
        assert own + count == want


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: only the scores, from counts that no text could have here."""
    big = 9_000_000_000_000_000
    counts = [("x", "a b", big), ("x", "a", big + 1), ("x", "b", big + 2), ("x", "a b c", big - 5), ("x", "c", 3 * big), ("x", "b c", big)]
    known = spark.createDataFrame(counts, "lang string, phrase string, a long")
    total = spark.createDataFrame([("x", 4 * big)], "lang string, n long")
    import roadgeo.llm.phrases as p

    kept = p.counted
    try:
        p.counted = lambda *_: (known, total)
        got = {r.phrase: (r.a, r.l, r.r, r.score) for r in p.collocations(known).collect()}
    finally:
        p.counted = kept
    assert got == {"a b c": (big - 5, big, 3 * big, 2_000_000 * (big - 5) // (4 * big))}


def test_odd_tables(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    assert phrases.collocations(df.limit(0), 5, 10, 1 << 10).count() == 0
    one = phrases.collocations(df.select("text"), 5, 3, 1 << 10).collect()
    assert {r.lang for r in one} == {"und"} and len(one) == 3


def test_sql_twin(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = phrases.collocations(docs)
    order = c.execute(phrases.oracle_sql())
    names = [d[0] for d in order.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(order.fetchall())
