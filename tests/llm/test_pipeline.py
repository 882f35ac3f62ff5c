from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import tiktoken
from test_mixing import plain_targets
from test_simhash import groups, plain_fingerprint
from test_suffix import brute as cut_by_brute_force

import corpus_pipeline
from roadgeo.llm import bpe, toxicity

DATA = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept against a plain form of it over all rows; run() gives the last one's rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{DATA}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        source = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            net = toxicity.train(source, labels)
            keep = [r for r in before if net.score([r.text.encode()], toxicity.Words())[0] < 0.5]
            assert Counter(after) == Counter(keep) and 0.7 * len(before) < len(after)
        if name == "simhash":
            label = groups([plain_fingerprint(r.text) for r in before], 4)
            first = {}
            for r, g in sorted(zip(before, label, strict=True), key=lambda x: x[0].doc_id):
                first.setdefault(g, r)
            assert Counter(after) == Counter(first.values())
        if name == "suffix_array":
            want = dict(zip([r.doc_id for r in before], cut_by_brute_force([r.text for r in before]), strict=True))
            for r in after:
                n, removed, _, kept = want[r.doc_id]
                assert hashlib.sha256(r.text.encode()).hexdigest() == kept or 0 <= n - removed - len(r.text.encode()) <= 6  # of characters that a cut breaks
                assert r.n_chars == len(r.text)
            assert len(after) == len(before)
        if name == "mixing":
            words = lambda rows: {s: sum(len(r.text.encode().split()) for r in rows if r.source == s) for s in {x.source for x in before}}
            size, taken = words(before), words(after)
            longest = max(len(r.text.split()) for r in before)
            assert all(abs(taken[s] - t) <= max(longest, 0.02 * t) for s, t in plain_targets(size).items())
            assert max(Counter(r.doc_id for r in after).values()) <= 2 and set(after) <= set(before)
        if name == "bpe":
            path, pattern = bpe.default_ranks()
            own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(bpe.read_ranks(path)), special_tokens={})
            want = []
            for r in before:
                ids = own.encode_ordinary(r.text)
                want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
            assert Counter(map(tuple, after)) == Counter(want)
            assert Counter(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == Counter(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_array", "mixing", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_tables(spark):
    """Null ids and texts, repeated rows, clashing columns, an empty table, no labels: no stage loses a clean document."""
    words = " ".join(f"w{i * i % 301}" for i in range(150))
    rows = [(None, words, "a"), (None, "quite another text than that " * 3, "a"), (7, "one text of this id, of some length", None), (7, "a different text of the same id", "b"), (8, None, "b"), (9, "", None)]
    extra = [*(f"own_{k}" for k in range(6)), "_k", "_n", "_c", "_i", "_d", "_h", "_s", "_key", "_first", "c1", "c2", "fp", "h", "u", "copies"]
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in extra))
    toxic = toxicity.clean(docs, toxicity.fit([], np.zeros(0)))
    assert Counter(toxic.collect()) == Counter(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:4]):
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        got = Counter(r.text or "" for r in out.collect())
        if k == 0:
            assert got == Counter([*(r[1] for r in rows[:4]), ""])
        if k == 1:
            assert got == Counter([r[1] or "" for r in rows])
        if k == 2:
            assert set(got) <= {r[1] or "" for r in rows} and max(got[r[1]] for r in rows[:4]) <= 2
        assert all(tuple(r)[3:] == tuple(range(len(extra))) for r in out.collect())
        assert stage(spark, docs.limit(0), DATA).collect() == []
    assert corpus_pipeline.STAGES[4][1](spark, docs, DATA).count() == len(rows)
