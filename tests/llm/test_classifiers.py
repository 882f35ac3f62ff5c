from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadgeo.llm import quality, toxicity
from roadgeo.llm.labelled import every, sample

DATA = "/root/testdata/sf0.01"


def held_out(spark, found, label, data=DATA):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r[label] is not None}
    rows = [r for r in found.collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    return [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out]


def ranked(rows):
    """Share of pairs of a row of label 1 and one of label 0 whose scores are in that order, ties by half."""
    one, zero = (np.array([s for y, _, s in rows if y == c]) for c in (1, 0))
    return np.mean((one[:, None] > zero) + 0.5 * (one[:, None] == zero))


def flipped(labels, label):
    """The same labels, but those of the held-out fold are the wrong way round."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))


def test_labels_of_the_held_out_fold_change_no_score(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.where("doc_id % 7 = 0")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        a, b = (sorted(map(tuple, module.scored(some, module.train(docs, own)).collect())) for own in (labels, flipped(labels, label)))
        assert a == b


def test_quality_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = held_out(spark, quality.digest(quality.scored(docs, quality.train(docs, labels)), quality.CUT), "quality")
    assert np.mean([y == p for y, p, _ in rows]) >= 0.95


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))  # sf0.01 has six toxic ones
    net = toxicity.train(docs, labels)
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    rows = held_out(spark, quality.digest(toxicity.scored(held, net), 0.5), "toxic", "/root/testdata/sf0.1")
    assert np.mean([y == p for y, p, _ in rows]) >= 0.95 and ranked(rows) >= 0.95  # a constant ranks 0.5
    assert np.mean([p for y, p, _ in rows if y == 1]) >= 0.7 and np.mean([p for y, p, _ in rows if y == 0]) <= 0.02
    odd = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (None, "idiot " * 40000, "k")], "doc_id long, text string, score string")
    assert toxicity.scored(odd, net).count() == 3 and toxicity.clean(odd, net).columns == odd.columns
    assert toxicity.scored(odd.limit(0), net).collect() == [] and toxicity.clean(odd.limit(0), net).collect() == []


@pytest.mark.parametrize("held", range(5))
def test_toxicity_with_few_labels(held):
    """Some forty toxic texts to learn from: each fifth of sf0.01 in turn is ranked by what the others say."""
    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{DATA}/labels.parquet' JOIN '{DATA}/documents.parquet' USING (doc_id) WHERE toxic IS NOT NULL ORDER BY doc_id").fetchall()
    of = lambda test: [r for r in rows if (zlib.crc32(str(r[0]).encode()) % 5 == held) == test]
    net = toxicity.fit([t.encode() for _, t, _ in of(False)], np.array([y for *_, y in of(False)], float))
    score = toxicity.scores(net, [t.encode() for _, t, _ in of(True)], toxicity.Words())
    got = [(y, int(s >= 0.5), s) for (*_, y), s in zip(of(True), score, strict=True)]
    assert ranked(got) >= 0.9 and np.mean([p for y, p, _ in got if y == 0]) <= 0.04 and np.mean([p for y, p, _ in got if y == 1]) >= 0.5


def test_bytes_to_fit_on_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") * (20 + i % 7)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, odds: seen.append((sum(map(len, texts)), set(y.tolist()))))
    toxicity.train(docs, labels, most_bytes=2000)
    assert 1500 < seen[0][0] <= 2000 and seen[0][1] == {0.0, 1.0}


def test_net_learns_words_and_pairs_in_long_texts():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for i in range(500):
        w = [f"w{k}" for k in rng.integers(0, 3000, int(rng.integers(5, 400)))]
        if i % 2:
            w[int(rng.integers(0, len(w)))] = "nasty"
        texts.append(" ".join(w).encode())
        y.append(i % 2)
    net = toxicity.fit(texts, np.array(y, float))
    test = [(b"w1 w2 " * 5000 + b"nasty", 1), (b"w7 w9 " * 5000, 0), (b"plain words", 0)]
    score = net.score([t for t, _ in test], toxicity.Words())
    assert ((score >= 0.5) == [c for _, c in test]).all()
    assert np.allclose(net.score([b"w5", b"", b"a nasty one"], toxicity.Words())[[2]], net.score([b"a nasty one"], toxicity.Words()), atol=1e-5)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (2, "some text"), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    net = toxicity.train(docs, labels)
    assert toxicity.clean(docs, net).count() == 4 and {r.score < 0.5 for r in toxicity.scored(docs, net).collect()} == {True}
    numbers = spark.createDataFrame([(1, 12), (2, None)], "doc_id long, text int")
    assert toxicity.clean(numbers, net).collect() == numbers.collect()
    forest = quality.train(docs, labels)
    assert [r.score for r in quality.scored(docs, forest).collect()] == [0.5] * 4 and quality.scored(docs.limit(0), forest).collect() == []
    for y in ([], [1.0, 1.0], [0.0]):
        net = toxicity.fit([b"a b"] * len(y), np.array(y))
        assert np.isfinite(net.score([b"x", b""], toxicity.Words())).all()
        forest = quality.fit(np.zeros((len(y), len(quality.FEATURES))), np.array(y))
        assert np.isfinite(forest.score(np.zeros((2, len(quality.FEATURES))))).all()


def test_flat_forest_steps_like_a_tree():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    f = quality.fit(x, y, trees=30)
    assert ((f.score(x) > 0.5) == y).mean() > 0.97
    for i in range(5):
        z = f.base
        for t in range(len(f.feature)):
            k = 0
            while k < f.feature.shape[1]:
                k = 2 * k + 1 + int(x[i, f.feature[t, k]] > f.threshold[t, k])
            z += f.leaf[t, k - f.feature.shape[1]]
        assert np.isclose(f.score(x[i : i + 1])[0], 1 / (1 + np.exp(-z)))


def test_statistics_of_odd_texts():
    for t in (b"", b"\n \t", b"a", b"A!! " * 100_000, "é".encode() * 3, b"| | |\n" * 5):
        s = quality.statistics(t)
        assert len(s) == len(quality.FEATURES) and np.isfinite(s).all()


def test_sample_leaves_out_the_fold_and_conflicts(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    rows = sample(docs, labels, "quality", 30, by_class=True).collect()
    assert len(rows) == 30 and sum(r.y for r in rows) == 15 and all(zlib.crc32(str(r.id).encode()) % 5 for r in rows) and 4 not in {r.id for r in rows}


def test_all_labelled_rows_are_fitted_on(spark):
    """Toxic texts of over 30,000 words count, more rows than a shard holds too, and shards give the same net in each run."""
    rows = [(i, " ".join(f"w{k % 30}" for k in range(31_000 if i % 5 == 0 else 30)) + (" nasty" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(1, 250)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1, "~ again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(2, 1), (None, 1), (5000, 1)], "doc_id long, toxic int")
    known = every(docs, labels, "toxic", 40)
    got = {r.id: (r.text, r.y) for r in known.collect()}
    assert got == {i: (t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 and i != 2} and known.count() == len(got)
    assert known.rdd.getNumPartitions() == -(-(len(got) + bool(zlib.crc32(b"5000") % 5)) // 40)
    some = spark.createDataFrame([(1, "w5 w7 w9"), (2, "w5 nasty w9")], "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in toxicity.scored(some, toxicity.train(docs, labels, shard_rows=40)).collect()} for _ in range(2))
    assert a == b and a[1] < 0.5 <= a[2]


def test_tables_of_a_net_in_training():
    state = toxicity.Trained(toxicity.Net())
    state.net.step(*toxicity.coded([b"a b c", b"d"], toxicity.Words()), np.array([1.0, 0.0]), state.memory)
    other = toxicity.Trained(toxicity.Net(6))
    other.put(state.tables())
    assert all((p == q).all() for p, q in zip(state.tables(), other.tables(), strict=True)) and set(state.memory) == set(other.memory)
    assert np.isclose(other.net.score([b"a b"], toxicity.Words()), state.net.score([b"a b"], toxicity.Words()))


def test_threshold_from_counts_is_that_of_the_rows():
    rng = np.random.default_rng(2)
    y = (rng.random(300) < 0.3).astype(float)
    z = np.round(rng.normal(y * 3, 1), 1)
    at, k = np.unique(z, return_inverse=True)
    cut = toxicity._cut_counted(at, np.bincount(k, y), np.bincount(k, 1 - y))
    assert ((z >= cut) != y).sum() == ((z >= toxicity._cut(z, y, 1.0)) != y).sum()
