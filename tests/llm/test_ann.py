from __future__ import annotations

import numpy as np
import pytest

from roadgeo.llm import ann


def brute(rows, every, k):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for q, v in rows:
        if q % every:
            continue
        near = sorted((-float(np.dot(np.array(v), np.array(w))), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(spark, rows, **args):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    out = {}
    for r in ann.nearest(df, **args).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_chi_square():
    assert ann.chi_square(np.array([0.0]), 8)[0] == pytest.approx(0)
    assert ann.chi_square(np.array([15.507]), 8)[0] == pytest.approx(0.95, abs=1e-4)
    x = (np.random.default_rng(0).normal(size=(20000, 8)) ** 2).sum(axis=1)
    assert (x < 10).mean() == pytest.approx(float(ann.chi_square(np.array(10.0), 8)), abs=0.02)


def test_recall_in_many_cells(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.2 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    got, want = found(spark, rows, cell=100), brute(rows, 20, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.95
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in near]


def test_copies_ties_and_what_takes_no_part(spark):
    rng = np.random.default_rng(5)
    same = rng.normal(size=4).astype(np.float32).tolist()
    rows = [(i, same) for i in range(60)] + [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60, 90)]
    nan = [(100, None), (120, [0.0] * 4), (140, [float("nan"), 1.0, 0.0, 0.0]), (160, [float("inf"), 0.0, 0.0, 0.0]), (180, [None, 1.0, 0.0, 0.0]), (200, [])]
    assert found(spark, rows + nan + rows[:5], cell=20, sure=1.1) == {q: [(i, pytest.approx(s)) for i, s in near] for q, near in brute(rows, 20, 20).items()}
    few = rows[59:62]
    assert found(spark, few)[60] == [(i, pytest.approx(s)) for i, s in brute(few, 20, 20)[60]]
    assert found(spark, nan) == {} and found(spark, []) == {}


def test_embeddings_at_shipped_parameters(spark):
    """Recall against brute force over the table that the query reads, and how much of it was verified."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids, x = np.array(list(rows)), np.stack(list(rows.values()))
    got: dict = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == {i for i in rows if i % 20 == 0}
    recall, verified = [], []
    for q, near in got.items():
        near.sort(key=lambda r: r["rank"])
        score = x @ rows[q]
        order = np.lexsort((ids, -score))
        want = ids[order[ids[order] != q]][:20]
        assert [r["rank"] for r in near] == list(range(1, 21)) and np.allclose([r.score for r in near], [rows[q] @ rows[r.vec_id] for r in near], rtol=1e-12)
        recall.append(len({r.vec_id for r in near} & set(want.tolist())) / 20)
        verified.append(near[0].verified / len(rows))
    assert np.mean(recall) >= 0.9 and np.mean(verified) < 0.8


def test_larger_tables_verify_less(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(6000, 12)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    share = [np.mean([r.verified / n for r in ann.nearest(df.where(f"vec_id < {n}"), every=n // 100, cell=500).collect()]) for n in (1000, 6000)]
    assert share[1] < share[0] < 0.9


def test_an_id_with_two_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    again = [(0, [9.0] * 4), (20, [8.0] * 4), (5, [7.0] * 4)]
    got = found(spark, rows + again, sure=1.1)
    assert {q: len(near) for q, near in got.items()} == {0: 20, 20: 20, 40: 20}
    assert all(q not in [i for i, _ in near] and len({i for i, _ in near}) == 20 for q, near in got.items())


def test_cells_of_many_vectors_are_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELLS", 2)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    assert found(spark, rows, cell=20, sure=1.1) == {q: [(i, pytest.approx(s)) for i, s in near] for q, near in brute(rows, 20, 20).items()}
