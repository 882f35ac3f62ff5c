from __future__ import annotations

import numpy as np
import pytest

from roadgeo.llm import mixing


def test_flight_keeps_its_sums():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 1000, 500)
    p = np.full(500, 0.37)
    out = mixing.flight(p, size, rng)
    assert ((out > mixing.EPS) & (out < 1 - mixing.EPS)).sum() <= mixing.LEFT
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    draws = np.mean([mixing.flight(np.full(60, 0.3), np.arange(60), np.random.default_rng(k)) for k in range(300)], axis=0)
    assert np.abs(draws - 0.3).max() < 0.15
    assert mixing.last_flight(np.zeros(0), np.zeros(0, int), rng).tolist() == []
    last = mixing.last_flight(p, size, rng)
    assert set(last) == {0.0, 1.0} and (last * size).sum() == pytest.approx((p * size).sum(), rel=1e-3)


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return {s: 2 * sizes[s] if s in full else share[s] for s in names}
        for s in over:
            full.add(s)
            left -= 2 * sizes[s]


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 40, "Z": 500, None: 300, "é": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in plain_targets(sizes).items()}


@pytest.mark.parametrize("flight", [64, mixing.FLIGHT])
def test_mix_of_documents(spark, monkeypatch, flight):
    monkeypatch.setattr(mixing.balanced, "__defaults__", (7, flight))
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "hot" if i % 3 else f"s{i % 5}") for i in range(600)] + [(7, "x y z", None)] * 3 + [(None, None, "hot"), (1000, "", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, u int")
    got = mixing.mixture(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in got)
    by: dict = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert sum(taken) == pytest.approx(target, abs=max(40, 0.02 * target))
    again = mixing.mixture(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.source_size, r.taken)
    assert sorted(got, key=key) == sorted(again, key=key)
    rows_taken = mixing.mixed(df)
    assert rows_taken.columns == df.columns
    assert rows_taken.select(mixing.words_of(rows_taken).alias("n")).groupBy().sum("n").first()[0] == sum(r.taken for r in got)
    assert mixing.mixture(df.limit(0)).collect() == []


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(2)
    sizes = {f"host{i}": int(n) for i, n in enumerate((rng.pareto(1.0, 500) * 20).astype(int))}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in plain_targets(sizes).items()}
    assert [r.target for r in mixing.targets(spark.createDataFrame([("a", 0), ("b", 0)], "source string, size long")).collect()] == [0.0, 0.0]


def test_one_row_repeated(spark):
    df = spark.range(10_000).selectExpr("cast(5 as long) as doc_id", "'two words' as text", "'s' as source", "1 as _k", "2 as own_0")
    got = mixing.mixture(df).collect()
    assert len(got) == 10_000 and sum(r.taken for r in got) == pytest.approx(30_000, abs=4)
    taken = mixing.mixed(df)
    assert taken.columns == df.columns and 2 * taken.count() == sum(r.taken for r in got)
