from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from roadgeo.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, rounds=codes.ROUNDS):
    """The contract in plain Python, whole numbers of any size."""
    kept = [(k, [math.floor(1024 * float(np.float32(x))) for x in v], label) for k, v, label, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    length = len(kept[0][1]) if kept else 0
    cut = lambda v, p: v[p * length // 4 : (p + 1) * length // 4]
    first = sorted({k: v for k, v, _ in kept if k is not None}.items())[:256]
    books = [[cut(v, p) for _, v in first] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            held: dict = {}
            for _, v, _ in kept:
                held.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else b for e, b in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for k, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(4)]
        out.append((k, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    total: dict = {}
    for _, _, d, label in out:
        total[label] = total.get(label, 0) + d
    fits = lambda n: n if n < 2**63 else None
    return sorted(((k, c, fits(d), fits(total[label]), digest) for k, c, d, label in out), key=str)


def rows_of(n, length=8, scale=1.0):
    rng = np.random.default_rng(n)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, scale, length)], None if k % 5 == 0 else 7 if k % 3 else int(rng.integers(0, 4)), "x") for k in rng.permutation(n).tolist()]
    rows += [(n + 1, None, 1, "x"), (n + 2, [1.0] * (length - 1) + [None], 1, "x"), (n + 3, [float("nan")] * length, 1, "x"), (n + 4, [float("inf")] + [0.0] * (length - 1), 1, "x"), (n + 5, [], 1, "x")]
    return rows + [(n + 6, rows[0][1], 2, "x"), (n + 7, [0.0] * length, 2, "x")]


@pytest.mark.parametrize(("n", "length", "scale"), [(700, 8, 1.0), (40, 4, 0.01), (300, 8, 3e6)])
def test_against_plain_python(spark, n, length, scale):
    rows = rows_of(n, length, scale)
    got = [tuple(r) for r in codes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_python_integers_where_64_bits_do_not_do(spark):
    rows = rows_of(30, 4, 3e6)
    df = spark.createDataFrame(rows, SCHEMA)
    assert not codes.initial(codes.usable(df.selectExpr("vec_id id", "embedding"))).exact
    assert sorted((tuple(r) for r in codes.compressed(df).collect()), key=str) == brute(rows)
    far = [(k, [float(np.float32(x * 1e25)) for x in (k, -k, 1, 2)], 1, "x") for k in range(300)]
    got = {r.vec_id: r for r in codes.compressed(spark.createDataFrame(far, SCHEMA)).collect()}
    want = {k: c for k, c, *_ in brute(far)}
    assert {k: r.code for k, r in got.items()} == want and any(r.error is None for r in got.values())


def test_odd_tables(spark):
    df = spark.createDataFrame(rows_of(10), SCHEMA)
    assert codes.compressed(df.limit(0)).count() == 0
    assert codes.compressed(df.where("embedding is null")).count() == 0
    bare = codes.compressed(df.select("vec_id", "embedding")).collect()
    assert len(bare) == 12 and len({r.label_error for r in bare}) == 1
    other = spark.createDataFrame([(100, [1.0, 2.0], 1, "x"), (None, [0.5] * 8, 1, "x"), (3, [0.25] * 8, 1, "x")], SCHEMA)
    got = codes.compressed(df.unionByName(other)).collect()
    assert len(got) == 14 and sum(r.vec_id == 3 for r in got) == 2 and sum(r.vec_id is None for r in got) == 1
    short = codes.compressed(spark.createDataFrame([(k, [0.1 * k] * 6, 1, "x") for k in range(5)], SCHEMA)).collect()
    assert len(short) == 5 and all(r.error == 0 for r in short)  # six components: the last part is filled up


def test_sql_twin(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = c.execute(codes.oracle_sql())
    names = [d[0] for d in want.description]
    got = codes.compressed(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
