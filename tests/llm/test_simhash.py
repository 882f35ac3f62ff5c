from __future__ import annotations

import numpy as np
import pytest
import xxhash

from roadgeo.llm import simhash
from roadgeo.llm.graph import components


def plain_fingerprint(text: str) -> int:
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if x]
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps: list[int], radius: int) -> list[int]:
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    label = np.arange(len(a))
    while True:
        new = np.where(near, label[None, :], len(a)).min(axis=1)
        if np.array_equal(new, label):
            return label.tolist()
        label = new


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "a b c d", "A b\tC d\x0be f a b c d e", "É é\x85x y z w É é\x85x", "w " * 5000])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("tree", [simhash.TREE, 7])
def test_links_as_by_brute_force(spark, tree):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        x = int(b)
        for _ in range(12):
            x ^= sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(1, 6)))
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    found = {r.node & (1 << 64) - 1: r.root for r in components(simhash.links(df, 4, tree)).collect()}
    want = groups(fps, 4)
    size = {k: want.count(k) for k in want}
    for f, k in zip(fps, want, strict=True):
        assert (f in found) == (size[k] > 1)
    for i, f in enumerate(fps):
        for j in range(i):
            if f in found and fps[j] in found:
                assert (found[f] == found[fps[j]]) == (want[i] == want[j])


def test_shards_keep_every_near_pair():
    for count in (10, 1 << 22, 1 << 30, 1 << 40):
        masks = simhash.shard_plan(count, 4)
        rng = np.random.default_rng(1)
        for _ in range(200):
            x = sum(1 << int(k) for k in rng.choice(64, 4, replace=False))
            assert any(not x & m & (1 << 64) - 1 for m in masks)


def test_documents(spark):
    words = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(5, words, "k"), (3, words, "k"), (9, words.replace("w7 ", "x "), "k"), (4, "quite another text " * 9, "k"), (8, None, "k"), (7, "", "k"), (7, "", "k"), (None, "some words of a text without id", "k")], "doc_id long, text string, fp string")
    rows = simhash.with_hex(simhash.near_duplicates(docs)).collect()
    by = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == 8 and by[5] == by[3] == 3 and by[7] == by[8] == 7 and by[4] == 4 and by[None] is None
    assert {r.fingerprint for r in rows if r.doc_id in (7, 8)} == {"0" * 16}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted([0, 3, 4, 7] + ([9] if by[9] == 9 else []))
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100)], "u long, v long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert all(roots[i] == 0 for i in range(41)) and roots[101] == 100 and len(roots) == 43


def test_one_row_of_each_component_whatever_its_id(spark):
    a, b, c, d, e = (" ".join(f"{w}{i}" for i in range(300)) for w in "abcde")
    near = a.replace("a7 ", "x ")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (3, d), (2, e), (None, e), (5, c)]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (0, b), (5, c), (3, d), (2, e)])
    pair = [(None, a), (None, near), (9, near), (9, b)]
    far = bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(near.encode())).count("1")
    kept = simhash.deduplicated(spark.createDataFrame(pair, "doc_id long, text string"), max(4, far)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(9, near), (9, b)])
