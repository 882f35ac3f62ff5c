"""SimHash near-duplicates, found with BK-trees over shards of the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, as_long, as_text, batch, fresh, limit_batches, materialize, met, sorted_groups
from .graph import components

SEED, SHINGLE, BITS = 42, 4, 64
#: Mean fingerprints that one shard shall hold, and the most that one tree holds; a larger shard becomes several trees.
SHARD, TREE = 64, 4096


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text: bit b is 1 if set in over half of the shingles' XXH64, repeats counted.

    A-Z is lower-cased, words end at ASCII white space. Fewer words than a shingle: all of them are one; none: 0.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        hashes = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[: n - shingle])).tolist()
        hashes = b"".join([xxhash.xxh64_digest(joined[i:j], seed) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)])
    h = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(h[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(h), 65536))
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) for each row, and h, a hash of the text, if `hashed`; no shuffle."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", "h")[: 2 + hashed]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(b.column(1))], dtype=np.uint64)
            yield batch(schema, b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:])

    limit_batches(docs.sparkSession)
    own = docs.select(as_long(docs, "doc_id").alias("doc_id"), as_text(docs).alias("text"), *[F.xxhash64(as_text(docs)).alias("h")] * hashed)
    return own.mapInArrow(run, "doc_id long, fp long" + ", h long" * hashed)


class BKForest:
    """BK-trees of many shards in flat arrays, built and searched level by level for all shards at once.

    A node's children are keyed by their integer Hamming distance to it; a search at distance d from a node
    follows only edges from d - radius to d + radius.
    """

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        n = len(fps)
        self.fps = fps
        _, first, inverse = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first[inverse]  # of each item's tree
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        item = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[item]
        while len(item):
            d = np.bitwise_count(fps[item] ^ fps[at]).astype(np.int64)
            key = at * (BITS + 1) + d
            _, lead, back = np.unique(key, return_index=True, return_inverse=True)
            parent[item[lead]], edge[item[lead]] = at[lead], d[lead]
            rest = np.ones(len(item), bool)
            rest[lead] = False
            at, item = item[lead][back][rest], item[rest]
        self.child = np.argsort(parent * (BITS + 1) + edge, kind="stable")
        self.keys = (parent * (BITS + 1) + edge)[self.child]

    def pairs(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Item and item in its tree within the radius, for the items given."""
        q, at, out = queries, self.root[queries], []
        while len(q):
            d = np.bitwise_count(self.fps[q] ^ self.fps[at]).astype(np.int64)
            hit = d <= radius
            out.append((q[hit], at[hit]))
            lo = np.searchsorted(self.keys, at * (BITS + 1) + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, at * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
            k = hi - lo
            start = np.repeat(lo - np.concatenate(([0], np.cumsum(k)[:-1])), k)
            q, at = np.repeat(q, k), self.child[start + np.arange(len(start))]
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def spanning(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest item that each of n items reaches over the pairs (a, b)."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def tree_links(fps: np.ndarray, shard: np.ndarray, radius: int, most_visits: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """For shards given by equal numbers: links that join every pair within the radius, one a linked item at most."""
    forest, n = BKForest(fps, shard), len(fps)
    sizes = np.bincount(forest.root, minlength=n)[forest.root]
    label, done = np.arange(n), 0
    bound = np.cumsum(sizes)
    while done < n:
        upto = max(done + 1, int(np.searchsorted(bound, (bound[done - 1] if done else 0) + most_visits, side="right")))
        a, b = forest.pairs(np.arange(done, upto), radius)
        keep = label[a] != label[b]
        label = spanning(n, a[keep], b[keep], label)
        done = upto
    linked = np.nonzero(label != np.arange(n))[0]
    return fps[linked], fps[label[linked]]


def shard_plan(count: int, radius: int) -> list[int]:
    """Bit masks of the shards' keys.

    The bits are cut into radius + g blocks; two fingerprints within the radius agree in g of them or more, so they
    meet in the shard of some choice of g blocks. g grows with the number of fingerprints, so that shards stay small.
    """
    for g in range(1, 5):
        cuts = [round(BITS * i / (radius + g)) for i in range(radius + g + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
        masks = [sum(c) for c in combinations(blocks, g)]
        if count <= SHARD << min(m.bit_count() for m in masks):
            break
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(fps: DataFrame, radius: int, tree: int = TREE) -> DataFrame:
    """Edges (u, v) that span the components of distinct fingerprints `fp` under `radius` differing bits or fewer.

    Fingerprints are dealt to shards by shard_plan(). A shard's tree goes to the queries of the same shard over the
    shuffle: the driver never holds fingerprints. A shard of over `tree` fingerprints is split by hash, and every two
    of its parts meet in a tree of their own, so no task holds more than two parts at once.
    """
    masks = shard_plan(fps.count(), radius)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    keys = ["c", "m", "lo", "hi"]
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("m")) for i, m in enumerate(masks)])).alias("s")).select("fp", "s.c", "s.m")
    sizes = rows.groupBy("c", "m").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / tree).cast("int"))
    part = F.pmod(F.xxhash64("fp"), "parts").cast("int")
    dealt = rows.join(sizes, ["c", "m"]).select("fp", "c", "m", part.alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")).select("fp", "c", "m", F.least("p", "o").alias("lo"), F.greatest("p", "o").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, keys, 50_000):
            k = np.stack([t.column(c).to_numpy().astype(np.int64) for c in keys])
            shard = np.concatenate(([0], np.cumsum((k[:, 1:] != k[:, :-1]).any(axis=0))))
            u, v = tree_links(t.column("fp").to_numpy().view(np.uint64), shard, radius)
            yield batch(schema, pa.array(u.view(np.int64)), pa.array(v.view(np.int64)))

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def rooted(marked: DataFrame, least, radius: int) -> DataFrame:
    """fp, doc (the aggregate `least` over its rows), n (its rows) and root, a fingerprint that stands for its component."""
    nodes = materialize(marked.groupBy("fp").agg(least.alias("doc"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    return materialize(nodes.join(roots, "fp", "left").select("fp", "doc", "n", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links of `radius` bits or fewer) for each row.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows keep a row each, a null
    doc_id takes part but is never a component's id unless no other is there. Equal fingerprints are one node, so a
    group of copies is never expanded into pairs; a fingerprint, or a component, of very many rows is told to all tasks.
    """
    marked = materialize(fingerprints(docs, shingle))
    tree = rooted(marked, F.min("doc_id"), radius)
    least = tree.groupBy("root").agg(F.min("doc").alias("component_id"), F.count("*").alias("nodes"))
    named = materialize(met(tree, least, ["root"], "nodes", ["fp"]).select("fp", "component_id", "n"))
    return met(marked, named, ["fp"], "n", ["doc_id"]).select("doc_id", "fp", "component_id")


def with_hex(found: DataFrame) -> DataFrame:
    """The fingerprint as 16 lower-case hexadecimal digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row of each component: that with the smallest doc_id, nulls last, and of rows that repeat it the smallest text hash.

    A row is known by doc_id and text hash: rows equal in both have one fingerprint, so they are of one component, and
    whichever of them stays is no matter. Rows of a null or shared doc_id whose texts differ are of components of their
    own, so each of them stays. Null and empty texts are one component. Columns may have any names; an empty table gives
    an empty one. The texts are shuffled once, by both, for the join with the rows to keep.
    """
    i, none, k, d, gone, h, row = fresh(docs, 7)
    marked = materialize(fingerprints(docs, hashed=True))
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h"))
    of = F.col("doc.doc_id")
    keep = rooted(marked, least, radius).groupBy("root").agg(F.min("doc").alias("doc")).select(F.coalesce(of, F.lit(0)).alias(d), of.isNull().alias(gone), F.col("doc.h").alias(h))
    # Of rows equal in all three columns a task hands on one, so a row that a third of the table repeats is a row a task; the join is by the same columns, none of them null, so the texts are shuffled once.
    own = docs.withColumns({i: F.coalesce(as_long(docs, "doc_id"), F.lit(0)), none: as_long(docs, "doc_id").isNull(), k: F.xxhash64(as_text(docs))})
    once = own.groupBy(i, none, k).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row))
    kept = once.join(keep, (F.col(i) == F.col(d)) & (F.col(none) == F.col(gone)) & (F.col(k) == F.col(h)))
    return kept.select(*[F.col(row)[c].alias(c) for c in docs.columns])
