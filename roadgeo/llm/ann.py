"""Nearest neighbours by inner product: stable projections to few dimensions, indexed by kd-tree, with a chi-square stopping test."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, limit_batches, materialize, met, sorted_groups

#: Projected dimensions (even); a neighbour is missed with a chance of 1 - SURE at most; neighbours of each query.
DIMS, SURE, K = 20, 0.93, 20
#: Vectors of a cell on average, of a leaf within it; sampled vectors that the cells' tree is fitted on; cells of the tree at
#: most, so that their boxes, which are broadcast, stay within some MB (a cell that gets more than twice CELL vectors is
#: several tasks, so there may be any number of vectors); queries of one block that a cell serves at once.
CELL, LEAF, SAMPLE, CELLS, BLOCK = 8192, 128, 65_536, 16_384, 4096
#: Cells, besides its own, that a query is sent to before its reach is known better and the others are chosen.
NEAR = 4
#: Pairs whose inner products are computed at once.
PAIRS = 1 << 16
SEED = 17


def chi_square(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Distribution function of the chi-square law with an even number of degrees of freedom."""
    h = np.minimum(np.asarray(x, float) / 2, 700.0)
    return 1 - np.exp(-h) * sum(h**i / factorial(i) for i in range(dims // 2))


def projection(width: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    """Standard normal (2-stable) directions for vectors of the width and one coordinate more."""
    return np.random.default_rng(seed).normal(size=(width + 1, dims))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with sqrt(top^2 - |x|^2) appended: among these, the largest inner product with a query is the nearest to (query, 0)."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, top**2 - (x * x).sum(axis=1)))[:, None]])


class KdTree:
    """Leaves of a kd-tree over projected points, split at medians of the widest side, with their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order, cuts = np.arange(len(points)), [(0, len(points))]
        self.splits: list[tuple] = []
        leaves = []
        while cuts:
            a, b = cuts.pop()
            own = points[self.order[a:b]]
            side = int((own.max(axis=0) - own.min(axis=0)).argmax()) if b > a else 0
            if b - a <= leaf or own[:, side].min() == own[:, side].max():
                leaves.append((a, b))
                continue
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, side], mid)]
            cuts += [(a, a + mid), (a + mid, b)]
        self.leaves = leaves
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in leaves]).reshape(len(leaves), -1)
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in leaves]).reshape(len(leaves), -1)


def cells_of(points: np.ndarray, count: int) -> list[tuple]:
    """A kd-tree of `count` cells or fewer over a sample: nodes (side, value, left, right), a negative child is cell -1 - child."""
    nodes: list[list] = []
    n_cells = 0

    def grow(own: np.ndarray, count: int) -> int:
        nonlocal n_cells
        if count > 1 and len(own) > 1:
            side = int((own.max(axis=0) - own.min(axis=0)).argmax())
            value = float(np.quantile(own[:, side], (count // 2) / count))
            left = own[:, side] <= value
            if left.any() and not left.all():
                k = len(nodes)
                nodes.append([side, value, 0, 0])
                nodes[k][2] = grow(own[left], count // 2)
                nodes[k][3] = grow(own[~left], count - count // 2)
                return k
        n_cells += 1
        return -n_cells

    grow(points, count)
    return [tuple(x) for x in nodes]


def cell_boxes(nodes: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each cell of cells_of(); outer sides are unbounded."""
    if not nodes:
        return np.full((1, DIMS), -np.inf), np.full((1, DIMS), np.inf)
    low, high = np.full((len(nodes) + 1, DIMS), -np.inf), np.full((len(nodes) + 1, DIMS), np.inf)
    todo = [(0, np.full(DIMS, -np.inf), np.full(DIMS, np.inf))]
    while todo:
        k, a, b = todo.pop()
        if k < 0:
            low[-1 - k], high[-1 - k] = a, b
            continue
        side, value, left, right = nodes[k]
        lb, ra = b.copy(), a.copy()
        lb[side], ra[side] = value, value
        todo += [(left, a, lb), (right, ra, b)]
    return low, high


def cell_at(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    """The cell that each point lies in."""
    at = np.zeros(len(points), np.int64) if nodes else np.full(len(points), -1)
    table = np.array([(s, v, left, right) for s, v, left, right in nodes]) if nodes else np.zeros((0, 4))
    while len(go := np.nonzero(at >= 0)[0]):
        t = table[at[go]]
        at[go] = np.where(points[go, t[:, 0].astype(int)] <= t[:, 1], t[:, 2], t[:, 3]).astype(np.int64)
    return -1 - at


def box_distance(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of each query from each box."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - q[:, j, None], q[:, j, None] - high[None, :, j]), 0.0)
        out += gap * gap
    return out


def quantile(sure: float, dims: int = DIMS) -> float:
    """Where chi_square() reaches `sure`, by bisection; infinite for 1 or more."""
    if sure >= 1:
        return float("inf")
    low, high = 0.0, 1400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), dims) < sure else (low, mid)
    return high


def search(x: np.ndarray, ids: np.ndarray, px: np.ndarray, q: np.ndarray, pq: np.ndarray, reach: np.ndarray, k: int, top: float, sure: float = SURE) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Scores and positions of each query's k best among x, fewer where the chi-square test stops first, and how many were verified.

    Leaves are taken in the order of their projected distance, and of a leaf the points whose own projected distance r
    doesn't stop the query: F(r^2 / d^2) < sure, d being its k-th distance so far or `reach`, the squared k-th distance
    known from elsewhere. Only these are held against the query in full. Queries at one leaf are served together.
    """
    tree, stop = KdTree(px, LEAF), quantile(sure, px.shape[1])
    dist = box_distance(tree.low, tree.high, pq)
    turn = np.argsort(dist, axis=1, kind="stable")
    norms = (q * q).sum(axis=1) + top**2
    best = np.full((len(q), k), -np.inf)
    where = np.full((len(q), k), -1)
    verified = np.zeros(len(q), np.int64)
    live = np.arange(len(q))
    floor = np.where(np.isinf(reach), -np.inf, (norms - reach) / 2 - 1e-9 * (norms + 1))  # k better ones are known from elsewhere
    own_norm, q_norm = (px * px).sum(axis=1), (pq * pq).sum(axis=1)

    def radius(of: np.ndarray) -> np.ndarray:
        d2 = np.minimum(reach[of], np.maximum(norms[of] - 2 * best[of, -1], 0.0))
        return np.where(np.isinf(d2), np.inf, stop * d2) if np.isfinite(stop) else np.full(len(of), np.inf)

    for step in range(len(tree.leaves)):
        go = dist[live, turn[live, step]] <= radius(live)
        live = live[go]
        if not len(live):
            break
        leaf = turn[live, step]
        order = np.argsort(leaf, kind="stable")
        bounds = np.nonzero(np.diff(leaf[order]))[0] + 1
        for own in np.split(live[order], bounds):
            a, b = tree.leaves[turn[own[0], step]]
            members = tree.order[a:b]
            r2 = q_norm[own, None] + own_norm[members][None] - 2 * pq[own] @ px[members].T
            near = r2 <= radius(own)[:, None] * (1 + 1e-9) + 1e-9
            score = np.full(near.shape, -np.inf)
            rows, cols = np.nonzero(near)
            for i in range(0, len(rows), PAIRS):
                m, n = rows[i : i + PAIRS], cols[i : i + PAIRS]
                score[m, n] = np.einsum("pd,pd->p", q[own[m]], x[members[n]])
            verified[own] += near.sum(axis=1)
            rise = near & (score >= np.maximum(best[own, -1], floor[own])[:, None])
            some = rise.any(axis=1)
            if not some.any():
                continue
            own, score, rise = own[some], np.where(rise[some], score[some], -np.inf), rise[some]
            both = np.hstack([best[own], score])
            at = np.hstack([where[own], np.where(rise, members[None], -1)])
            tie = np.where(at < 0, np.iinfo(np.int64).max, ids[at])
            pick = np.lexsort((tie, -both), axis=1)[:, :k]
            best[own], where[own] = np.take_along_axis(both, pick, 1), np.take_along_axis(at, pick, 1)
    keep = where >= 0
    return [best[i, keep[i]] for i in range(len(q))], [where[i, keep[i]] for i in range(len(q))], verified


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part: no null, empty, zero or non-finite vector, no null id."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0))


def _padded(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def nearest(vectors: DataFrame, every: int = 20, k: int = K, id_column: str = "vec_id", column: str = "embedding", cell: int = CELL, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score, verified: the k rows nearest, by inner product, to each row whose id is divisible by `every`.

    Equal vectors are one class: a query class is searched once, and of a candidate class the k + 1 smallest ids are
    kept, which are all that any top k can hold. Every class lies in a cell of a kd-tree over the projected vectors,
    fitted on SAMPLE of them. A query first searches its own cell, then the NEAR next that the chi-square test doesn't
    leave out at the distance found there, then all others that the test, at the distance found by then, doesn't. A row's own
    id is never its candidate; of rows that share an id, that whose vector sorts first stands for it; shorter vectors are
    filled with zeros. verified says for how many candidates the query's inner product was computed. An empty table gives
    none; one vector has no neighbour.
    """
    spark = vectors.sparkSession
    limit_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(usable(vectors, id_column, column).groupBy("vec_id").agg(F.min("v").alias("v")))
    asks = F.col("vec_id") % every == 0
    # The k + 1 smallest ids of each class, kept small by tasks first: a vector may be a third of all rows.
    fewest = lambda ids: F.slice(F.array_sort(F.flatten(F.collect_list(ids))), 1, k + 1)
    salted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(4 * n)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"), F.count("*").alias("n"), F.bool_or(asks).alias("asked"))
    classes = salted.groupBy("v").agg(fewest("ids").alias("ids"), F.sum("n").alias("n"), F.bool_or("asked").alias("asked")).withColumn("c", F.element_at("ids", 1))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    classes = materialize(classes.select("c", "v", "ids", "n", "asked", norm.alias("norm")))
    count, width, top = classes.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    schema = "query_id long, rank int, vec_id long, score double, verified long"
    if not count:
        return spark.createDataFrame([], schema)
    directions = projection(width)
    sample = classes.select("v").orderBy(F.xxhash64("c", F.lit(SEED))).limit(SAMPLE).toPandas().v
    points = lifted(np.array([np.pad(x, (0, width - len(x))) for x in sample]), top) @ directions
    nodes = cells_of(points, min(CELLS, -(-count // cell)))
    low, high = cell_boxes(nodes)

    place = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("c", pa.int64()), ("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("reach", pa.float64())])
    kinds = "cell int, kind int, c long, v array<double>, ids array<long>, reach double"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates to their cells; queries to the cell that their own projection lies in."""
        for b in batches:
            if not b.num_rows:
                continue
            x = _padded(b.column("v"), width)
            own = cell_at(nodes, lifted(x, top) @ directions)
            ask = np.nonzero(b.column("asked").to_numpy(zero_copy_only=False))[0]
            home = cell_at(nodes, np.hstack([x[ask], np.zeros((len(ask), 1))]) @ directions)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([0] * len(x), pa.int32()), b.column("c"), b.column("v"), b.column("ids"), pa.array([None] * len(x), pa.float64())], schema=place)
            if len(ask):
                asks = b.take(pa.array(ask))
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array([1] * len(ask), pa.int32()), asks.column("c"), asks.column("v"), pa.array([None] * len(ask), place.field("ids").type), pa.array([np.inf] * len(ask), pa.float64())], schema=place)

    dealt = materialize(classes.select("c", "v", "ids", "asked").mapInArrow(deal, kinds))
    members, home = dealt.where("kind = 0"), dealt.where("kind = 1")

    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / (2 * cell)).cast("int").alias("slices"))

    def visits(asks: DataFrame) -> DataFrame:
        """Best of each query in each cell it goes to: (c, score, near, verified)."""
        # A cell that many queries visit is copied for each BLOCK of them, and one of many members is cut into slices that
        # each query of the cell goes to, so no task has more than one block's and one slice's work.
        load = asks.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).join(sizes, "cell")
        whole = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        one = lambda name: F.pmod(F.xxhash64("c"), name).cast("int")
        keys = ["cell", "part", "slice"]
        sent = asks.join(load, "cell").withColumn("part", one("parts")).withColumn("slice", whole("slices"))
        held = members.join(load, "cell").withColumn("slice", one("slices")).withColumn("part", whole("parts"))
        stream = held.select(*keys, "kind", "c", "v", "ids", "reach").unionByName(sent.select(*keys, "kind", "c", "v", "ids", "reach"))
        out = pa.schema([("c", pa.int64()), ("score", pa.list_(pa.float64())), ("near", pa.list_(pa.int64())), ("verified", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in sorted_groups(batches, keys, 1):
                kind = t.column("kind").to_numpy()
                place = np.stack([t.column(name).to_numpy() for name in keys])
                for g in np.split(np.arange(len(kind)), np.nonzero((place[:, 1:] != place[:, :-1]).any(axis=0))[0] + 1):
                    m, a = g[kind[g] == 0], g[kind[g] == 1]
                    if not len(m) or not len(a):
                        continue
                    has, ask = t.take(pa.array(m)), t.take(pa.array(a))
                    x, q = _padded(has.column("v"), width), _padded(ask.column("v"), width)
                    lists = has.column("ids").to_pylist()
                    lead = np.array([i[0] for i in lists])
                    found, at, verified = search(x, lead, lifted(x, top) @ directions, q, np.hstack([q, np.zeros((len(q), 1))]) @ directions, ask.column("reach").to_numpy(), k + 1, top, sure)
                    scores, near = [], []
                    for s, p in zip(found, at, strict=True):
                        flat = sorted(((-float(v), i) for v, c in zip(s, p, strict=True) for i in lists[c]))[: k + 1]
                        scores.append([-v for v, _ in flat])
                        near.append([i for _, i in flat])
                    yield pa.RecordBatch.from_arrays([ask.column("c").combine_chunks(), pa.array(scores, out.field("score").type), pa.array(near, out.field("near").type), pa.array(verified)], schema=out)

        return stream.repartition(n, *keys).sortWithinPartitions(*keys, "kind", "c").mapInArrow(run, "c long, score array<double>, near array<long>, verified long")

    def best(visited: DataFrame) -> DataFrame:
        """The k + 1 best of each query over its visits so far, (c, top, reach, verified); lists of k + 1 meet by class, a row for each cell visited."""
        every = visited.groupBy("c").agg(F.flatten(F.collect_list(F.arrays_zip("score", "near"))).alias("all"), F.sum("verified").alias("verified"))
        pairs = F.transform("all", lambda p: F.struct((-p["score"]).alias("far"), p["near"].alias("vec_id")))
        return every.select("c", F.slice(F.array_sort(pairs), 1, k + 1).alias("top"), "verified")

    def spread(done: int, most: int):
        """The next cells, by projected distance, that the chi-square test lets a query not leave out at its distance so far: up to `most`, after the `done` that it has had besides its own."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    q = _padded(part.column("v"), width)
                    own = part.column("cell").to_numpy()
                    kth = np.array([-t[k]["far"] if t is not None and len(t) > k else -np.inf for t in part.column("top").to_pylist()])
                    d2 = np.maximum((q * q).sum(axis=1) + top**2 - 2 * kth, 0.0)
                    r2 = box_distance(low, high, np.hstack([q, np.zeros((len(q), 1))]) @ directions)
                    r2[np.arange(len(q)), own] = -1.0
                    turn = np.argsort(r2, axis=1, kind="stable")[:, 1 + done : 1 + done + most]
                    limit = np.where(np.isinf(d2), np.inf, stop * d2)
                    a, j = np.nonzero(np.take_along_axis(r2, turn, 1) <= limit[:, None])
                    cells = turn[a, j]
                    took = part.take(pa.array(a))
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([1] * len(a), pa.int32()), took.column("c"), took.column("v"), pa.array([None] * len(a), place.field("ids").type), pa.array(d2[a])], schema=place)

        return run

    stop = quantile(sure)
    asked = home.select("cell", "c", "v")
    visited = materialize(visits(home))
    for done, most in ((0, NEAR), (NEAR, len(low))):
        if len(low) > 1 + done:
            more = asked.join(best(visited).select("c", "top"), "c", "left").mapInArrow(spread(done, most), kinds)
            visited = materialize(visited.unionByName(visits(more)))
    tops = best(visited)
    named = met(rows.where(asks), classes.where("asked").select("v", "c", "n"), ["v"], "n", ["vec_id"]).select(F.col("vec_id").alias("query_id"), "c")
    own = F.filter("top", lambda x: x["vec_id"] != F.col("query_id"))
    each = named.join(tops, "c").select("query_id", "verified", F.posexplode(F.slice(own, 1, k)).alias("r", "t"))
    return each.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), "t.vec_id", (-F.col("t.far")).alias("score"), "verified")
