"""Mixing sources to target weights with balanced samples drawn by the cube method."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, as_text, fresh, materialize

#: Weights of the sources in order, repeated; share of all words that the mix takes; most times that a source is taken.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents of one flight; a round leaves LEFT of them or fewer undecided.
FLIGHT, LEFT = 4096, 2
#: Units that a source's last flight leaves to the landing besides.
LAND = 10
#: Equal rows that one step makes from their number.
BLOCK = 4096
EPS = 1e-9


def words_of(docs: DataFrame):
    """Number of runs of anything but ASCII white space."""
    return F.regexp_count(as_text(docs), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Source, source_size and target of a table (source, size).

    Sources by code point, null last, have the weights in turn. A target stops at `most` times its source's size and
    the excess is shared anew by weight until none is above: the fixed point is min(cap, weight x level). Each round is
    one aggregate over the sources: the level of those not yet at their caps rises until it lifts no other to its cap.
    Sources may be many (hosts), so their places come from a range partitioning, and no task holds all of them.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = [F.col("source").isNull(), F.hex("source")]
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(by.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    starts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    named = dealt.withColumn("k", place).join(F.broadcast(starts), "part").withColumn("k", F.col("k") + F.col("start"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    caps = materialize(named.select("source", "source_size", w.alias("w"), (most * F.col("source_size").cast("double")).alias("cap")))
    due = share * float(caps.agg(F.sum("source_size")).first()[0] or 0)
    level, was = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("w") * level
        taken, rest, many = caps.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w"))), F.count_if(full)).first()
        if many == was or not rest:
            break
        level, was = max(level, (due - (taken or 0.0)) / rest), many
    return caps.select("source", "source_size", F.least("cap", F.col("w") * level if rest else F.col("cap")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities until LEFT or fewer are strictly between 0 and 1; sums of p and of p x size stay.

    Of three undecided units at a time, the step follows the null space of the 2 x 3 matrix of their counts and sizes,
    to either end of the cube with the odds that keep each expectation (Chauvet and Tille's fast flight).
    """
    p = np.clip(p.astype(float), 0.0, 1.0)
    queue = np.nonzero((p > EPS) & (p < 1 - EPS))[0].tolist()
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    x, s, draws = p.tolist(), size.astype(float).tolist(), iter(rng.random(len(queue) + 8).tolist())
    held: list[int] = []
    nxt = 0
    while True:
        while len(held) < LEFT + 1 and nxt < len(queue):
            held.append(queue[nxt])
            nxt += 1
        if len(held) <= LEFT:
            break
        i, j, k = held
        v = (s[k] - s[j], s[i] - s[k], s[j] - s[i])
        if v == (0.0, 0.0, 0.0):
            v = (1.0, -1.0, 0.0)
        up = min(((1 - x[u]) if c > 0 else -x[u]) / c for u, c in zip(held, v, strict=True) if c)
        down = min((x[u] if c > 0 else x[u] - 1) / c for u, c in zip(held, v, strict=True) if c)
        step = up if next(draws) * (up + down) < down else -down
        held = []
        ends = []
        for u, c in zip((i, j, k), v, strict=True):
            x[u] += step * c
            ends.append(min(x[u], 1 - x[u]))
        least = min(ends)
        for u, e in zip((i, j, k), ends, strict=True):
            if e <= EPS or e == least:
                x[u] = 0.0 if x[u] < 0.5 else 1.0
            else:
                held.append(u)
    return np.array(x)


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the undecided units of a last flight (LEFT + LAND at most).

    Of the corners of their cube whose count is within 1 of what is due, that with the nearest word total, ties by draw.
    """
    open_ = np.nonzero((p > EPS) & (p < 1 - EPS))[0]
    if not len(open_):
        return p
    corners = np.array(list(product((0.0, 1.0), repeat=len(open_)))).reshape(-1, len(open_))
    off = np.abs(corners @ size[open_] - (p[open_] * size[open_]).sum())
    many = np.abs(corners.sum(axis=1) - p[open_].sum())
    off[many > max(1.0, many.min())] = np.inf
    best = np.nonzero(off == off.min())[0]
    p[open_] = corners[best[rng.integers(len(best))]]
    return p


def last_flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A flight that leaves out LAND units of spread sizes, for the landing to choose among; units come by size, largest first."""
    open_ = np.nonzero((p > EPS) & (p < 1 - EPS))[0]
    kept = np.unique(open_[np.linspace(len(open_) // 4, len(open_) - 1, LAND).astype(int)]) if len(open_) else open_
    own = p.copy()
    own[kept] = 0.0
    flown = flight(own, size, rng)
    flown[kept] = p[kept]
    return landing(flown, size, rng)


def balanced(units: DataFrame, seed: int = 7, flight_rows: int = FLIGHT) -> DataFrame:
    """Cube-method sample of units (source, u, size, p): the same columns with p 0 or 1.

    Size and u order the units, the largest first so that small ones are left to the landing, and seed the draws, so reruns agree. A source's units are dealt by hash to flights of bounded
    size; what these leave undecided (LEFT units of each at most) goes on to the next round, until one flight of each
    source decides with a landing. Rounds are logarithmic in a source's units; a hot source is many flights.
    """
    schema = "source string, u long, size long, p double"

    def fly(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "u"], ascending=[False, True], kind="stable").reset_index(drop=True)
            rng = np.random.default_rng([seed, len(pdf), int(pdf.u.iloc[0]) & (2**63 - 1), int(pdf["size"].sum())])
            pdf["p"] = (last_flight if last else flight)(pdf.p.to_numpy(copy=True), pdf["size"].to_numpy(), rng)
            return pdf[["source", "u", "size", "p"]]

        return run

    done, left, many, turn = None, units, units.groupBy("source").count().agg(F.max("count")).first()[0] or 0, 0
    while True:
        last = many <= flight_rows
        counted = left.groupBy(F.col("source").alias("_s")).agg(F.ceil(F.count("*") / flight_rows).cast("int").alias("flights"))
        dealt = left.join(counted, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("f", F.pmod(F.xxhash64("u", F.lit(turn)), "flights"))
        flown = dealt.groupBy("source", "f").applyInPandas(fly(last), schema)
        if last:
            return flown if done is None else done.unionByName(flown)
        flown = materialize(flown)
        is_open = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done = flown.where(~is_open) if done is None else done.unionByName(flown.where(~is_open))
        left = flown.where(is_open)
        was, many, turn = many, left.groupBy("source").count().agg(F.max("count")).first()[0] or 0, turn + 1
        if many >= was:
            raise RuntimeError("a round of flights decided nothing")


def mix(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """Table (doc_id, source, size, u) to the same with source_size, target and copies: how often the mix takes each row.

    A source's rows have target / source_size expected copies: the whole part is taken outright and the rest by a
    sample balanced on words and on documents. Sources without words have target 0 and no copies. u must tell rows
    apart; rows equal in it too are taken alike in number, whichever of them.
    """
    goal = targets(sizes, weights, share, most).withColumnRenamed("source", "_s")
    rows = sizes.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    pi = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = materialize(rows.withColumn("whole", F.floor(pi + EPS)).withColumn("p", F.greatest(pi - F.floor(pi + EPS), F.lit(0.0))))
    sample = balanced(rows.where(F.col("p") > EPS).select("source", "u", "size", "p"), seed)
    taken = sample.where("p > 0.5").select("u", F.lit(1).alias("more")).distinct()
    return rows.join(taken, "u", "left").withColumn("copies", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("int"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and u of each row. u is a hash of the row's place among its likes, the same in each rerun.

    Equal rows are no different from each other, so they are counted with partial aggregates and made anew from their
    number, a block of BLOCK at a time: a row that a third of the table repeats is never one task's group.
    """
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(as_long(docs, "doc_id").alias("doc_id"), source.alias("source"), words_of(docs).alias("size"), F.xxhash64(as_text(docs)).alias("h"))
    key = ["doc_id", "source", "size", "h"]
    blocks = rows.groupBy(*key).count().withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / BLOCK))))
    each = blocks.select(*key, F.explode(F.sequence(F.col("b") * BLOCK, F.least((F.col("b") + 1) * BLOCK, "count") - 1)).alias("k"))
    return materialize(each.withColumn("u", F.xxhash64(*key, "k")))


def mixture(docs: DataFrame) -> DataFrame:
    """Digest of the mix of whole documents: doc_id, size, source_size, target, taken (words, repeats counted).

    Null text has size 0, a null source is a source of its own, in the last place. No document is taken over twice.
    """
    m = mix(sized(docs))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns, whatever the names.

    A null or missing source is a source of its own; empty and null texts have no words and go by number alone; an empty
    table gives an empty one.
    """
    d, s, h, i, o, k, every, rows, n, c, e = fresh(docs, 11)
    m = mix(sized(docs)).where("copies > 0").select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("h").alias(h), "copies")
    per = m.groupBy(d, s, h).agg(F.sum("copies").alias(every), F.count("*").alias(rows))
    # Rows equal in id, source and text are one row taken as often as all of them: which of them goes is no matter.
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    own = docs.withColumns({i: as_long(docs, "doc_id"), o: source, k: F.xxhash64(as_text(docs))})
    joined = own.join(per, F.col(i).eqNullSafe(F.col(d)) & F.col(o).eqNullSafe(F.col(s)) & (F.col(k) == F.col(h)))
    number = F.row_number().over(Window.partitionBy(d, s, h).orderBy(k))
    share = F.floor(F.col(every) / F.col(rows)) + F.when(F.col(n) <= F.col(every) % F.col(rows), 1).otherwise(0)
    return joined.withColumn(n, number).withColumn(c, share.cast("int")).where(F.col(c) > 0).withColumn(e, F.explode(F.sequence(F.lit(1), F.col(c)))).select(docs.columns)
