"""Exact removal of repeated passages: sparse suffixes, range-partitioned by their leading bytes and sorted in buckets.

A string of LENGTH bytes is a window. Of the K-byte strings in a window the one with the least hash, the leftmost of
equals, is its anchor; equal windows have equal anchors at equal offsets (winnowing), so windows are compared through the
suffixes that begin at their anchors, about one in 85 bytes. A suffix's span is all the bytes of its windows.

Equal spans are told by partial counts: where one occurs twice all of its windows repeat, and a single row of it goes
further. Leading strings (an anchor's K bytes) with one span alone are settled by that. The others are dealt by range of
their leading strings with sampled splitters, so that no leading string lies on both sides of a boundary; a bucket sorts
its suffixes by multikey quicksort. A leading string of over SPLIT different spans would be too much for a bucket: its
windows are dealt anew by longer leading strings (those that neighbouring windows have in common, LEADS bytes), down to
the whole window, which no boundary can part from its equals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, as_long, as_text, batch, fresh, limit_batches, materialize, met, own_dir, sorted_groups

#: Bytes of a repeated string, of an anchor, different spans with one leading string in a bucket.
LENGTH, K, SPLIT = 200, 32, 50_000
WIDTH = LENGTH - K + 1
#: Neighbouring windows that longer and longer leading strings stand for; the last is the window itself.
CLASSES = (WIDTH, 22, 3, 1)
#: Bytes hashed at once, and suffixes that a bucket sorts at once.
PIECE, AT_ONCE = 1 << 20, 20_000
_B = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
_PLACE = np.uint64((1 << 24) - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, and first and last window of each anchor in texts laid end to end; x has fewer than 2^24 bytes."""
    none = np.zeros(0, np.int64)
    if len(x) < LENGTH:
        return none.view(np.uint64), none, none, none
    h, step = x.astype(np.uint64) + np.uint64(1), 1
    while step < K:
        h = h[:-step] * np.uint64(pow(_B, step, 1 << 64)) + h[step:]
        step *= 2
    h = mixed(h)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(key) // WIDTH)
    grid = np.full(blocks * WIDTH, _M, np.uint64)
    grid[: len(key)] = key
    grid = grid.reshape(blocks, WIDTH)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - WIDTH + 1
    place = (np.minimum(after[:n], before[WIDTH - 1 : WIDTH - 1 + n]) & _PLACE).astype(np.int64)
    inside = np.zeros(len(x) + 1, np.int8)
    long_ = ends - starts >= LENGTH
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, ends[long_] - LENGTH + 1, -1)
    window = np.nonzero(np.cumsum(inside[:n]) > 0)[0]
    if not len(window):
        return none.view(np.uint64), none, none, none
    at = place[window]
    first = np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(window) > 1)))
    lo = window[first]
    hi = np.concatenate((window[np.nonzero(first)[0][1:] - 1], window[-1:]))
    return h[at[first]], at[first], lo, hi


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in pieces of PIECE bytes or so: number of each text, offset of what is taken of it, the bytes. A longer text is cut with an overlap, so that each of its windows lies in one cut alone."""
    held, size = ([], [], []), 0
    for k, t in enumerate(texts):
        for i in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            cut = t[i : i + PIECE + LENGTH - 1]
            if len(cut) < LENGTH:
                continue
            for h, v in zip(held, (k, i, cut), strict=True):
                h.append(v)
            size += len(cut)
            if size >= PIECE:
                yield held
                held, size = ([], [], []), 0
    if size:
        yield held


def anchor_rows(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each anchor: number of the text, anchor's hash, span's hash, place << 16 | places before it of the first window << 8 | windows after the first, further windows, times.

    Suffixes with equal spans whose windows follow upon each other (a periodic text) are one row: the first, the number of
    windows of all others, and how many they are.
    """
    out: list[tuple] = [(np.zeros(0, np.int64),) * 6]
    for number, offset, cuts in _pieces(texts):
        ends = np.cumsum([len(c) for c in cuts])
        starts = ends - [len(c) for c in cuts]
        data = b"".join(cuts)
        h, at, lo, hi = anchors(np.frombuffer(data, np.uint8), starts, ends)
        if not len(h):
            continue
        spans = b"".join([xxhash.xxh3_64_digest(data[a:b], c) for a, b, c in zip(lo.tolist(), (hi + LENGTH).tolist(), (at - lo).tolist(), strict=True)])
        span = np.frombuffer(spans, ">i8").astype(np.int64)
        k = np.searchsorted(ends, at, side="right")
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (span[1:] != span[:-1]) | (k[1:] != k[:-1]) | (lo[1:] != hi[:-1] + 1)))
        first = np.nonzero(new)[0]
        last = np.concatenate((first[1:], [len(h)])) - 1
        k, place = k[first], (at - starts[k] + np.array(offset)[k])[first]
        out.append((np.array(number)[k], h[first].view(np.int64), span[first], place << 16 | (at - lo)[first] << 8 | (hi - lo)[first], hi[last] - hi[first], last - first + 1))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def multikey_sort(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian 8-byte characters, and common leading bytes of each row in that order with the one before.

    Multikey quicksort, breadth first: each round sorts what is still tied by its next character.
    """
    m, levels = columns.shape
    order, common = np.arange(m), np.zeros(m, np.int64)
    tied = np.ones(m, bool)  # with the row before; only within what is tied does a round compare
    if m:
        tied[0] = False
    for level in range(levels):
        open_ = tied.copy()
        open_[:-1] |= tied[1:]
        go = np.nonzero(open_)[0]
        if not len(go):
            break
        run = np.cumsum(~tied[go])
        values = columns[order[go], level]
        by = np.lexsort((values, run))
        order[go], values = order[go][by], values[by]
        inner = tied[go]
        apart = np.concatenate(([0], values[1:] ^ values[:-1])).astype(np.uint64)
        split = inner & (apart != 0)
        lead = np.zeros(len(go), np.int64)
        for k in range(1, 8):
            lead += (apart >> np.uint64(8 * (8 - k))) == 0
        common[go[inner & ~split]] = 8 * (level + 1)
        common[go[split]] = 8 * level + lead[split]
        tied[go[split]] = False
    return order, common


def runs(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of a group's number and bytes, and the bytes beyond that number that each has in common with the one before (negative at a new group)."""
    width = -columns.shape[1] % 8
    order, common = multikey_sort(np.ascontiguousarray(np.pad(columns, ((0, 0), (0, width)))).view(">u8").astype(np.uint64))
    return order, common - 8


def repeated(spans: list[bytes], group: np.ndarray, back: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which windows of each suffix repeat within its group: a row for each suffix, a column for each offset before the anchor.

    spans hold a suffix with what stands before it; back is the anchor's place in the span, count the windows less one.
    The suffixes are sorted twice, by what follows the anchor and by what stands before it, read backwards. A window at
    offset o repeats if another is in its run of LENGTH - o common bytes in the one order and of o in the other.
    """
    m = len(spans)
    right, left = np.zeros((m, LENGTH), np.uint8), np.zeros((m, WIDTH - 1), np.uint8)
    for k, (s, b) in enumerate(zip(spans, back.tolist(), strict=True)):
        r = np.frombuffer(s, np.uint8)
        tail = r[b : b + LENGTH]
        right[k, : len(tail)] = tail
        left[k, :b] = r[:b][::-1]
    lead = group.astype(">u8").view(np.uint8).reshape(m, 8)
    by_right, alike_right = runs(np.hstack([lead, right]))
    by_left, alike_left = runs(np.hstack([lead, left]))
    found = np.zeros((m, WIDTH), bool)
    after, before = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for o in range(WIDTH):
        own = np.nonzero((back - count <= o) & (o <= back))[0]
        if len(own) < 2:
            continue
        after[by_right] = np.cumsum(alike_right < LENGTH - o)
        before[by_left] = np.cumsum(alike_left < o)
        key = after[own] * (m + 1) + before[own]
        by = np.argsort(key, kind="stable")
        same = np.diff(key[by]) == 0
        found[own[by[1:][same]], o] = True
        found[own[by[:-1][same]], o] = True
    return found


def units(span: bytes, back: int, count: int, width: int) -> Iterator[tuple[bytes, int, int, int, bytes]]:
    """A suffix's windows in classes of `width` neighbouring offsets before the anchor: leading string, start in the span, back, count and span of each.

    The leading string is what all windows of a whole class have in common, LENGTH + 1 - width bytes, behind the class's
    number; equal windows are in equal classes.
    """
    for j in range((back - count) // width, back // width + 1):
        least, most = max(j * width, back - count), min(j * width + width - 1, back)
        start, common = back - most, back - j * width
        yield bytes([j]) + span[common : common + LENGTH + 1 - width], start, most, most - least, span[start : start + most - least + LENGTH]


def covered(n: int, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes of a text of n bytes that the intervals cover."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def keyed(docs: DataFrame, c1: str, c2: str) -> DataFrame:
    """docs with c1, c2: 128 bits of the SHA-256 of the text."""
    digest = F.sha2(as_text(docs), 256)
    return docs.withColumns({c: F.conv(F.substring(digest, i, 15), 16, 10).cast("long") for c, i in ((c1, 1), (c2, 17))})


def judged(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (h, s: hashes of leading string and span, n, c1, c2, lo and more) whose leading string occurs twice, with times (of the span), spans (of the leading string) and one (the one row of a span that goes further); and the most spans of a leading string."""
    rows = rows.withColumn("r", F.xxhash64("c1", "c2", "lo"))
    counted = materialize(rows.groupBy("h", "s").agg(F.sum("n").alias("times"), F.min("r").alias("least")))
    leads = materialize(counted.groupBy("h").agg(F.count("*").alias("spans"), F.sum("times").alias("all")).where("all > 1"))
    most = leads.agg(F.max("spans")).first()[0] or 0
    keys = materialize(met(counted, leads, ["h"], "spans", ["s"]).select("h", "s", "times", "least", "spans"))
    return met(rows, keys, ["h", "s"], "times", ["r"]).withColumn("one", F.col("r") == F.col("least")).drop("r", "least"), most


_SPAN = "c1 long, c2 long, lo long, back int, count int, span binary"


def repeats(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """c1, c2, text and iv (array of [start, end) in bytes to remove) of each distinct text.

    Equal texts are one class, joined by partial aggregation. The classes are kept in the shared folder in buckets by
    class, so that candidates and results meet them without another shuffle of the texts. A class of two texts or more
    of LENGTH bytes is removed whole.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = own_dir(spark, "texts")
    name = "texts_" + path.rsplit("-", 1)[1]
    whole = keyed(docs.select(as_text(docs).alias("text")), "c1", "c2")
    distinct = whole.groupBy("c1", "c2").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    distinct.repartition(n, "c1", "c2").write.option("compression", "zstd").option("path", path).bucketBy(n, "c1", "c2").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # leaves the files, and the plan that reads them by bucket

    hashed = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("lo", pa.int64()), ("more", pa.int64()), ("place", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, h, s, place, more, times = anchor_rows(as_bytes(b.column("text")))
            if len(k):
                yield batch(hashed, pa.array(h), pa.array(s), pa.array(times), b.column("c1").take(pa.array(k)), b.column("c2").take(pa.array(k)), pa.array((place >> 16) - (place >> 8 & 255)), pa.array(more), pa.array(place))

    rows = texts.select("c1", "c2", "text").mapInArrow(find, "h long, s long, n long, c1 long, c2 long, lo long, more long, place long")
    likely, most = judged(rows)
    likely = materialize(likely.where("times > 1 or one").select("c1", "c2", "lo", "more", "place", "times", "spans", "one"))
    last = F.col("lo") + F.col("place").bitwiseAND(F.lit(255)) + F.col("more") + LENGTH
    told = [likely.where("times > 1").select("c1", "c2", F.col("lo").alias("start"), last.alias("end"))]

    lead_schema = pa.schema([("lead", pa.binary()), ("c1", pa.int64()), ("c2", pa.int64()), ("lo", pa.int64()), ("back", pa.int32()), ("count", pa.int32()), ("span", pa.binary())])

    def spans_of(chosen: DataFrame, width: int) -> DataFrame:
        """Classes of `width` windows of the suffixes at the places chosen, cut out of their texts."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for c1, c2, text, places in zip(b.column("c1").to_pylist(), b.column("c2").to_pylist(), as_bytes(b.column("text")), b.column("places").to_pylist(), strict=True):
                    for place in places:
                        at, back, count = place >> 16, place >> 8 & 255, place & 255
                        out += [(lead, c1, c2, at - back + start, *rest) for lead, start, *rest in units(text[at - back : at - back + count + LENGTH], back, count, width)]
                        if len(out) >= 4000:
                            yield batch(lead_schema, *zip(*out, strict=True))
                            out = []
                if out:
                    yield batch(lead_schema, *zip(*out, strict=True))

        lists = chosen.groupBy("c1", "c2").agg(F.collect_list("place").alias("places"))  # of one text at a time
        return texts.join(lists.hint("shuffle_hash"), ["c1", "c2"]).select("c1", "c2", "text", "places").mapInArrow(cut, "lead binary, " + _SPAN)

    def classed(spans: DataFrame, width: int) -> DataFrame:
        """Each suffix's classes of `width` windows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for c1, c2, lo, back, count, span in zip(*(b.column(c).to_pylist() for c in lead_schema.names[1:]), strict=True):
                    out += [(lead, c1, c2, lo + start, *rest) for lead, start, *rest in units(span, back, count, width)]
                if out:
                    yield batch(lead_schema, *zip(*out, strict=True))

        return spans.mapInArrow(run, "lead binary, " + _SPAN)

    own = likely.where("one and spans > 1")
    ready, over = spans_of(own.where(F.col("spans") <= split), WIDTH), None
    for width in CLASSES[1:]:
        if most <= split:
            break
        parts = materialize(spans_of(own.where(F.col("spans") > split), width) if over is None else classed(over, width))
        likely, most = judged(parts.withColumns({"h": F.xxhash64("lead"), "s": F.xxhash64("back", "span"), "n": F.lit(1).cast("long")}))
        likely = materialize(likely.where("times > 1 or one"))
        told.append(likely.where("times > 1").select("c1", "c2", F.col("lo").alias("start"), (F.col("lo") + F.col("count") + LENGTH).alias("end")))
        ready = ready.unionByName(likely.where("one and spans > 1").where(F.col("spans") <= split).select(ready.columns))
        over = likely.where("one").where(F.col("spans") > split).select(*lead_schema.names[1:])
    dealt = ready.repartitionByRange(n, "lead").sortWithinPartitions("lead")
    intervals = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["lead"], AT_ONCE):
            lead = t.column("lead").to_pylist()
            new = [False] + [a != b for a, b in zip(lead[1:], lead, strict=False)]
            lo, back, count = (t.column(c).to_numpy().astype(np.int64) for c in ("lo", "back", "count"))
            found = repeated(t.column("span").to_pylist(), np.cumsum(new), back, count)
            edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            (row, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            at = lo[row] + back[row]
            yield batch(intervals, pa.array(t.column("c1").to_numpy()[row]), pa.array(t.column("c2").to_numpy()[row]), pa.array(at - last + 1), pa.array(at - first + LENGTH))

    every = dealt.mapInArrow(bucket, "c1 long, c2 long, start long, end long")
    for more in told:
        every = every.unionByName(more)
    merged = every.groupBy("c1", "c2").agg(F.collect_set(F.struct("start", "end")).alias("iv"))  # of one text at a time
    joined = texts.join(merged.hint("shuffle_hash"), ["c1", "c2"], "left")
    size = F.octet_length("text").cast("long")
    twice = (F.col("copies") > 1) & (size >= LENGTH)
    return joined.select("c1", "c2", "copies", "text", F.when(twice, F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))).otherwise(F.coalesce("iv", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("iv"))


def removed(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """A digest of each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts of fewer than LENGTH bytes, null and empty ones keep all they have; repeated rows keep a row each.
    """
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("copies", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, iv in zip(as_bytes(b.column("text")), b.column("iv").to_pylist(), strict=True):
                runs = covered(len(text), [i["start"] for i in iv], [i["end"] for i in iv])
                out.append((len(text), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept(text, runs)).hexdigest()))
            if out:
                yield batch(schema, b.column("c1"), b.column("c2"), b.column("copies"), *zip(*out, strict=True))

    by_text = repeats(docs, split).mapInArrow(run, "c1 long, c2 long, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rows = keyed(docs.select(as_long(docs, "doc_id").alias("doc_id"), as_text(docs).alias("text")), "c1", "c2").drop("text")
    # A text may be that of a third of all rows.
    return met(rows, materialize(by_text), ["c1", "c2"], "copies", ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of a text without the runs."""
    at, out = 0, []
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def cleaned(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """docs with every repeated string cut out of its text; bytes of a character that a cut leaves broken go too.

    Rows stay, repeated ones and those of an empty or null text (which becomes empty) too, as do all other columns,
    whatever their names; n_chars, if there, is counted anew. An empty table gives an empty one.
    """
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, iv in zip(as_bytes(b.column("text")), b.column("iv").to_pylist(), strict=True):
                out.append(kept(text, covered(len(text), [i["start"] for i in iv], [i["end"] for i in iv])).decode("utf-8", "ignore"))
            if out:
                yield batch(schema, b.column("c1"), b.column("c2"), out)

    c1, c2, d1, d2, left = fresh(docs, 5)
    cut = repeats(docs, split).mapInArrow(run, f"{d1} long, {d2} long, {left} string")
    joined = keyed(docs, c1, c2).join(cut, (F.col(c1) == F.col(d1)) & (F.col(c2) == F.col(d2)))
    changed = {"text": F.col(left)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(left).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(changed).select(docs.columns)
