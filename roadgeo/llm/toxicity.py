"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, shard by shard, in rounds that Spark averages."""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, as_long, as_text, batch, fresh, limit_batches
from .labelled import HELD_OUT, every, fold, sample

#: About so many labelled rows are a shard, which one task trains on in a round; what shards report is whole multiples of 1 / FIXED, logits are counted in bins of 1 / BINS, up to MOST_LOGIT.
SHARD_ROWS, FIXED, BINS, MOST_LOGIT = 4096, 1 << 20, 256, 64
#: Of a fit in the driver alone, which callers may ask for: most labelled rows, half of each class, most words and letters (LETTERS a word) of one of them.
TRAIN_ROWS, TRAIN_WORDS, LETTERS = 6000, 30_000, 6
#: Buckets of each of a word's hashes (two of the word, one of its first PREFIX letters), dimensions, widths of the filters, filters of each width.
PREFIX, BITS = 4, 18
BUCKETS, DIM, WIDTHS, FILTERS = 1 << BITS, 8, (1, 2, 3), 8
EPOCHS, DOCS_A_STEP, RATE = 5, 32, 0.1
#: Bytes of texts of one step (one text at least).
STEP_BYTES = 1 << 21
#: Standard errors by which a word's odds must stand out at the outset.
SURE = 2.0
#: Words whose packed numbers are kept; beyond, the store starts anew.
KEPT_WORDS = 400_000
#: Bytes of text scored at once (one text at least).
AT_ONCE = 1 << 18
#: Frequent words that tell the language of a text; the language is read off the text, never off a column.
LANGUAGES = {"en": "the of and to that was with", "de": "der die und das ist nicht mit", "fr": "le les et des est dans pour", "es": "el los las del por una con"}
_LANGUAGE = {w.encode(): k + 1 for k, words in enumerate(LANGUAGES.values()) for w in words.split()}
_EDGES = " \t\n.,;:!?\"'()[]{}<>*#%$&|-_"


class Words(dict):
    """Raw word to its three buckets and language, packed BITS by BITS with the language on top; bounded in size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        letters = word.decode("utf-8", "replace").lower().strip(_EDGES)
        plain = letters.encode() or word
        hashes = (zlib.crc32(plain), zlib.crc32(plain, 77), zlib.crc32(letters[:PREFIX].encode(), 99))
        self[word] = packed = _LANGUAGE.get(plain, 0) << 3 * BITS | sum(h % BUCKETS << k * BITS for k, h in enumerate(hashes))
        return packed


def coded(texts: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed words of all texts in a row, each text followed by padding (-1), with the texts' starts and ends (one place at least)."""
    parts, starts, ends, at = [], [], [], 0
    pad = np.full(max(WIDTHS), -1, np.int64)
    for t in texts:
        ids = np.fromiter(map(words.__getitem__, t.split()), np.int64)
        parts += [ids, pad]
        starts.append(at)
        ends.append(at + max(1, len(ids)))
        at += len(ids) + len(pad)
    return np.concatenate([*parts, pad]), np.array(starts), np.array(ends)


def held(texts: list[bytes], y: np.ndarray, words: Words) -> np.ndarray:
    """Of each label the number of texts that hold a word of each bucket."""
    out = np.zeros((2, BUCKETS), np.int64)
    for t, c in zip(texts, y, strict=True):
        packed, _, _ = coded([t], words)
        out[int(c), np.unique(packed[packed >= 0] & (BUCKETS - 1))] += 1
    return out


class Net:
    """Embedding rows, one weight matrix for each place of each filter, and a logistic layer on the maxima."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = [rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32) for _ in range(3)]
        self.filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = 0.0
        self.cuts = np.zeros(len(LANGUAGES) + 1)

    def prime(self, texts: list[bytes], y: np.ndarray, words: Words) -> None:
        """Begin from the words of these texts."""
        self.primed(held(texts, y, words), np.array([len(y) - y.sum(), y.sum()]))

    def primed(self, held: np.ndarray, n: np.ndarray) -> None:
        """Begin one dimension of words, and one filter over it, from how much more texts of label 1 than of label 0 hold a word.

        held counts, for each label, the texts that hold a word of a bucket; n all texts. That is the log of the ratio of both shares, less SURE standard errors of it, where this is above 0: a word must stand in
        several texts to count. So few labels are enough to rank by what they say for certain; training goes on from there.
        """
        some = np.flatnonzero(held[1])
        c0, c1 = held[0, some] + 1, held[1, some] + 1
        odds = np.log(c1 / (n[1] + 2)) - np.log(c0 / (n[0] + 2)) - SURE * np.sqrt(1 / c0 + 1 / c1)
        for table in self.embed:
            table[:, 0] = 0
        self.embed[0][some, 0] = np.maximum(odds, 0)
        self.filters[0][0, 0, 0] = 1.0
        self.out[0] = 1.0

    def embedded(self, packed: np.ndarray) -> np.ndarray:
        x = sum(e[packed >> k * BITS & (BUCKETS - 1)] for k, e in enumerate(self.embed))
        x[packed < 0] = 0
        return x

    def maps(self, x: np.ndarray) -> list[np.ndarray]:
        """Each width's filter values at every place where a window starts."""
        out = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            n = len(x) - w + 1
            v = x[:n] @ f[0]
            for j in range(1, w):
                v += x[j : j + n] @ f[j]
            out.append(v)
        return out

    def logits(self, packed: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at = np.stack([starts, ends], axis=1).ravel()
        top = [np.maximum.reduceat(v, at, axis=0)[::2] for v in self.maps(self.embedded(packed))]
        return np.maximum(np.concatenate(top, axis=1) + np.concatenate(self.bias), 0) @ self.out + self.base

    def languages(self, packed: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The language whose frequent words are the most in each text; 0 if it has none of them."""
        at = np.stack([starts, ends], axis=1).ravel()
        counts = np.stack([np.add.reduceat((packed >> 3 * BITS == k).astype(np.int64), at)[::2] for k in range(1, len(LANGUAGES) + 1)])
        return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0) + 1, 0)

    def score(self, texts: list[bytes], words: Words) -> np.ndarray:
        """0 to 1, higher if label 1 is likelier; 0.5 lies at the threshold calibrated for the text's language."""
        if not texts:
            return np.zeros(0)
        coding = coded(texts, words)
        z = self.logits(*coding) - self.cuts[self.languages(*coding)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def step(self, packed: np.ndarray, starts: np.ndarray, ends: np.ndarray, y: np.ndarray, memory: dict) -> None:
        """One Adagrad step; the gradient goes only to the words at each filter's maximum."""
        maps, ids = self.maps(self.embedded(packed)), np.arange(len(starts))
        peaks = [np.array([s + v[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)]) for v in maps]
        pre = np.concatenate([v[p, np.arange(FILTERS)] for v, p in zip(maps, peaks, strict=True)], axis=1) + np.concatenate(self.bias)
        act = np.maximum(pre, 0)
        err = (1 / (1 + np.exp(-np.clip(act @ self.out + self.base, -30, 30))) - y) / len(ids)
        back = err[:, None] * self.out * (pre > 0)
        self._move("out", self.out, act.T @ err + 1e-4 * self.out, memory)
        self.base -= RATE * float(err.sum())
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            self._move(f"bias{k}", self.bias[k], g.sum(axis=0), memory)
            grad = np.zeros_like(f)
            for j in range(w):
                word = packed[peaks[k] + j]
                x = self.embedded(word.ravel()).reshape(*word.shape, DIM)
                grad[j] = np.einsum("bf,bfd->df", g, x)
                down = (g[:, :, None] * f[j].T[None]).reshape(-1, DIM)
                flat = word.ravel()
                use = (flat >= 0) & (np.abs(down).sum(axis=1) > 0)
                for h in range(len(self.embed)):
                    u, inv = np.unique(flat[use] >> h * BITS & (BUCKETS - 1), return_inverse=True)
                    total = np.zeros((len(u), DIM), np.float32)
                    np.add.at(total, inv, down[use])
                    m = memory.setdefault(f"embed{h}", np.full((BUCKETS, 1), 1e-4, np.float32))
                    m[u] += (total**2).mean(axis=1, keepdims=True)
                    self.embed[h][u] -= RATE * total / np.sqrt(m[u])
            self._move(f"filter{k}", f, grad + 1e-4 * f, memory)

    @staticmethod
    def _move(name: str, value: np.ndarray, grad: np.ndarray, memory: dict) -> None:
        m = memory.setdefault(name, np.full_like(value, 1e-4))
        m += grad**2
        value -= RATE * grad / np.sqrt(m)


def fit(texts: list[bytes], y: np.ndarray, seed: int = 5, odds: float = 1.0) -> Net:
    """Train on four fifths, calibrate each language's threshold on the rest and on what was trained on.

    The threshold of a language lies halfway in the widest stretch of logits that makes the fewest errors, an error on
    label 0 counting `odds` times, as label 0 is rarer among y than elsewhere; a language without both classes has that of
    all. With labels of one class alone every score is near that class (logit 4 or -4), and without any labels nothing is
    known to be of class 1 and every score is near 0, so that an unlabelled corpus is kept whole.
    """
    net, words, rng = Net(seed), Words(), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.base = 4.0 if len(y) and y[0] else -4.0
        return net
    own, rest, memory = np.arange(len(y)) % 5 != 4, np.arange(len(y)) % 5 == 4, {}
    if 0 < y[own].sum() < own.sum():
        net.prime([t for t, k in zip(texts, own, strict=True) if k], y[own], words)
    for _ in range(EPOCHS):
        order = rng.permutation(np.nonzero(own)[0])
        for i in range(0, len(order), DOCS_A_STEP):
            k = order[i : i + DOCS_A_STEP]
            net.step(*coded([texts[j] for j in k], words), y[k], memory)
    z, lang = np.empty(len(y)), np.empty(len(y), int)
    for i in range(0, len(y), 200):
        coding = coded(texts[i : i + 200], words)
        z[i : i + 200], lang[i : i + 200] = net.logits(*coding), net.languages(*coding)
    everywhere = _cut(z[rest], y[rest], odds) if y[rest].sum() >= 10 and (1 - y[rest]).sum() >= 10 else _cut(z, y, odds)
    net.cuts[:] = everywhere
    for k in range(len(net.cuts)):
        of = rest & (lang == k)
        if y[of].sum() >= 10 and (1 - y[of]).sum() >= 10:
            net.cuts[k] = _cut(z[of], y[of], odds)
    return net


def _cut(z: np.ndarray, y: np.ndarray, odds: float) -> float:
    order = np.argsort(z, kind="stable")
    return _cut_counted(z[order], y[order], 1 - y[order], odds)


def _cut_counted(z: np.ndarray, ones: np.ndarray, zeros: np.ndarray, odds: float = 1.0) -> float:
    """The threshold from rising logits and how many rows of either label each stands for."""
    errors = np.concatenate(([0], np.cumsum(ones))) + odds * np.concatenate((np.cumsum(zeros[::-1])[::-1], [0]))
    ends = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    gaps = np.diff(ends)
    best = np.nonzero(errors == errors.min())[0]
    k = best[gaps[best].argmax()]
    return float((ends[k] + ends[k + 1]) / 2)


class Trained:
    """A net in training with Adagrad's memory, as numbered tables of DIM + 1 columns: one of each hash's buckets, one of all else."""

    def __init__(self, net: Net):
        self.net = net
        self.memory = {f"embed{h}": np.full((BUCKETS, 1), 1e-4, np.float32) for h in range(len(net.embed))}
        for name, value in self._dense():
            self.memory[name] = np.full_like(value, 1e-4)

    def _dense(self) -> list[tuple[str, np.ndarray]]:
        net = self.net
        return [("out", net.out), *[(f"bias{k}", v) for k, v in enumerate(net.bias)], *[(f"filter{k}", v) for k, v in enumerate(net.filters)]]

    def tables(self) -> list[np.ndarray]:
        flat = np.concatenate([*[a.ravel() for name, v in self._dense() for a in (v, self.memory[name])], [self.net.base]]).astype(np.float32)
        rest = np.pad(flat, (0, -len(flat) % (DIM + 1))).reshape(-1, DIM + 1)
        return [*[np.concatenate([e, self.memory[f"embed{h}"]], axis=1) for h, e in enumerate(self.net.embed)], rest]

    def put(self, tables: list[np.ndarray]) -> None:
        for h, e in enumerate(self.net.embed):
            e[:], self.memory[f"embed{h}"][:] = tables[h][:, :DIM], tables[h][:, DIM:]
        flat, at = tables[-1].ravel(), 0
        for name, v in self._dense():
            for a in (v, self.memory[name]):
                a[...] = flat[at : at + a.size].reshape(a.shape)
                at += a.size
        self.net.base = float(flat[at])


_MOVED = pa.schema([("part", pa.int32()), ("row", pa.int32()), *[(f"d{k}", pa.int32()) for k in range(DIM + 1)]])
_HELD = pa.schema([("bucket", pa.int32()), ("zeros", pa.int64()), ("ones", pa.int64())])
_LOGITS = pa.schema([("language", pa.int32()), ("bin", pa.int32()), ("zeros", pa.int64()), ("ones", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'int' if f.type == pa.int32() else 'long'}" for f in schema)


def _counted(known: DataFrame) -> np.ndarray:
    """held() over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = Words(), np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            out += held(as_bytes(b.column(0)), b.column(1).to_numpy(), words)
        some = np.flatnonzero(out.any(axis=0))
        yield batch(_HELD, some.astype(np.int32), out[0, some], out[1, some])

    got = known.select("text", "y").mapInArrow(run, _ddl(_HELD)).groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    out = np.zeros((2, BUCKETS))
    for k, name in enumerate(("zeros", "ones")):
        out[k, got["bucket"].to_numpy()] = got[name].to_numpy()
    return out


def _round(known: DataFrame, state: Trained, number: int) -> None:
    """One pass over all rows that are trained on: each shard goes on from the same net; what shards moved is averaged over those that moved it.

    Moves are whole numbers, so their sums are the same in whatever order they come. What reaches the driver is a net, whatever the input.
    """
    told = known.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rng, own, begun = Words(), np.random.default_rng(number), None, []
        for b in batches:
            own = own or copy.deepcopy(told.value)
            begun = begun or own.tables()
            texts, y = as_bytes(b.column(0)), b.column(1).to_numpy()
            for k in steps(texts, rng.permutation(len(texts))):
                own.net.step(*coded([texts[j] for j in k], words), y[k].astype(float), own.memory)
        for part, (a, z) in enumerate(zip(begun, own.tables() if own else [], strict=True)):
            rows = np.arange(len(a)) if part == len(begun) - 1 else np.flatnonzero(a[:, DIM] != z[:, DIM])
            moved = np.clip(np.rint((z[rows].astype(float) - a[rows]) * FIXED), -(2**31), 2**31 - 1).astype(np.int32)
            for i in range(0, len(rows), 1 << 16):
                yield batch(_MOVED, np.full(len(rows[i : i + (1 << 16)]), part, np.int32), rows[i : i + (1 << 16)].astype(np.int32), *moved[i : i + (1 << 16)].T.copy())

    mean = [(F.sum(f"d{k}") / F.count("*") / FIXED).cast("float").alias(f"d{k}") for k in range(DIM + 1)]
    got = known.select("text", "y").mapInArrow(run, _ddl(_MOVED)).groupBy("part", "row").agg(*mean).toArrow()
    told.destroy()
    tables, part, row = state.tables(), got["part"].to_numpy(), got["row"].to_numpy()
    move = np.stack([got[f"d{k}"].to_numpy() for k in range(DIM + 1)], axis=1) if len(part) else np.zeros((0, DIM + 1), np.float32)
    for k, t in enumerate(tables):
        t[row[part == k]] += move[part == k]
    state.put(tables)


def steps(texts: list[bytes], order: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the texts of each step: DOCS_A_STEP of them, fewer where they are long."""
    at, size = 0, 0
    for i, k in enumerate(order):
        if i > at and (i - at >= DOCS_A_STEP or size + len(texts[k]) > STEP_BYTES):
            yield order[at:i]
            at, size = i, 0
        size += len(texts[k])
    if at < len(order):
        yield order[at:]


def _logits(known: DataFrame, net: Net) -> pa.Table:
    """How many rows of either label have a language and a logit, in bins."""
    told = known.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), {}
        for b in batches:
            texts, y = as_bytes(b.column(0)), b.column(1).to_numpy()
            for k in steps(texts, np.arange(len(texts))):
                coding = coded([texts[j] for j in k], words)
                z = np.clip(np.floor(told.value.logits(*coding) * BINS), -MOST_LOGIT * BINS, MOST_LOGIT * BINS).astype(int)
                for at in zip(told.value.languages(*coding).tolist(), z.tolist(), y[k].tolist(), strict=True):
                    counts[at] = counts.get(at, 0) + 1
        keys = sorted({k[:2] for k in counts})
        yield batch(_LOGITS, [k[0] for k in keys], [k[1] for k in keys], [counts.get((*k, 0), 0) for k in keys], [counts.get((*k, 1), 0) for k in keys])

    got = known.select("text", "y").mapInArrow(run, _ddl(_LOGITS)).groupBy("language", "bin").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).orderBy("bin", "language").toArrow()
    told.destroy()
    return got


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, most_words: int = TRAIN_WORDS, most_bytes: int | None = None, shard_rows: int = SHARD_ROWS) -> Net:
    """Fit on all labelled documents outside the held-out fold, whole texts, as `fit` does: four fifths are trained on, one is for the thresholds.

    Rows lie in shards; counts of words, EPOCHS passes and counts of logits each are one pass of tasks over the shards, and
    only counts and nets, which have a fixed size, reach the driver. With most_bytes the net is fitted in the driver on a
    sample of so many bytes instead.
    """
    if most_bytes is not None:
        return _train_here(docs, labels, label, rows, most_words, most_bytes)
    limit_batches(docs.sparkSession)
    known = every(docs, labels, label, shard_rows)
    n = np.zeros((2, 2))
    for rest, y, many in known.groupBy("rest", "y").count().collect():
        n[int(rest), y] = many
    if not n.sum(axis=0).all():
        return fit([b""] * int(n.any()), np.array([1.0 if n[:, 1].any() else 0.0] * int(n.any())))
    state, own, rest = Trained(Net()), known.where("not rest"), known.where("rest")
    if n[0].all():
        state.net.primed(_counted(own), n[0])
    for k in range(EPOCHS):
        _round(own, state, k)
    net = state.net
    got = _logits(rest, net)
    language, z, zeros, ones = (got[c].to_numpy() for c in ("language", "bin", "zeros", "ones"))
    cut = lambda of, z, ones, zeros: _cut_counted((z[of] + 0.5) / BINS, ones[of], zeros[of])
    if min(zeros.sum(), ones.sum()) >= 10:
        net.cuts[:] = cut(slice(None), *_by_bin(z, ones, zeros))
    else:
        whole = _logits(known, net)
        net.cuts[:] = cut(slice(None), *_by_bin(*(whole[c].to_numpy() for c in ("bin", "ones", "zeros"))))
    for k in range(len(net.cuts)):
        of = language == k
        if min(zeros[of].sum(), ones[of].sum()) >= 10:
            net.cuts[k] = cut(of, z, ones, zeros)
    return net


def _by_bin(z: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    bins, at = np.unique(z, return_inverse=True)
    return bins, *(np.bincount(at, c, len(bins)) for c in counts)


def _train_here(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_words: int, most_bytes: int) -> Net:
    """Fit on `rows` labelled documents at most, of `most_words` words and LETTERS letters a word at most, outside the held-out fold, and of `most_bytes` bytes in all.

    These bounds hold what reaches the driver: sizes first, then the texts that fit, half of the bytes for each class, in the
    order of a hash of their ids. Drawn documents are used whole. The classes' odds, too, are counted outside the held-out fold alone.
    """
    short = docs.where(F.length(as_text(docs)) <= LETTERS * most_words)
    drawn = sample(short, labels, label, rows, by_class=True)
    left, fit_in = {0: most_bytes // 2, 1: most_bytes // 2}, []
    for i, y, size in sorted(map(tuple, drawn.select("id", "y", F.octet_length("text")).collect()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0])):
        if size <= left[y]:
            left[y] -= size
            fit_in.append(i)
    got = sorted((r.id, r.text.encode(), r.y) for r in drawn.where(F.col("id").isin(fit_in)).toLocalIterator() if r.text.count(" ") < most_words)
    rng = np.random.default_rng(3).permutation(len(got))
    y = np.array([got[i][2] for i in rng], float)
    known = labels.where("doc_id is not null").where(fold(F.col("doc_id").cast("long")) != HELD_OUT)
    zeros, ones = known.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    odds = zeros / ones * y.sum() / (1 - y).sum() if ones and 0 < y.sum() < len(y) else 1.0
    return fit([got[i][1] for i in rng], y, odds=max(1.0, float(odds)))


def scores(net: Net, texts: list[bytes], words: Words) -> np.ndarray:
    """Score of each text, a few MB of text at a time."""
    out, i = [np.zeros(0)], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < AT_ONCE):
            size += len(texts[j])
            j += 1
        out.append(net.score(texts[i:j], words))
        i = j
    return np.concatenate(out)


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and score of each row of docs, over whole texts; the net has a fixed size and is broadcast."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            yield batch(schema, b.column(0), scores(model.value, as_bytes(b.column(1)), words))

    limit_batches(docs.sparkSession)
    return docs.select(as_long(docs, "doc_id").alias("doc_id"), as_text(docs).alias("text")).mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, net: Net, cut: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the cut, with all their columns, in one pass without a join.

    Repeated rows are kept or dropped alike; null and empty texts have the score of no words; an empty table gives an
    empty one. A text of another type than string is scored as its string, and returned as it is.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)
    (as_scored,) = fresh(docs, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            keep = scores(model.value, as_bytes(b.column(at)), words) < cut
            yield b.select(list(range(at))).filter(pa.array(keep))

    at = len(docs.columns)
    limit_batches(docs.sparkSession)
    if "text" in docs.columns and docs.schema["text"].dataType.typeName() == "string":
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # no second copy of the texts
            words = Words()
            for b in batches:
                yield b.filter(pa.array(scores(model.value, as_bytes(b.column(at)), words) < cut))

        return docs.mapInArrow(run, docs.schema)
    return docs.withColumn(as_scored, as_text(docs)).mapInArrow(run, docs.schema)
