"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, as_long, as_text, batch, limit_batches
from .labelled import HELD_OUT, fold, sample

#: Most labelled rows to fit on; trees, depth, bins, learning rate and L2 penalty; a score from CUT on is predicted 1.
TRAIN_ROWS, TREES, DEPTH, BINS, RATE, PENALTY, CUT = 8000, 80, 4, 64, 0.15, 1.0, 0.3
STOP_WORDS = frozenset(w.encode() for w in "the of and to in is that it for on with as was der die und das ist zu den von mit le la les et des un une que est pour el los las y en del por con se".split())
FEATURES = (
    "log_bytes", "log_words", "word_length", "long_words", "upper", "digit", "space", "not_ascii", "punctuation", "symbols", "bangs", "bars", "hashes",
    "lines", "line_words", "equal_lines", "equal_line_bytes", "distinct_words", "top_word", "distinct_pairs", "stop_words", "ended_lines", "ended_words", "upper_words", "entropy", "runs",
)


def statistics(text: bytes) -> list[float]:
    """The FEATURES of a whole UTF-8 text; those of an empty one are zeros."""
    n = len(text)
    words = text.split()
    m = len(words)
    if not m:
        return [np.log1p(n)] + [0.0] * (len(FEATURES) - 1)
    raw = np.frombuffer(text, np.uint8)
    c = np.bincount(raw, minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, m)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    again = [(k, x) for x, k in seen.items() if k > 1]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper, digit, lower = int(c[65:91].sum()), int(c[48:58].sum()), int(c[97:123].sum())
    p = c[c > 0] / n
    return [
        np.log1p(n), np.log1p(m), float(lengths.mean()), float((lengths > 20).mean()), upper / max(1, upper + lower), digit / n, int(c[9:14].sum() + c[32]) / n, int(c[128:].sum()) / n,
        int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()) / n, int(c[[35, 36, 37, 38, 42, 60, 61, 62, 64, 92, 94, 95, 123, 125, 126]].sum()) / m, int(c[33]) / m, int(c[124]) / m, int(c[35]) / m,
        np.log1p(len(lines)), m / len(lines), sum(k for k, _ in again) / len(lines), sum(k * len(x) for k, x in again) / n, len(counts) / m, max(counts.values()) / m,
        len(set(zip(words, words[1:], strict=False))) / max(1, m - 1), sum(counts.get(w, 0) for w in STOP_WORDS) / m, sum(x[-1] in b".!?:\"" for x in lines) / len(lines), sum(w[-1] in b".!?" for w in words) / m,
        sum(k for w, k in counts.items() if w.isupper() and len(w) > 1) / m, float(-(p * np.log2(p)).sum()), float((raw[1:] == raw[:-1]).mean()) if n > 1 else 0.0,
    ]


class Forest:
    """Gradient-boosted complete trees of one depth in flat arrays: per tree its inner nodes' feature and threshold, and its leaves."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: all trees step down a level at once."""
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(int(np.log2(self.feature.shape[1] + 1))):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return 1 / (1 + np.exp(-(self.base + self.leaf[trees, at - self.feature.shape[1]].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, penalty: float = PENALTY) -> Forest:
    """Newton boosting of the logistic loss; splits are sought in histograms of gradients over quantile bins.

    Without rows every score is 0.5; with rows of one class only, near that class.
    """
    inner = 2**depth - 1
    n, f = x.shape
    if not n:
        return Forest(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)), 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate_1 = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate_1 / (1 - rate_1)))
    total, out = np.full(n, base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = (((at - first)[:, None] * f + np.arange(f)) * bins + code).ravel()
            hist = [np.bincount(key, np.repeat(v, f), width * f * bins).reshape(width, f, bins).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (gt, ht) = hist, [v[:, :, -1:] for v in hist]
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(hl < 1) | (ht - hl < 1)] = 0.0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in np.nonzero(gain.reshape(width, -1)[np.arange(width), best] > 1e-6)[0]:
                j, b = divmod(int(best[k]), bins)
                if b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        total = total + value[leaf]
        for o, v in zip(out, (feature, threshold, value), strict=True):
            o.append(v)
    return Forest(*(np.stack(o) for o in out), base)


_STATS = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64())), ("y", pa.int32())])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Fit on the statistics of `rows` labelled documents at most, outside the held-out fold; only these numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(_STATS, b.column(0), [statistics(t) for t in as_bytes(b.column(1))], b.column(2))

    limit_batches(docs.sparkSession)
    got = sorted(sample(docs, labels, label, rows, by_class=False).mapInArrow(run, "id long, x array<double>, y int").collect())
    return fit(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got], float))


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score of each row of docs, empty and null texts too; the forest is a few hundred kB, whatever the input."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in as_bytes(b.column(1))]).reshape(-1, len(FEATURES))
            yield batch(schema, b.column(0), forest.score(x))

    limit_batches(docs.sparkSession)
    return docs.select(as_long(docs, "doc_id").alias("doc_id"), as_text(docs).alias("text")).mapInArrow(run, "doc_id long, score double")


def digest(found: DataFrame, cut: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return found.select("doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(-1)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
