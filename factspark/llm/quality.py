"""Quality scores by Bradley-Terry pairwise ranking.

Each document has features of its text alone.  From labelled rows, pairs of a
document labelled 1 and one labelled 0 are preferences; weights come from
minimising the logistic loss of the feature differences.  The raw score is
then carried to 0..1 by a logistic curve through a chosen quantile: scores of
at least 0.3 are those above the raw score that splits the labelled rows best.

Bounded sample: at most ``SAMPLE`` labelled rows (those with the smallest hash
of their doc_id) reach the driver, as feature vectors; every document is
scored.  Null text counts as empty; empty texts have scores too.  Without both
kinds of label every score is 0.5.  A doc_id with several labels counts once
for each.  Extra columns are ignored by ``score_quality``, and kept by
``keep_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_batches, small_batches, text_bytes

#: Labelled rows that the fit takes at most, and preference pairs drawn from them.
SAMPLE, PAIRS = 20_000, 200_000
#: Score from which a document counts as good.
THRESHOLD = 0.3

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _SYMBOL, _WIDE, _CONTROL = range(9)


def _classes() -> np.ndarray:
    kind = np.full(256, _SYMBOL, np.uint8)
    for first, last, k in ((97, 122, _LOWER), (65, 90, _UPPER), (48, 57, _DIGIT), (0, 31, _CONTROL), (128, 255, _WIDE)):
        kind[first : last + 1] = k
    kind[[32, 9, 11, 12, 13]] = _SPACE
    kind[10] = _LINE
    kind[[ord(c) for c in ".,;:'\"()-?"]] = _STOP
    return kind


CLASSES = _classes()
N_FEATURES = 22


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES for each text of the block."""
    n, size = len(off) - 1, np.diff(off)
    out = np.zeros((n, N_FEATURES))
    kind = CLASSES[buf]
    total = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][off])
    some = np.maximum(size, 1)
    counts = [total(kind == k) for k in range(9)]
    gap = (kind == _SPACE) | (kind == _LINE)
    start = ~gap
    start[1:] &= gap[:-1]
    start[off[:-1][size > 0]] = ~gap[off[:-1][size > 0]]
    words = np.maximum(total(start), 1)
    before_gap = np.zeros(len(buf), bool)
    before_gap[:-1] = gap[1:] & ~gap[:-1]
    letters = np.maximum(counts[_LOWER] + counts[_UPPER], 1)
    twin = np.zeros(len(buf), bool)
    twin[1:] = buf[1:] == buf[:-1]
    wide_start = (buf & 0xC0) == 0xC0
    upper_wide = np.zeros(len(buf), bool)
    upper_wide[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] < 0x9F)
    first_upper = start & ((kind == _UPPER) | np.r_[upper_wide[1:], False])
    at = lambda c: total(buf == ord(c))
    columns = [
        counts[_UPPER] / letters, total(upper_wide) / np.maximum(total(wide_start), 1), counts[_DIGIT] / some, counts[_SYMBOL] / some, counts[_STOP] / some,
        counts[_CONTROL] / some, counts[_WIDE] / some, total(twin & (kind == _SYMBOL)) / words, total(before_gap & (kind == _SYMBOL)) / words, total(before_gap & (kind == _STOP)) / words,
        total(first_upper) / words, np.log1p(words), np.log1p(size / words), np.log1p(counts[_LINE]) / np.log1p(some),
        np.minimum(counts[_SYMBOL] / words, 3), at("!") / words, at("$") / words, at("&") / words, total(twin) / some, (size == 0) * 1.0, np.minimum(words, 10) / 10, _repeats(buf, off, start, gap),
    ]
    for k, column in enumerate(columns):
        out[:, k] = column
    return out


def _repeats(buf: np.ndarray, off: np.ndarray, start: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Share of the words that an earlier word of the text equals."""
    s = np.flatnonzero(start)
    e = np.flatnonzero(gap)
    doc = np.searchsorted(off, s, "right") - 1
    end = np.minimum(np.r_[e, len(buf)][np.searchsorted(e, s)], off[doc + 1])
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(buf), 0x9E3779B97F4A7C15, np.uint64)])
    prefix = np.r_[np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1])]
    word = (prefix[end] - prefix[s]) * power[len(buf) - s] if len(s) else np.zeros(0, np.uint64)
    order = np.lexsort((word, doc))
    same = np.zeros(len(s), bool)
    same[1:] = (word[order][1:] == word[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    share = np.bincount(doc[order], weights=same, minlength=len(off) - 1) if len(s) else np.zeros(len(off) - 1)
    return share / np.maximum(np.bincount(doc, minlength=len(off) - 1) if len(s) else 1, 1)


@dataclass(frozen=True)
class Ranker:
    """Standardisation, Bradley-Terry weights, and the logistic curve to 0..1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return np.clip(1 / (1 + np.exp(-np.clip(z, -40, 40))), 0, 1)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, steps: int = 300, decay: float = 1e-3) -> Ranker | None:
    """Weights from preference pairs (a row labelled 1 before a row labelled 0); None without both labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    n = min(PAIRS, len(good) * len(bad))
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the full set of pairs
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        g = -(diff * p[:, None]).mean(0) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    s, label = raw[order], y[order]
    # The quantile whose balanced error is least; ties: the middle of the widest gap.
    below_good, below_bad = np.r_[0, np.cumsum(label == 1)], np.r_[0, np.cumsum(label == 0)]
    error = below_good / len(good) + (len(bad) - below_bad) / len(bad)
    edges = np.r_[s[0] - 1, (s[1:] + s[:-1]) / 2, s[-1] + 1]
    width = np.r_[1, s[1:] - s[:-1], 1]
    width[np.r_[False, s[1:] == s[:-1], False]] = -1
    best = max(np.flatnonzero(error <= error[width >= 0].min() + 1e-12), key=lambda i: (width[i], i))
    return Ranker(mean, scale, w, float(edges[best]), float(4 / max(np.percentile(raw, 90) - np.percentile(raw, 10), 1e-6)))


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features of the text."""
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, off = text_bytes(batch.column("text"))
        for a, b in blocks(off):
            x = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), flat], names=["doc_id", "x"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, x array<double>")


def fit_ranker(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker | None:
    """Fits on at most ``sample`` rows of labels (doc_id, quality), those with the smallest hash of doc_id; the sample bounds what is broadcast."""
    chosen = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = with_features(docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")).join(chosen, "doc_id").select("doc_id", "x", "y").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = np.array(rows.column("x").to_pylist(), float)
    return fit(x, np.array(rows.column("y").to_pylist(), np.int64))


def score_quality(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """doc_id, score of each row."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch, held.value))], names=["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")


def keep_quality(docs: DataFrame, ranker: Ranker | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is at least threshold, all columns kept."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(_scores(batch, held.value) >= threshold))

    return map_batches(docs, run, docs.schema)


def _scores(batch: pa.RecordBatch, ranker: Ranker | None) -> np.ndarray:
    if ranker is None:
        return np.full(batch.num_rows, 0.5)
    buf, off = text_bytes(batch.column("text"))
    return np.concatenate([ranker.score(features(buf[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in blocks(off)])
