"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone. Trees are grown level by level on binned statistics from gradient histograms and
kept as flat arrays (statistic, threshold bin, left child, value), which numpy walks for all rows of a batch at once.

The trees are fitted on at most SAMPLE labelled rows, those with the smallest hash of their id: a documented bound on
what the driver holds. Every document is scored.

Defined results: null and empty texts have all statistics 0 and get a score like any other; a label that is null or
belongs to no document is ignored; of labels of one id that disagree the larger counts; without any usable label every
score is PRIOR; rows repeat as they come (a document that repeats its id is learnt once for each row); other columns of
both tables, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, lean_batches

#: Labelled rows that the fit may hold.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, L2, LEAST = 64, 80, 4, 0.15, 1.0, 10
PRIOR = 0.5
THRESHOLD = 0.3
#: Remainder classes of crc32(doc_id as text); class 0 is held out.
FOLDS = 5

STATISTICS = (
    "n_bytes", "n_words", "mean_word", "distinct_words", "n_lines", "distinct_lines", "mean_line", "symbols", "bars",
    "punctuation", "exclamation", "sentence_ends", "upper", "letters", "digits", "non_ascii", "spaces", "long_words",
    "one_letter_words", "capital_words", "repeat_pairs", "top_word", "ends_with_stop", "words_a_sentence",
)

_LOWER, _UPPER, _DIGIT = (bytes(range(*x)) for x in ((97, 123), (65, 91), (48, 58)))
_ASCII = bytes(range(128))
_CAPITAL = re.compile(rb"(?:^|[ \n])[A-Z]")


def statistics(text: str) -> list[float]:
    raw = text.encode()
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [float(size)] + [0.0] * (len(STATISTICS) - 1)
    without = lambda chars: size - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper, ends = without(_UPPER), without(b".?!")
    return [
        size, n, lengths.sum() / n, len(tally) / n, len(lines), len(set(lines)) / len(lines), size / len(lines), without(b"#*$%&<>") / n, without(b"|") / n,
        without(b",;:()-") / n, without(b"!") / n, ends / n, upper / size, (upper + without(_LOWER)) / size, without(_DIGIT) / size, (size - without(_ASCII)) / size, 1 - lengths.sum() / size, (lengths > 12).mean(),
        (lengths == 1).mean(), len(_CAPITAL.findall(raw)) / n, 1 - len(set(zip(words, words[1:]))) / max(1, n - 1), max(tally.values()) / n, float(raw.rstrip()[-1:] in b".?!"), n / (ends + 1),
    ]


@dataclass
class Trees:
    """Flat arrays over all nodes of all trees; a node with left -1 is a leaf; right is left + 1."""

    edges: list[np.ndarray]
    start: float
    roots: list[int] = field(default_factory=list)
    statistic: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    bin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int32)
        for k, e in enumerate(self.edges):
            out[:, k] = np.searchsorted(e, x[:, k], side="left")
        return out

    def raw(self, b: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(b), self.start), np.arange(len(b))
        for root in self.roots:
            at = np.full(len(b), root)
            for _ in range(DEPTH):
                left = self.left[at]
                at = np.where(left < 0, at, left + (b[rows, self.statistic[at]] > self.bin[at]))
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.binned(x))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, second-order leaf values. Rows of one class alone give that class's smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2) if len(y) else PRIOR
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    out = Trees(edges, float(np.log(rate / (1 - rate))))
    if len(y) == 0 or y.min() == y.max():
        return out
    b, nf = out.binned(x), x.shape[1]
    flat = b + np.arange(nf, dtype=np.int32) * BINS
    statistic, cut, left, value = [], [], [], []
    f = np.full(len(y), out.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        out.roots.append(len(value))
        new = lambda: [a.append(v) for a, v in ((statistic, 0), (cut, 0), (left, -1), (value, 0.0))]
        new()
        level = {len(value) - 1: np.arange(len(y))}
        for depth in range(DEPTH + 1):
            below = {}
            for node, rows in level.items():
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = RATE * gs / (hs + L2)
                if depth == DEPTH or len(rows) < 2 * LEAST:
                    continue
                at = flat[rows].ravel()
                sums = [np.bincount(at, np.repeat(w, nf), nf * BINS).reshape(nf, BINS).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = sums
                gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
                gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = -1
                k, c = divmod(int(gain.argmax()), BINS)
                if gain[k, c] <= 1e-9:
                    continue
                statistic[node], cut[node], left[node] = k, c, len(value)
                goes = b[rows, k] > c
                for part in (rows[~goes], rows[goes]):
                    new()
                    below[len(value) - 1] = part
            level = below
        out.statistic, out.bin, out.left, out.value = np.array(statistic, np.int32), np.array(cut, np.int32), np.array(left, np.int32), np.array(value)
        root = Trees(edges, 0.0, out.roots[-1:], out.statistic, out.bin, out.left, out.value)
        f = f + root.raw(b)
    return out


def _matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fits on the `sample` labelled rows outside the held-out class that come first in the order of a hash of their id."""
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    chosen = ids.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` pairs of numbers: small enough to send to every executor.
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("y", "text").mapInArrow(lean_batches(_described), "y int, x array<double>")
    got = rows.toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)
    return fit(x[order], y[order])


def _scored(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Trees) -> DataFrame:
    rows = id_and_text(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(lean_batches(_scored(model)), "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    return score(docs, train(docs, labels))
