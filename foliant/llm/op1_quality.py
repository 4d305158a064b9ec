"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown in numpy on a bounded sample of labelled rows (``TRAIN_ROWS``), flattened
into node arrays, and scored a batch of documents at a time. Chosen features are monotone: more
symbols, repeated lines or repeated words never raise a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, read, text_columns, words

#: At most so many labelled rows train the trees: those of the smallest hash of their id.
TRAIN_ROWS = 20_000
#: The share of good training rows that the cut-off may lose.
LOSS = 0.002
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features and the direction in which each may move the score: -1 never up, +1 never down, 0 free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1,
    "upper_rate": 0, "digit_rate": 0, "stop_rate": 0, "words_per_line": 0, "distinct_rate": 0,
}
#: Frequent function words of the corpus languages.
STOP = frozenset("the of and to in a is that it for was on with as by at from und der die das in den von zu mit ist auf für de la le les et des en un une que el los las y del con por".split())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts of a whole text and the features of the trees; a null text counts as empty.

    >>> statistics("a b c a b c")[0]
    [6, 6, 0, 0, 6]
    """
    text = text or ""
    w = words(text)
    n = len(w)
    chars = sum(map(len, w))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    repeat = 0
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int64, n)
    if n > 3:
        # ids are below n, so two packed words need n * n < 2**63; three are numbered again first
        _, pair = np.unique(code[:-1] * n + code[1:], return_inverse=True)
        _, which, times = np.unique(pair[:-1] * n + code[2:], return_inverse=True, return_counts=True)
        again = times[which] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeat = int(covered.sum())
    some, length = max(n, 1), max(len(text), 1)
    values = [
        np.log1p(n), chars / some, symbols / length, dup / max(len(lines), 1), repeat / some,
        sum(map(str.isupper, w)) / some, sum(map(str.isdigit, w)) / some,
        sum(x.lower() in STOP for x in w) / some, n / max(len(lines), 1), len(ids) / some,
    ]
    return [n, chars, symbols, dup, repeat], values


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass
class Trees:
    """A boosted ensemble as flat node arrays; a leaf points to itself."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: list[int] = field(default_factory=list)
    bias: float = 0.0
    depth: int = 3
    cutoff: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of being good, for all rows at once: each step moves every row one level down."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, direction: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 5.0) -> Trees:
    """Newton boosting of the log loss over binned features. With one class or no row, a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(bias=float(np.log(share / (1 - share))), depth=depth)
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    feature, threshold, left, right, value = [], [], [], [], []

    def node(v: float) -> int:
        k = len(value)
        feature.append(0)
        threshold.append(np.inf)
        left.append(k)
        right.append(k)
        value.append(v)
        return k

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        total_g, total_h = g.sum(), h.sum()
        here = float(np.clip(total_g / (total_h + smooth), low, high))
        k = node(rate * here)
        if level == depth or len(rows) < 20:
            return k
        best = (1e-6, None)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g, len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h, len(e) + 1))[:-1]
            vl = np.clip(gl / (hl + smooth), low, high)
            vr = np.clip((total_g - gl) / (total_h - hl + smooth), low, high)
            gain = gl * vl - (hl + smooth) * vl**2 / 2 + (total_g - gl) * vr - (total_h - hl + smooth) * vr**2 / 2
            gain -= total_g * here - (total_h + smooth) * here**2 / 2
            gain = np.where((hl < 0.5) | (total_h - hl < 0.5) | (direction[f] * (vr - vl) < 0), -1, gain)
            if gain.max() > best[0]:
                b = int(gain.argmax())
                best = (gain[b], (f, b, vl[b], vr[b]))
        if best[1] is None:
            return k
        f, b, vl, vr = best[1]
        mid = (vl + vr) / 2  # neither side may pass it, so that the whole subtree stays monotone
        goes = binned[rows, f] <= b
        bounds = ((low, high), (low, high)) if not direction[f] else ((low, mid), (mid, high)) if direction[f] > 0 else ((mid, high), (low, mid))
        feature[k], threshold[k] = f, edges[f][b]
        left[k] = grow(rows[goes], level + 1, *bounds[0])
        right[k] = grow(rows[~goes], level + 1, *bounds[1])
        return k

    at = np.full(len(y), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-at))
        grad, hess = y - p, p * (1 - p)
        start = len(value)
        model.roots.append(grow(np.arange(len(y)), 0, -8.0, 8.0))
        tree = Trees(*(np.array(v) for v in (feature, threshold, left, right, value)), roots=[start], depth=depth)
        at = at + tree.margin(x)
    model.feature, model.left, model.right = (np.array(v, np.int32) for v in (feature, left, right))
    model.threshold, model.value = np.array(threshold), np.array(value)
    return model


FEATURE_SCHEMA = pa.schema([("quality", pa.int32()), ("features", pa.list_(pa.float64()))])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, loss: float = LOSS) -> Trees:
    """Train on at most max_rows labelled documents (ids of the smallest hash; rows with a null id or label are left out).

    The cut-off is the score below which lie ``loss`` of the good rows, and never above one half.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(FEATURE_SCHEMA, b.column("quality"), [statistics(t.as_py())[1] for t in b.column("text")])

    # one text of every chosen id, so that the sample is bounded by max_rows whatever the corpus holds: of rows that repeat an id the least text
    rows = text_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text").mapInArrow(featured, "quality int, features array<double>").toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), len(FEATURES))
    y = (rows["quality"].to_numpy() > 0).astype(float)
    model = train(x, y, list(FEATURES.values()))
    good = model.score(x[y > 0])
    model.cutoff = float(min(0.5, np.quantile(good, loss))) if len(good) and model.roots else 0.0
    return model


OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in BASE), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])
OUT_DDL = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, model: Trees) -> DataFrame:
    """One row per document, repeated rows included: base counts, the base verdict, the trees' score and verdict.

    A null or empty text has no word and so fails the base rules; a null doc_id stays null.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [statistics(t.as_py()) for t in b.column("text")]
            if not both:
                continue
            counts = np.array([x[0] for x in both], np.int64)
            score = model.score(np.array([x[1] for x in both], float))
            failed = base_failed(counts)
            yield batch(OUT, b.column("doc_id"), *counts.T, failed, ~failed & (score >= model.cutoff), score)

    return text_columns(docs, "doc_id", "text").mapInArrow(judged, OUT_DDL)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of all documents by a model fitted to the labelled ones; a null or empty text fails the base rules, repeated rows are judged each, an empty table gives none, texts are read whole."""
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels")))
