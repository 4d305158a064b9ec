"""Language identification by averaged hashed subword embeddings and a linear softmax.

Character n-grams of one to three characters are hashed to rows of an embedding table; a text's vector is
their mean, and a linear softmax reads the language from it. Both are trained together by
stochastic gradient descent in numpy on a bounded sample (``TRAIN_ROWS``), of whole texts. A temperature and a
rejection threshold are set on training rows that the descent has not seen: the lowest threshold at which
no more than ``MAX_ERROR`` of the accepted rows are wrong.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, crc32_text, materialise, read, text_columns

#: About so many labelled rows, twice as many at most, of the smallest hash of their id, train the model: whole texts, as counts of hashed n-grams.
TRAIN_ROWS = 4_000
#: Rows that the descent visits, in as many epochs as that takes.
VISITS = 20_000
ROWS = 1 << 15
WIDTH = 16
FOLDS = 5
UNDETERMINED = "und"
#: The share of wrong rows among the accepted calibration rows that the rejection threshold lets stand.
MAX_ERROR = 0.002
#: Characters hashed at a time, which bounds the memory of a very long text.
BLOCK = 1 << 18

_A, _B = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def code_points(text: str) -> np.ndarray:
    """Code points in lower case, every run of non-letters one space, with a space at each end."""
    cp = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (cp >= 192) | ((cp >= 97) & (cp <= 122)) | (cp == 170) | (cp == 181) | (cp == 186)
    cp = np.where(letter, cp, np.uint32(32))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return cp[keep]


def buckets(cp: np.ndarray, seen: int = 0) -> np.ndarray:
    """Hashed 1- to 3-grams of a row of code points, without those that lie in its first seen (0 or 2) points alone."""
    one = cp * _A
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _B + cp[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _A + cp[2:]
    out = np.concatenate([one[seen:] + np.uint32(1), two[seen // 2 :] * _A, three * _B])
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x27D4EB2F)
    return (out >> np.uint32(17)).astype(np.int32)  # 15 bits: below ROWS


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text and how often each stands there; in blocks that overlap by two characters."""
    cp = code_points(text)
    if len(cp) <= BLOCK:
        found, times = np.unique(buckets(cp), return_counts=True)
        return found, times.astype(np.int64)
    counts = np.zeros(ROWS, np.int64)
    for at in range(0, len(cp), BLOCK):
        counts += np.bincount(buckets(cp[max(0, at - 2) : at + BLOCK], 2 if at else 0), minlength=ROWS)
    found = np.flatnonzero(counts).astype(np.int32)
    return found, counts[found]


@dataclass
class Model:
    """Languages, the per-bucket class scores (embedding times weights), and the calibration."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        """The mean is linear, so embedding and weights are one table here."""
        cp = code_points(text)
        if len(cp) <= 4096:
            b = buckets(cp)
            return self.scores[b].sum(0) / max(len(b), 1) + self.bias
        found, times = profile(text)
        return times @ self.scores[found] / times.sum() + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether the calibrated rejection turns the text away."""
        if not text or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.threshold)


def accepting(best: np.ndarray, right: np.ndarray, most: float = MAX_ERROR) -> float:
    """The lowest threshold, 0.5 at most, at which no more than that part of the rows that reach it is wrong.

    >>> accepting(np.array([0.3, 0.6, 0.9]), np.array([False, True, True]))
    0.5
    """
    order = np.argsort(-best, kind="stable")
    wrong = np.cumsum(~right[order]) > most * np.arange(1, len(best) + 1)
    if not wrong.any() or not wrong[-1]:
        return 0.0
    last = np.flatnonzero(~wrong)
    return float(min(best[order[last[-1]]] if len(last) else 0.5, 0.5))


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 7, visits: int = VISITS, size: int = 32, rate: float = 0.5) -> Model:
    """Stochastic gradient descent on the profiles of 4 of 5 rows; temperature and threshold are set on the fifth."""
    names = sorted(set(langs))
    if len(names) < 2:
        return Model(names, np.zeros((ROWS, len(names))), np.zeros(len(names)))
    rng = np.random.default_rng(seed)
    at_name = {x: k for k, x in enumerate(names)}
    target = np.array([at_name[x] for x in langs])
    rows = [(b, n / n.sum()) if len(b) else (np.zeros(1, np.int32), np.ones(1)) for b, n in rows]
    order = rng.permutation(len(rows))
    held, fit = order[::5], np.array([k for n, k in enumerate(order) if n % 5], int)
    share = np.bincount(target, minlength=len(names)) / len(target)
    table = rng.normal(0, 0.1, (ROWS, WIDTH))
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(names))), np.zeros(len(names))
    epochs = max(1, -(-visits // max(len(fit), 1)))
    for epoch in range(epochs):
        rng.shuffle(fit)
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(fit), size):
            chosen = fit[at : at + size]
            means = np.stack([n @ table[b] for b, n in (rows[k] for k in chosen)])
            z = means @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), target[chosen]] -= 1
            p /= (share[target[chosen]] * len(names))[:, None]  # every language counts alike
            back = p @ weights.T
            weights -= step * means.T @ p / size
            bias -= step * p.mean(0)
            # per row of the table, a row's gradient is scaled up since each text touches few rows; a text's buckets are distinct
            for k, g in zip(chosen, back):
                b, n = rows[k]
                table[b] -= (step * 20 / size) * n[:, None] * g
    model = Model(names, table @ weights, bias)
    z = np.array([n @ model.scores[b] + bias for b, n in (rows[k] for k in held)])
    right = target[held]

    def loss(t: float) -> float:
        p = z / t
        p = p - p.max(1, keepdims=True)
        return float((np.log(np.exp(p).sum(1)) - p[np.arange(len(p)), right]).mean())

    if len(held):
        model.temperature = float(min(np.geomspace(0.25, 5, 60), key=loss))
        p = z / model.temperature
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        model.threshold = accepting(p.max(1), p.argmax(1) == right)
    return model


def fit(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """Learn from text and lang of about max_rows rows, 2 * max_rows at most, whose crc32(doc_id) mod 5 is not 0 and whose lang is not null.

    Every language has the part of max_rows that it has of the rows; rare languages at least max_rows / 20, or, of more than 20
    languages, an equal part of max_rows, where they have them, and one in any case. Rows without a letter teach nothing. An empty table gives a model
    without languages.
    """
    able = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    u = F.expr("pmod(xxhash64(doc_id, 17), 1000000007) / 1000000007D")
    counts = able.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(u).alias("first"))
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("langs")).first()
    if not total["n"]:
        return train([], [])
    least = max_rows / max(20, total["langs"])
    rates = counts.select("lang", F.least(F.lit(1.0), F.greatest(F.lit(max_rows / total["n"]), F.lit(least) / F.col("n"))).alias("rate"), "first")

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("buckets", pa.binary()), ("times", pa.binary())])
        for b in batches:
            found = [(d, lang, *profile(t)) for d, lang, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "text"))) if has_letter(t)]
            if found:
                yield batch(schema, *zip(*((d, lang, x.tobytes(), n.astype("<u4").tobytes()) for d, lang, x, n in found)))

    # a table, whose size the optimiser knows when it plans the join: one row for each language
    rates = materialise(rates, "rates")
    chosen = text_columns(able, "doc_id", "lang", "text").join(rates, "lang").where((u < F.col("rate")) | (u == F.col("first"))).select("doc_id", "lang", "text")
    made = chosen.mapInArrow(profiled, "doc_id bigint, lang string, buckets binary, times binary")
    rows = made.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "lang", "buckets", "times").limit(2 * max_rows).collect()
    return train([(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.times, "<u4").astype(np.int64)) for r in rows], [r.lang for r in rows])


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
OUT_DDL = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs. A null or letterless text is ``und`` with score 0 and rejected; a null doc_id is held out by the text 'None'.

    Rows that repeat are predicted alike; an empty table gives no row.
    """

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            found = [model.predict(t.as_py()) for t in b.column("text")]
            if ids:
                yield batch(OUT, ids, [crc32_text(k) % FOLDS == 0 for k in ids], *zip(*found))

    return text_columns(docs, "doc_id", "text").mapInArrow(predicted, OUT_DDL)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of all documents by a model fitted to those that are not held out; null and letterless texts are 'und', repeated rows alike, an empty table gives no row, texts are read whole."""
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def kept_documents(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose language is not rejected."""
    model = fit(docs, max_rows)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not model.predict(t.as_py())[2] for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
