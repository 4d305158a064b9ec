"""A count model of words with contexts of two and more: discounted counts, interpolated with continuation counts of shorter contexts.

The longest grams are counted; a shorter one counts by how many different words stand before it. A gram's probability takes
DISCOUNT from every count and gives it to the next shorter context, down to single words and at last to all words alike. All counts and
contexts of a position but for the single word's hold the word before it, so positions are shuffled once, by that word, and no gram is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.shared import released
from ..sources.tables import documents
from . import packed
from .packed import Coded, coded

ORDER, DISCOUNT = 3, 0.75
#: What stands before a text's first token.
START = "<s>"
#: Of ten documents by id, the one that the model does not learn from.
HELD_OUT = 10
#: Positions that a bucket should hold: MOST at most, and LEAST though there be fewer for a core.
MOST, LEAST = 1 << 20, 1 << 16
#: Tasks of a core that go through the buckets.
TASKS = 4
#: What blocks hold: words up to every position, counts of grams, counts of single words.
WORDS, COUNTS, SINGLE = 0, 1, 2
COSTS = pa.schema([("doc_id", pa.int64()), ("cost", pa.float64()), ("n", pa.int64())])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(doc_id, F.lit(HELD_OUT)) == 0, F.lit(False))


@dataclass
class Buckets:
    """Where a gram is dealt to: by the word before its last, so that all counts and contexts of a position meet.

    Words that stand more often than a bucket should hold have buckets of their own, by the word before them; the words that follow them are counted before.
    """

    n: int
    often: np.ndarray
    parts: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, c: Coded, cores: int) -> Buckets:
        size = max(LEAST, min(MOST, c.total // (TASKS * cores)))
        n, often = max(1, -(-c.total // size)), np.flatnonzero(c.often > size)
        parts = -(-c.often[often] // size)
        return cls(n, often, parts, n + np.cumsum(parts) - parts)

    def split(self, words: np.ndarray) -> np.ndarray:
        """The place of each word among those that have buckets of their own, or -1."""
        if not len(self.often):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.often, words), len(self.often) - 1)
        return np.where(self.often[at] == words, at, -1)

    def place(self, word: np.ndarray, other: np.ndarray) -> np.ndarray:
        at = self.split(word)
        return np.where(at < 0, packed.mixed(word) % self.n, self.first[at] + packed.mixed(other) % self.parts[at] if len(self.often) else 0)


def _learned(ids: np.ndarray) -> np.ndarray:
    return (ids == packed.NO_ID) | (ids % HELD_OUT != 0)


def _counted(c: Coded, k: int, order: int, buckets: Buckets) -> DataFrame:
    """Blocks of the grams that the model learns from: those of k words with their counts where k is the order, otherwise each of k + 1 words once a lot.

    For k = 1 they are dealt by their last word; for k = 2 those alone are taken whose word before the last has buckets of its own.
    """


    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in packed.grams(batches, min(k + 1, order)):
            words, n = packed.counted(words[:, _learned(ids) & (buckets.split(words[-2]) >= 0 if k == 2 else True)])
            yield packed.blocks(COUNTS, packed.mixed(words[-1]) % buckets.n if k == 1 else buckets.place(words[-2], words[-1]), n, words)

    return c.rows.mapInArrow(of, packed.BLOCK_DDL)


def _sums(rows: pa.Table, k: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of k words in blocks of _counted(), and their counts."""
    n, words = packed.opened(rows.to_pylist(), min(k + 1, order))
    own = words[-k:]
    order_of = np.lexsort(own[::-1]) if k == order else packed.distinct(*own, *words[:-k])[0]
    own, n = own[:, order_of], n[order_of] if k == order else np.ones(len(order_of), np.int64)
    cut = packed.starts(*own)
    return own[:, cut], np.add.reduceat(n, cut)


def _single(c: Coded, order: int, buckets: Buckets) -> DataFrame:
    """(word, c): by how many different words each is preceded."""

    def of(rows: pa.Table) -> pa.Table:
        words, n = _sums(rows, 1, order)
        return pa.table([pa.array(words[0].astype(np.int64)), pa.array(n)], names=["word", "c"])

    return released(_counted(c, 1, order, buckets).groupBy("bucket").applyInArrow(of, "word bigint, c bigint"), "counts")


def _followers(c: Coded, order: int, buckets: Buckets) -> DataFrame:
    """For every bucket of a frequent word the words that follow it and their counts, as blocks."""

    def of(rows: pa.Table) -> pa.Table:
        words, n = _sums(rows, 2, order)
        at = buckets.split(words[0, :1])[0]
        block = packed.blocks(COUNTS, np.full(len(n), buckets.first[at]), n, words[1:]).to_pylist()
        return pa.Table.from_pylist([r | {"bucket": r["bucket"] + part} for r in block for part in range(buckets.parts[at])], schema=packed.BLOCK)

    return _counted(c, 2, order, buckets).groupBy("bucket").applyInArrow(of, packed.BLOCK_DDL)


def _asked(c: Coded, order: int, buckets: Buckets, single: DataFrame) -> DataFrame:
    """For every bucket the counts of its words that have no number, as blocks."""

    width = max(order, 2)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in packed.grams(batches, width):
            words = words[:, words[-1] >= packed.HASH]
            bucket = buckets.place(words[-2], words[-min(3, width)])
            first = packed.distinct(bucket, words[-1])[0]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(words[-1, first].astype(np.int64))], names=["bucket", "word"])

    def held(rows: pa.Table) -> pa.Table:
        word, n, bucket = (rows[x].to_numpy() for x in ("word", "c", "bucket"))
        return pa.Table.from_batches([packed.blocks(SINGLE, bucket, n, word.astype(np.uint64)[None, :])])

    found = c.rows.mapInArrow(of, "bucket int, word bigint").join(single, "word")
    return found.select("bucket", "word", "c").groupBy("bucket").applyInArrow(held, packed.BLOCK_DDL)


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked key, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(asked))
    order = np.argsort(keys)
    at = order[np.minimum(np.searchsorted(keys, asked, sorter=order), len(keys) - 1)]
    return np.where(keys[at] == asked, values[at], 0.0)


def probabilities(words: np.ndarray, learned: np.ndarray, less: np.ndarray, order: int, discount: float, followers: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Of positions (grams in columns, whether the model learns from them, the single last word's probability) the probabilities.

    The positions are all of the corpus with these words before the last; where they are not, as that word is in other buckets too, followers has
    the counts of the words after it.
    """
    last = [packed.small(w) for w in words[::-1]]
    grams, contexts = [last[0]], [last[0] * np.uint64(0)]
    for k in range(1, order):
        for found in (grams, contexts):
            found.append(np.unique(packed.joined(last[k], found[-1]), return_inverse=True)[1].astype(np.uint64))
    sizes = [int(g.max(initial=0)) + 1 for g in grams]
    counts = [np.bincount(grams[-1].astype(np.int64), learned, sizes[-1])] * order

    def of(k: int, values: np.ndarray) -> np.ndarray:
        """Values of positions as values of the grams of level k."""
        out = np.empty(sizes[k], values.dtype)
        out[grams[k]] = values
        return out

    for k in range(order - 2, 0, -1):
        counts[k] = np.bincount(of(k + 1, grams[k]).astype(np.int64), counts[k + 1] > 0, sizes[k])
    p = of(0, less)
    for k in range(1, order):
        context = of(k, contexts[k]).astype(np.int64)
        total, types = np.bincount(context, counts[k]), np.bincount(context, counts[k] > 0)
        if k == 1 and followers is not None:
            counts[1] = _looked_up(*followers, of(1, words[-1]))
            total, types = (np.full(len(total), float(x)) for x in (followers[1].sum(), len(followers[1])))
        total, types, less = total[context], types[context], p[of(k, grams[k - 1])]
        p = np.where(total > 0, (np.maximum(counts[k] - discount, 0) + discount * types * less) / np.maximum(total, 1), less)
    return p[grams[order - 1]]


def losses(docs: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(doc_id, held_out, loss, n_targets): the mean negative log-likelihood of each document's tokens, and their number.

    The model learns from the documents that are not held out; rows of one id are one document, a null id is not held out. Tokens
    that the model has not seen share what the single words are discounted by. With nothing to learn from there is no row.
    """
    spark = docs.sparkSession
    c = coded(docs)
    buckets = Buckets.of(c, spark.sparkContext.defaultParallelism)
    single = _single(c, order, buckets)
    total, types = single.agg(F.sum("c"), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], "doc_id bigint, held_out boolean, loss double, n_targets bigint")
    numbered = single.where(F.col("word").between(1, packed.NUMBERED)).toArrow()
    table = np.zeros(len(c.often), np.uint32)
    table[numbered["word"].to_numpy()] = numbered["c"].to_numpy()
    shared = spark.sparkContext.broadcast(table)
    width = max(order, 2)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in packed.grams(batches, width):
            yield packed.blocks(WORDS, buckets.place(words[-2], words[-min(3, width)]), ids, words)

    def costs(rows: pa.Table) -> pa.Table:
        held = {kind: [r for r in rows.to_pylist() if r["kind"] == kind] for kind in (WORDS, COUNTS, SINGLE)}
        ids, words = packed.opened(held[WORDS], width)
        if not len(ids):
            return COSTS.empty_table()
        n, follow = packed.opened(held[COUNTS], 1)
        own = _looked_up(*(x.ravel() for x in packed.opened(held[SINGLE], 1)[::-1]), words[-1]) if held[SINGLE] else np.zeros(len(ids))
        has = words[-1] < packed.HASH
        own[has] = shared.value[words[-1, has]]
        less = np.maximum(own - discount, 0.0) / total + discount * types / total / (types + 1)
        p = probabilities(words, _learned(ids), less, order, discount, (follow[0], n) if rows["bucket"][0].as_py() >= buckets.n else None)
        cut = packed.starts(ids)
        doc = ids[cut]
        return pa.table([pa.array(doc, mask=doc == packed.NO_ID), pa.array(np.add.reduceat(-np.log(p), cut)), pa.array(np.diff(cut, append=len(ids)))], schema=COSTS)

    rows = c.rows.mapInArrow(dealt, packed.BLOCK_DDL)
    if len(buckets.often) and order > 1:
        rows = rows.unionByName(_followers(c, order, buckets))
    if c.rare:
        rows = rows.unionByName(_asked(c, order, buckets, single))
    # few tasks of many buckets, one bucket after the other: what a document costs is summed in each before it is shuffled
    tasks = TASKS * spark.sparkContext.defaultParallelism
    each = rows.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(costs, "doc_id bigint, cost double, n bigint")
    sums = each.groupBy("doc_id").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n_targets"))
    return sums.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.round(F.col("cost") / F.col("n_targets"), 6).alias("loss"), "n_targets")


def _sql(order: int) -> str:
    pad = ", ".join([f"'{START}'"] * (order - 1))
    parts = [
        rf"l AS (SELECT doc_id, [{pad}] || regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS l FROM documents)",
        f"g AS MATERIALIZED (SELECT doc_id, unnest(list_transform(range(1, len(l) - {order} + 2), lambda i: l[i:i + {order - 1}])) AS g FROM l WHERE len(l) >= {order})",
        f"t AS MATERIALIZED (SELECT g, count(*) FILTER (NOT coalesce(doc_id % {HELD_OUT} = 0, false)) AS n FROM g GROUP BY g)",
        f"c{order} AS MATERIALIZED (SELECT g, n::DOUBLE AS c FROM t WHERE n > 0)",
    ]
    for k in range(order - 1, 0, -1):
        parts.append(f"c{k} AS MATERIALIZED (SELECT g[2:] AS g, count(*)::DOUBLE AS c FROM c{k + 1} GROUP BY 1)")
    for k in range(1, order + 1):
        parts.append(f"x{k} AS MATERIALIZED (SELECT g[:-2] AS h, sum(c) AS total, count(*) AS types FROM c{k} GROUP BY 1)")
        less = f"JOIN p{k - 1} s ON s.g = a.g[2:]" if k > 1 else ""
        one = "1 / (types + 1)" if k == 1 else "s.p"
        fall = "NULL" if k == 1 else "s.p"
        parts.append(f"p{k} AS MATERIALIZED (SELECT a.g, coalesce((greatest(coalesce(c, 0) - {DISCOUNT}, 0) + {DISCOUNT} * types * {one}) / total, {fall}) AS p FROM (SELECT DISTINCT g[{order - k + 1}:] AS g FROM t) a LEFT JOIN c{k} c ON c.g = a.g LEFT JOIN x{k} x ON x.h = a.g[:-2] {less})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, coalesce(doc_id % {HELD_OUT} = 0, false) AS held_out, round(avg(-ln(p)), 6) AS loss, count(*) AS n_targets FROM g JOIN p{order} p ON p.g = g.g GROUP BY doc_id"


@query(_sql(ORDER))
def context_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss of every document under a model of order three learned from nine tenths of them."""
    return losses(documents(spark, sf_dir))
