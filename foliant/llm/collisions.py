"""Which items share a key, as a spanning forest: linear in the keys, however many items share one.

Keys travel in packed blocks (a bucket, a binary of keys, a binary of ids), so that Spark moves few
large rows. A key's items become a star on the smallest id instead of all their pairs; each task first does so for
its own keys, so a key that a third of all items hold reaches its bucket once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

#: Keys that a task holds before it passes blocks on.
HELD = 1 << 20
#: Keys that a bucket should hold.
BUCKET_KEYS = 1 << 20

BLOCKS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("edges", pa.binary())])
#: What a null id counts as.
NO_ID = -(2**63)

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with edges a-b: every vertex but the smallest of its component, with that smallest."""
    vertex, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(vertex))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(vertex))
    return vertex[moved], vertex[label[moved]]


def stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys with the smallest id of each, and a spanning forest of the ids that share keys."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    least = ids[first][np.cumsum(first) - 1]
    other = ids != least
    return keys[first], ids[first], *forest(ids[other], least[other])


def blocks(source: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], n: int) -> Callable:
    """A mapInArrow function that packs the (keys, ids) pairs of source into blocks of n buckets."""

    def packed(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        k, i, a, b = stars(np.concatenate(keys), np.concatenate(ids))
        bucket = ((k >> np.uint64(20)) % np.uint64(n)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        found, start = np.unique(bucket[order], return_index=True)
        parts = list(zip(found.tolist(), np.split(k[order], start[1:]), np.split(i[order], start[1:]))) if len(found) else []
        rows = [(x, p.tobytes(), q.tobytes(), b"") for x, p, q in parts]
        if len(a):
            rows.append((int(a[0]) % n, b"", b"", np.stack([a, b]).tobytes()))
        return batch(BLOCKS, *(zip(*rows) if rows else [[]] * 4))

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for k, i in source(batches):
            keys.append(k)
            ids.append(i)
            held += len(k)
            if held > HELD:
                yield packed(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield packed(keys, ids)

    return function


def meet(table: pa.Table) -> pa.Table:
    """The forest of one bucket."""

    def joined(name: str, kind) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in table[name])])

    _, _, a, b = stars(joined("keys", np.uint64), joined("ids", np.int64))
    for x in table["edges"]:
        e = np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1)
        a, b = np.concatenate([a, e[0]]), np.concatenate([b, e[1]])
    a, b = forest(a, b) if len(a) else (a, b)
    return pa.table([pa.array(a), pa.array(b)], schema=EDGES)


def edges(rows: DataFrame, source: Callable, n_keys: int) -> DataFrame:
    """(a, b): a forest whose components are those of the ids that share keys. n_keys: about how many keys source gives."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // BUCKET_KEYS))
    packed = rows.mapInArrow(blocks(source, n), "bucket int, keys binary, ids binary, edges binary")
    return packed.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint").distinct()


MET = pa.schema([("bucket", pa.int32()), ("units", pa.binary()), ("docs", pa.binary())])
SHARED = pa.schema([("key", pa.int64()), ("first", pa.int64())])


def _ends(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys with the smallest and the largest id of each."""
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(key))[: len(first)] - 1
    return key[first], ids[first], ids[last]


def shared_keys(rows: DataFrame, n_keys: int) -> DataFrame:
    """(key, first): the keys of rows(doc_id, units), 64-bit numbers packed into a binary, that stand under two ids, with the smallest id.

    A task passes on two ids of a key at most. n_keys: about how many keys there are.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // BUCKET_KEYS))

    def packed(found: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        key, lo, hi = _ends(np.concatenate(found), np.concatenate(ids))
        key, own = np.concatenate([key, key[lo != hi]]), np.concatenate([lo, hi[lo != hi]])
        bucket = ((key.view(np.uint64) >> np.uint64(20)) % np.uint64(n)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        name, start = np.unique(bucket[order], return_index=True)
        parts = zip(np.split(key[order], start[1:]), np.split(own[order], start[1:]))
        return batch(MET, name, *zip(*((k.tobytes(), i.tobytes()) for k, i in parts)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids, held = [], [], 0
        for b in batches:
            for own, raw in zip(b.column("doc_id").fill_null(NO_ID).to_pylist(), b.column("units")):
                found.append(np.frombuffer(raw.as_buffer(), np.int64))
                ids.append(np.full(len(found[-1]), own, np.int64))
                held += len(found[-1])
                if held > HELD:
                    yield packed(found, ids)
                    found, ids, held = [], [], 0
        if held:
            yield packed(found, ids)

    def meet(table: pa.Table) -> pa.Table:
        key, lo, hi = _ends(*(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table[c]]) for c in ("units", "docs")))
        return pa.table([pa.array(key[lo != hi]), pa.array(lo[lo != hi])], schema=SHARED)

    return rows.select("doc_id", "units").mapInArrow(pack, "bucket int, units binary, docs binary").groupBy("bucket").applyInArrow(meet, "key bigint, first bigint")
