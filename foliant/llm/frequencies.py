"""Document frequencies of shingles, and the rare-first prefixes of sets that follow from them.

A task numbers its documents in flushes and sends each flush's shingles to buckets, in packed blocks: 8 bytes of
the shingle's hash and 2 of the document's number, or of a shingle that several of its documents hold, once, with
their count. A bucket adds up the counts and returns those of two and more to their flushes, so what comes back
is small: most shingles of a corpus stand in one document. No bucket grows with the copies of a set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialise

#: Shingles of a flush, and of a bucket. A flush numbers fewer than 2**16 documents.
HELD = 1 << 20
BUCKET = 1 << 20

_BINARY = ("docs", "lone", "numbers", "shared", "counts", "holders", "held")
BLOCKS = pa.schema([("bucket", pa.int32()), ("flush", pa.int64()), *((n, pa.binary()) for n in _BINARY)])
BLOCKS_DDL = "bucket int, flush bigint, " + ", ".join(f"{n} binary" for n in _BINARY)
BACK_DDL = BLOCKS_DDL.replace("bucket int, ", "")
BACK = pa.schema(list(BLOCKS)[1:])
DOCS = np.dtype([("doc_id", "<i8"), ("n", "<i8"), ("h1", "<i8"), ("h2", "<i8"), ("same", "<u2")])


def _bucket(s: np.ndarray, n: int) -> np.ndarray:
    return ((s >> np.uint64(32)) % np.uint64(n)).astype(np.int32)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    for lo, hi in zip(at, [*at[1:], len(bucket)]):
        yield int(bucket[lo]), slice(lo, hi)


def _packed(flush: int, docs: list[tuple], sets: list[np.ndarray], n: int) -> pa.RecordBatch:
    """docs: (doc_id, size, h1, h2, number of the first document of the flush with an equal set); sets of the first ones alone."""
    every = np.concatenate([np.zeros(0, np.uint64), *sets])
    number = np.repeat(np.array([k for k, d in enumerate(docs) if d[4] == k], np.uint16), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, number = every[order], number[order]
    first = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(every)))
    rows: dict[int, list] = {}
    for several in (False, True):
        chosen = at[(times > 1) == several]
        token = every[chosen]
        bucket = _bucket(token, n)
        by = np.argsort(bucket, kind="stable")
        other = times[times > 1].astype(np.uint32)[by] if several else number[chosen][by]
        token = token[by]
        for b, part in _runs(bucket[by]):
            rows.setdefault(b, [b""] * 4)[2 * several : 2 * several + 2] = token[part].tobytes(), other[part].tobytes()
    many = np.repeat(times > 1, times)
    out = [(b, flush, b"", *r, b"", b"") for b, r in rows.items()]
    out.append((flush % n, flush, np.array(docs, DOCS).tobytes(), b"", b"", b"", b"", number[many].tobytes(), every[many].tobytes()))
    return batch(BLOCKS, *zip(*out))


def _pack(source: Callable, n: int) -> Callable:
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = TaskContext.get().partitionId() << 24
        docs, sets, seen, size = [], [], {}, 0
        for doc_id, s, h1, h2 in source(batches):
            same = seen.setdefault((h1, h2), len(docs))
            if same == len(docs):
                sets.append(s)
                size += len(s)
            docs.append((doc_id, len(s), h1, h2, same))
            if size > HELD or len(docs) >= 60_000:
                yield _packed(flush, docs, sets, n)
                flush += 1
                docs, sets, seen, size = [], [], {}, 0
        if docs:
            yield _packed(flush, docs, sets, n)

    return function


def _joined(chunks: list, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in chunks)])


def _count(table: pa.Table) -> pa.Table:
    """Adds up one bucket and returns to each flush what is there twice or more: (token, frequency) pairs, lone ones with their document."""
    flush = table["flush"].to_pylist()
    lone, numbers, shared, counts = (table[n].to_pylist() for n in ("lone", "numbers", "shared", "counts"))
    token = np.concatenate([_joined(lone, "<u8"), _joined(shared, "<u8")])
    times = np.concatenate([np.ones(sum(map(len, lone)) // 8, np.int64), _joined(counts, "<u4").astype(np.int64)])
    order = np.argsort(token, kind="stable")
    first = np.concatenate([[True], token[order][1:] != token[order][:-1]]) if len(token) else np.zeros(0, bool)
    group = np.empty(len(token), np.int64)
    group[order] = np.cumsum(first) - 1
    total = np.bincount(group, times).astype(np.uint32)[group] if len(token) else np.zeros(0, np.uint32)
    out, a, b = [], 0, sum(map(len, lone)) // 8
    for k, f in enumerate(flush):
        la, lb = len(lone[k]) // 8, len(shared[k]) // 8
        often = total[a : a + la] > 1
        mine, df = np.frombuffer(lone[k], "<u8")[often], total[a : a + la][often]
        number = np.frombuffer(numbers[k], "<u2")[often]
        meta = table["docs"][k].as_py()
        if len(mine) or lb or meta:
            out.append((f, meta, mine.tobytes() + shared[k], number.tobytes(), b"", df.tobytes() + total[b : b + lb].tobytes(), table["holders"][k].as_py(), table["held"][k].as_py()))
        a, b = a + la, b + lb
    if not out:
        return BACK.empty_table()
    return pa.Table.from_batches([batch(BACK, *zip(*out))])


def _prefix(table: pa.Table, percent: int) -> pa.Table:
    """The prefixes of one flush: of each first document, the frequent shingles among its rarest n - ceil(percent n / 100) + 1."""
    schema = pa.schema([("doc_id", pa.int64()), ("keys", pa.binary())])
    columns = {c: table[c].to_pylist() for c in _BINARY}
    docs = _joined([x for x in columns["docs"] if x], DOCS)
    number, token, df = [], [], []
    all_shared, all_df = [], []
    for x, who, d in zip(columns["lone"], columns["numbers"], columns["counts"]):
        t, w, f = np.frombuffer(x, "<u8"), np.frombuffer(who, "<u2"), np.frombuffer(d, "<u4")
        number.append(w)
        token.append(t[: len(w)])
        df.append(f[: len(w)])
        all_shared.append(t[len(w) :])
        all_df.append(f[len(w) :])
    shared, shared_df = _joined(all_shared, "<u8"), _joined(all_df, "<u4")
    order = np.argsort(shared)
    shared, shared_df = shared[order], shared_df[order]
    held, holders = _joined(columns["held"], "<u8"), _joined(columns["holders"], "<u2")
    if len(held):
        token.append(held)
        number.append(holders)
        df.append(shared_df[np.searchsorted(shared, held)])
    number, token, df = _joined(number, "<u2"), _joined(token, "<u8"), _joined(df, "<u4")
    order = np.lexsort((token, df, number))
    number, token = number[order], token[order]
    out = []
    for at, part in _runs(number.astype(np.int32)):
        size = int(docs["n"][at])
        take = size - -(-percent * size // 100) + 1 - (size - (part.stop - part.start))
        if take > 0:
            out.append((int(docs["doc_id"][at]), token[part][:take].tobytes()))
    # copies inside the flush hold the same keys; one of them is enough of a set, the set's class has the others
    return pa.Table.from_batches([batch(schema, *zip(*out))]) if out else schema.empty_table()


SET = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])


def prefixes(rows: DataFrame, source: Callable, n_items: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sets, keys) of the items that source gives as (doc_id, sorted hashes, h1, h2).

    sets(doc_id, n, h1, h2) has a row per item; keys(doc_id, keys) the prefix keys, by which any two sets within the
    similarity meet, of those items that can meet any other. n_items: about how many hashes there are. rows should be read from
    files, not come out of a shuffle: a task that runs again must meet its rows in the same order, as it numbers them.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_items // BUCKET))
    packed = rows.mapInArrow(_pack(source, n), BLOCKS_DDL)
    back = materialise(packed.groupBy("bucket").applyInArrow(_count, BACK_DDL), "frequencies")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = _joined([x for x in b.column("docs").to_pylist() if x], DOCS)
            if len(docs):
                yield batch(SET, *(docs[c] for c in SET.names))

    sets = back.where(F.length("docs") > 0).select("docs").mapInArrow(unpacked, "doc_id bigint, n bigint, h1 bigint, h2 bigint")
    keys = back.groupBy("flush").applyInArrow(lambda t: _prefix(t, percent), "doc_id bigint, keys binary")
    return sets, materialise(keys, "prefixes")
