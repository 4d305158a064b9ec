"""Texts as numbers of their words, and blocks of grams: few large rows in place of one row a token.

The most frequent word types have numbers in the order of their counts, so that most words take one or two bytes; every other has a hash
that no two types of the corpus share. A block holds the grams of one bucket, column by column and byte by byte, compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import released

#: Word types that have numbers, 10 MB for every task; 0 stands before a text's first word. The others' hashes, of so many hex digits, are HASH or more.
NUMBERED, START, HASH, DIGITS = 1 << 20, 0, 1 << 62, 15
#: Tokens of a row of the coded table.
LOT = 1 << 20
#: What a null id counts as.
NO_ID = -(2**63)
#: A lot of texts: how many, their ids and sizes, and the words of all.
LOTS = pa.schema([("texts", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("n", pa.int64()), ("words", pa.binary()), ("hashes", pa.binary())])
LOTS_DDL = "texts bigint, ids binary, sizes binary, n bigint, words binary, hashes binary"
#: A block of n grams of a bucket; a number, an id or a count, goes with each.
BLOCK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("numbers", pa.binary()), ("words", pa.binary()), ("hashes", pa.binary())])
BLOCK_DDL = "bucket int, kind int, n int, numbers binary, words binary, hashes binary"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters or numbers; those newer than Java's tables are, as in SQL."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, four more after them, and where texts begin and end."""
    texts = texts.fill_null("").cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.concatenate([data, np.zeros(4, np.uint8)]), ends - ends[0]


def _among(data: np.ndarray, letters: np.ndarray, whole: bool) -> np.ndarray:
    """Which bytes are of characters among letters, a table of code points; the first byte of each alone if not whole."""
    word = np.concatenate([letters[:128], np.zeros(128, bool)])[data]
    lead = np.flatnonzero(data >= 0xC0)
    a, b, c, d = (data[lead + k].astype(np.int32) for k in range(4))
    size = 2 + (a >= 0xE0) + (a >= 0xF0)
    b, c, d = b & 63, c & 63, d & 63
    found = letters[np.choose(size - 2, [(a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d])]
    for k in range(4 if whole else 1):
        word[lead[found & (size > k)] + k] = True
    return word


def characters(texts: pa.Array, letters: np.ndarray) -> np.ndarray:
    """How many characters of each text are among letters."""
    data, ends = _bytes(texts)
    return np.diff(np.searchsorted(np.flatnonzero(_among(data, letters, False)), ends))


def tokens(texts: pa.Array, letters: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """The runs of letters (those of _letters()) of all texts, and how many each text has; found among the bytes of all texts at once."""
    data, ends = _bytes(texts)
    word = _among(data, _letters() if letters is None else letters, True)
    word[len(data) - 4 :] = False
    cut = np.zeros(len(data), bool)
    cut[ends] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | cut[1:]
    last[:-1] &= ~word[1:] | cut[1:]
    begun = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - begun
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(begun), pa.py_buffer(offsets), pa.py_buffer(data[word])), np.diff(np.searchsorted(begun, ends))


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, the lowest of all first, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), codec="zstd", asbytes=True)


def _whole(held: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(held, n * size, codec="zstd"), np.uint8).reshape(size, n).T).view(kind).reshape(n)


def pack_numbers(x: np.ndarray) -> bytes:
    """Signed numbers by their differences."""
    step = np.diff(x, prepend=np.int64(0))
    return _planes((step << 1) ^ (step >> 63))


def unpack_numbers(held: bytes, n: int) -> np.ndarray:
    step = _whole(held, n, np.int64)
    return np.cumsum(((step >> 1) & np.int64(2**63 - 1)) ^ -(step & 1))


def pack_words(words: np.ndarray) -> tuple[bytes, bytes]:
    """Words as numbers, and the hashes of those that have none."""
    rare = words >= HASH
    return _planes(np.where(rare, NUMBERED + 1, words).astype(np.uint32)), words[rare].tobytes()


def unpack_words(held: bytes, hashes: bytes, n: int) -> np.ndarray:
    words = _whole(held, n, np.uint32).astype(np.uint64)
    words[words == NUMBERED + 1] = np.frombuffer(hashes, np.uint64)
    return words


def blocks(kind: int, bucket: np.ndarray, numbers: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """A block for every bucket, of grams in columns."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    bucket, numbers, words = bucket[order], numbers[order], words[:, order]
    cut = starts(bucket).tolist()
    rows = [(int(bucket[lo]), kind, hi - lo, pack_numbers(numbers[lo:hi]), *pack_words(words[:, lo:hi].ravel())) for lo, hi in zip(cut, [*cut[1:], len(bucket)])]
    return pa.RecordBatch.from_pylist([dict(zip(BLOCK.names, r)) for r in rows], schema=BLOCK)


def opened(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all grams of blocks, and the grams in columns."""
    numbers = [unpack_numbers(r["numbers"], r["n"]) for r in rows]
    words = [unpack_words(r["words"], r["hashes"], r["n"] * width).reshape(width, -1) for r in rows]
    return np.concatenate([np.empty(0, np.int64), *numbers]), np.concatenate([np.empty((width, 0), np.uint64), *words], axis=1)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where grams begin that differ from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def small(words: np.ndarray) -> np.ndarray:
    """Words as numbers of a few bits, in the same order."""
    return np.unique(words, return_inverse=True)[1].astype(np.uint64) if words.max(initial=0) >= HASH else words.astype(np.uint64)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for every pair of small numbers, in their order."""
    top = int(b.max(initial=0)) + 1
    if (int(a.max(initial=0)) + 1) * top >= 2**63:
        a = np.unique(a, return_inverse=True)[1].astype(np.uint64)
    return a * np.uint64(top) + b


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a gram of each kind stands, in the order of their words, and how many there are."""
    key = small(columns[0])
    for c in columns[1:]:
        key = joined(key, small(c))
    order = np.argsort(key)
    cut = starts(key[order])
    return order[cut], np.diff(cut, append=len(key))


def counted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of grams in columns, and how many there are of each. Numbers of three words are one number, which is sorted alone."""
    if len(words) > 3 or words.max(initial=0) >= HASH:
        first, n = distinct(*words)
        return words[:, first], n
    bits, own = np.uint64(21), np.uint64((1 << 21) - 1)
    key = words[0]
    for w in words[1:]:
        key = key << bits | w
    key = np.sort(key)
    cut = starts(key)
    n, key = np.diff(cut, append=len(key)), key[cut]
    return np.stack([key >> bits * np.uint64(k) & own for k in range(len(words) - 1, -1, -1)]), n


def mixed(words: np.ndarray) -> np.ndarray:
    """A number below 2**31 for each word, to deal them out by."""
    return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


@dataclass
class Coded:
    """rows: lots of texts. total: all tokens. often: how often each number's word stands, and START before texts. rare: whether there are words without a number."""

    rows: DataFrame
    total: int
    often: np.ndarray
    rare: bool


def hashed(seed: int, token: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit(str(seed)), token), 256), 1, DIGITS), 16, 10).cast("bigint").bitwiseOR(F.lit(HASH))


def types(docs: DataFrame) -> DataFrame:
    """(t, n): every token of docs(text), and how often it stands."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, n = pc.value_counts(tokens(b["text"])[0]).flatten()
            yield pa.RecordBatch.from_arrays([t, n], names=["t", "n"])

    return docs.select(F.lower("text").alias("text")).mapInArrow(counted, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n"))


def coded(docs: DataFrame) -> Coded:
    """The texts of docs(doc_id, text) as numbers; those without a token are left out."""
    found = released(types(docs), "tokens")
    total, size = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = 0
    if size > NUMBERED:  # by how many types stand so often: few rows, and no task sorts all types
        n, at = map(np.array, zip(*sorted(found.groupBy("n").count().collect(), reverse=True)))
        least = int(n[np.searchsorted(np.cumsum(at), NUMBERED, "right")])
    most = found.where(F.col("n") > least).toArrow().sort_by([("n", "descending"), ("t", "ascending")])
    rare, seed, digits = len(most) < size, 0, DIGITS
    while rare and found.groupBy(hashed(seed, F.col("t"))).count().where("count > 1").limit(1).count():
        seed += 1
    shared = docs.sparkSession.sparkContext.broadcast(most["t"].combine_chunks())

    def numbered(words: pa.Array) -> np.ndarray:
        told = words.dictionary_encode()
        at = pc.index_in(told.dictionary, value_set=shared.value).fill_null(-1).to_numpy()
        own = (at + 1).astype(np.uint64)
        for k in np.flatnonzero(at < 0).tolist():
            own[k] = int(hashlib.sha256(f"{seed}{told.dictionary[k]}".encode()).hexdigest()[:digits], 16) | HASH
        return own[told.indices.to_numpy()]

    def in_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def lot() -> pa.RecordBatch:
            ids, sizes, words = map(np.concatenate, zip(*held))
            row = (len(ids), pack_numbers(ids), pack_numbers(sizes), len(words), *pack_words(words))
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(LOTS.names, row))], schema=LOTS)

        for b in batches:
            found, sizes = tokens(b["text"])
            ids, words, ends = b["doc_id"].fill_null(NO_ID).to_numpy(), numbered(found), np.concatenate([[0], np.cumsum(sizes)])
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + LOT, "right")) - 1)
                some = sizes[lo:hi] > 0
                held.append((ids[lo:hi][some], sizes[lo:hi][some], words[ends[lo] : ends[hi]]))
                if sum(len(h[2]) for h in held) >= LOT // 2:
                    yield lot()
                lo = hi
        if held:
            yield lot()

    rows = released(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(in_lots, LOTS_DDL), "coded")
    texts = rows.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    return Coded(rows, total, np.concatenate([[texts], most["n"].to_numpy()]), rare)


def grams(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of every lot the ids of its tokens, and the last width words up to each in columns."""
    for b in batches:
        for r in b.to_pylist():
            ids, sizes = unpack_numbers(r["ids"], r["texts"]), unpack_numbers(r["sizes"], r["texts"])
            at = np.arange(r["n"]) + np.repeat(np.arange(1, len(ids) + 1) * (width - 1), sizes)
            words = np.full(r["n"] + len(ids) * (width - 1), START, np.uint64)
            words[at] = unpack_words(r["words"], r["hashes"], r["n"])
            yield np.repeat(ids, sizes), np.stack([words[at - k] for k in range(width - 1, -1, -1)])
