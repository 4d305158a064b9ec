"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this package defines it (ASCII blanks part words, nothing else does).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
#: What str.split() also takes for a blank.
_OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: str) -> list[str]:
    """The words of a text; the same list as WORD.findall, by the faster split."""
    if _OTHER_BLANKS.search(text) is None:
        return text.split()
    out = _BLANKS.split(text)
    if out and not out[0]:
        out = out[1:]
    if out and not out[-1]:
        out.pop()
    return out


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z and leaves every other character alone, as bytes.lower() does."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-foliant-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, and its path there; file:/x as Hadoop writes it is file:///x."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def stored(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors. Also the table's path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """The table of stored(); it stays until the cluster clears the folder, as later results read it."""
    return stored(df, name)[0]


def discard(path: str) -> None:
    """Delete a table that no later result reads."""
    store, place = located(path)
    store.delete_dir(place)


def input_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows (0 for an empty table)."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def partitions_for(spark: SparkSession, n_bytes: int, target: int) -> int:
    """As many partitions as keep each near target bytes, and at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // target), 1)


def text_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of df only, so that other columns of any name do not reach Python."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of columns that may be Arrow or numpy arrays or lists."""
    return pa.RecordBatch.from_arrays([c.cast(t.type) if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def crc32_text(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the width-word shingles; a shorter sequence is one shingle, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    span = min(width, n)
    out = np.full(n - span + 1, np.uint64(span), np.uint64)
    for k in range(span):
        out = (out ^ hashes[k : n - span + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))


#: Bytes whose words are hashed at a time.
CHUNK = 4 << 20
#: The modulus and the base of a word's short hash.
MODULUS, BASE = 2**31 - 1, 1_000_003
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: A random number for each byte at each of 64 places in a word; a word's hash is their sum, mixed.
_TABLE = np.random.default_rng(20240611).integers(0, 2**64, (64, 256), np.uint64).ravel()


@cache
def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for k in range(1, n):
        out[k] = int(out[k - 1]) * BASE % MODULUS
    return out


def _cuts(raw: bytes) -> Iterator[tuple[int, int]]:
    """Spans of about CHUNK bytes that end at a blank."""
    lo = 0
    while lo < len(raw):
        hi = lo + CHUNK
        if hi < len(raw):
            back = max(raw.rfind(b" ", lo, hi), raw.rfind(b"\n", lo, hi))
            ahead = [k for k in (raw.find(b" ", hi), raw.find(b"\n", hi)) if k >= 0]
            hi = back + 1 if back > lo else min(ahead, default=len(raw) - 1) + 1
        yield lo, min(hi, len(raw))
        lo = hi


def word_hashes(raw: bytes, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, short hashes) of the words of UTF-8 text, by its bytes: the same words as WORD finds.

    A short hash is sum(byte * BASE ** place) % MODULUS, with places from 0; it is left out (empty) unless short is set.
    """
    starts, wide, small = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for lo, hi in _cuts(raw):
        byte = np.frombuffer(raw, np.uint8, hi - lo, lo)
        blank = np.concatenate([[True], _BLANK[byte], [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        if not len(edge):
            continue
        start, length = edge[0::2], edge[1::2] - edge[0::2]
        own = byte[~blank[1:-1]]
        first = np.cumsum(length) - length
        place = np.arange(len(own)) - np.repeat(first, length)
        longest = int(length.max())
        value = _TABLE[((place & 63) << 8) + own]
        if longest > 64:
            value = value * (2 * (place >> 6) + 1).astype(np.uint64)
        starts.append(start + lo)
        wide.append(mix(np.add.reduceat(value, first)))
        if short:
            small.append(np.add.reduceat(own * _powers(1 << max(6, (longest - 1).bit_length()))[place], first) % np.uint64(MODULUS))
    return np.concatenate(starts), np.concatenate(wide), np.concatenate(small)


class Words:
    """The hashed words of several texts side by side, A-Z in lower case: hashes, counts per text, and where lines begin.

    >>> w = Words(["a b\\nA", None, "c"], lines=True)
    >>> w.counts.tolist(), bool(w.hashes[0] == w.hashes[2]), w.lines.tolist(), w.line_text.tolist()
    ([3, 0, 1], True, [2, 1, 0, 1], [0, 0, 1, 2])
    """

    def __init__(self, texts: list[str | bytes | None], short: bool = False, lines: bool = False) -> None:
        raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        whole = b"\n".join([*raw, b""]).lower()
        start, self.hashes, self.short = word_hashes(whole, short)
        ends = np.cumsum([len(t) + 1 for t in raw], dtype=np.int64)
        at = np.searchsorted(start, ends)
        self.counts = np.diff(at, prepend=0)
        self.starts = at - self.counts
        if lines:
            line_end = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10)
            self.lines = np.diff(np.searchsorted(start, line_end), prepend=0)
            self.line_text = np.searchsorted(ends - 1, line_end)


def slices(texts: pa.Array, chars: int = 2_000_000) -> Iterator[tuple[int, list[bytes | None]]]:
    """The texts of an Arrow column as bytes, a few at a time, with the place of the first."""
    at, held, size = 0, [], 0
    for k, t in enumerate(texts):
        raw = t.as_buffer()
        held.append(None if raw is None else raw.to_pybytes())
        size += 0 if raw is None else raw.size
        if size > chars or k == len(texts) - 1:
            yield at, held
            at, held, size = k + 1, [], 0


def flat_shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the width words from each place on."""
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : n + k]) * _MIX
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_sets(texts: list[str | bytes | None], width: int = 5) -> Iterator[np.ndarray]:
    """shingles() of each text."""
    w = Words(texts)
    flat = flat_shingles(w.hashes, width)
    for start, n in zip(w.starts.tolist(), w.counts.tolist()):
        yield np.unique(flat[start : start + n - width + 1]) if n >= width else shingles(w.hashes[start : start + n], width)
