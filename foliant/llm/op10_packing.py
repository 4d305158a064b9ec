"""Packing token sequences by non-negative least squares.

Each document is cut into whole windows and one rest. The histogram of rest lengths has at most
one entry per length, so the plan is made on it alone, whatever the corpus holds: shallow
combinations of two and three lengths that fill a window are enumerated, their repeat counts
are solved against the histogram by non-negative least squares and rounded, and what
is left is packed greedily, the longest first. Where the greedy choice would leave room, rests are cut: the head of a piece fills its
sequence, the tail begins the next one. Rests can be cut at every ``GRAIN`` ids, so a sequence is padded by fewer than ``GRAIN``
ids and the last one by the rest of its window. Pieces then find their places by their rank among
the pieces of their length, in a ranking salted by the length's own count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, materialise, read, text_columns
from .pretokens import WORD_END_PATTERN, special_strings, tokenizer, usual

TOKENIZER = "word_bpe_49k.json"
WINDOW = 4096
END = 2
#: Fixed value: what the file's last piece of a pre-token ends with.
WORD_END = "</w>"
#: Pre-tokens whose ids a Python worker remembers, and texts that it cuts at a time.
HELD = 400_000
AT_ONCE = 256
#: Ids between the places where a rest can be cut, and the room that a sequence may keep.
GRAIN = 32
#: Pieces of one length, at least, that are tried as one cycle, and pieces that a group of a ranking should hold.
CYCLE = 128
RANKED = 1 << 20

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
CUT = pa.schema([*PIECES, ("marks", pa.binary())])
PIECES_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes; agrees with the library, which settles every unusual text.

    New pre-tokens go to the library in one text, parted by blanks: an id whose piece carries the word-end mark ends its
    pre-token, so the ids fall apart again by themselves.
    """

    def __init__(self, name: str) -> None:
        self.name, self.seen = name, {}
        vocabulary = tokenizer(name).get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for piece, k in vocabulary.items() if piece.endswith(WORD_END)]] = True

    def learn(self, new: list[str]) -> None:
        ids = np.array(tokenizer(self.name).encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        at = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(at) != len(new):
            raise ValueError("pre-tokens and word ends differ")
        raw, start = ids.tobytes(), 0
        for p, end in zip(new, at):
            self.seen[p] = raw[start:end]
            start = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        library, special = tokenizer(self.name), special_strings(self.name)
        found = [WORD_END_PATTERN.findall(t.lower()) if usual(t) and not any(s in t for s in special) else None for t in texts]
        if len(self.seen) > HELD:
            self.seen.clear()
        new = set().union(*(f for f in found if f)).difference(self.seen)
        if new:
            self.learn(list(new))
        get = self.seen.__getitem__
        return [b"".join(map(get, f)) if f is not None else np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for f, t in zip(found, texts)]


@cache
def encoder(name: str) -> Encoder:
    """One for each Python worker, which keeps what it has learnt from task to task."""
    return Encoder(name)


def marks(raw: bytes, grain: int = GRAIN) -> bytes:
    """The CRC-32 of every beginning of ids of a multiple of grain ids, shorter than the whole."""
    out, crc = [], 0
    for at in range(0, len(raw) - 4 * grain, 4 * grain):
        crc = crc32(raw[at : at + 4 * grain], crc)
        out.append(crc)
    return np.array(out, "<u4").tobytes()


def tail_crc(whole: int, head: int, n: int) -> int:
    """The CRC-32 of the last n bytes, from that of the whole and that of what comes before them: CRC-32 is linear.

    >>> tail_crc(crc32(b"packing"), crc32(b"pack"), 3) == crc32(b"ing")
    True
    """
    zeros = bytes(n)
    return whole ^ crc32(zeros, head) ^ crc32(zeros)


def pieces(docs: DataFrame, name: str = TOKENIZER, window: int = WINDOW, end: int = END) -> DataFrame:
    """Cut every document, its end id included, into whole windows and a rest. A null text is empty: the end id alone.

    marks holds what a rest needs to be cut once more.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(name), int(end).to_bytes(4, "little")
        for whole in batches:
            for lo in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(lo, AT_ONCE)
                rows: list[tuple] = []
                for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode([t.as_py() or "" for t in b.column("text")])):
                    ids += last
                    n = len(ids) // 4
                    for at in range(0, n, window):
                        part = ids[4 * at : 4 * (at + window)]
                        rows.append((doc_id, at, len(part) // 4, crc32(part), n, marks(part) if n - at < window else b""))
                yield batch(CUT, *zip(*rows))

    return text_columns(docs, "doc_id", "text").mapInArrow(cut, f"{PIECES_DDL}, marks binary")


def nnls(columns: np.ndarray, target: np.ndarray, steps: int = 200) -> np.ndarray:
    """min |A x - target| over x >= 0 by accelerated projected gradients; columns holds the rows that each column adds one to (-1: none)."""
    n, used = len(columns), columns >= 0
    rows = np.where(used, columns, 0)

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), (used * x[:, None]).ravel(), len(target))

    def back(r: np.ndarray) -> np.ndarray:
        return (r[rows] * used).sum(1)

    v = np.ones(n)
    for _ in range(20):  # the largest eigenvalue gives the step
        v = back(times(v))
        v /= max(np.linalg.norm(v), 1e-30)
    step = 1 / max(np.linalg.norm(back(times(v))) * 1.05, 1e-30)
    x, y, t = np.zeros(n), np.zeros(n), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(times(y) - target))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (old - 1) / t * (new - x), new
    return x


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int, width: int = 8) -> np.ndarray:
    """Rows of up to three present lengths that fill the window: every such pair, and triples of each length with the width most frequent ones."""
    at = {int(v): k for k, v in enumerate(lengths)}
    out = {(at[v], at[window - v], -1) for v in at if v * 2 <= window and window - v in at}
    frequent = [int(lengths[k]) for k in np.argsort(-counts, kind="stable")[:width]]
    for a in at:
        for b in frequent:
            if (c := window - a - b) > 0 and c in at:
                out.add(tuple(sorted((at[a], at[b], at[c]), reverse=True)))
    return np.array(sorted(out), np.int64).reshape(-1, 3)


@dataclass
class Plan:
    """Runs of pieces of one length, in cycles: period pieces take stride sequences, over and over.

    A slot is the place of one piece of a cycle: the sequence it begins in, the offset there, and how many of its ids fit; the others
    are the beginning of the next sequence.
    """

    length: np.ndarray
    rank: np.ndarray
    period: np.ndarray
    stride: np.ndarray
    slot: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    head: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, head) of each piece."""
        # runs are sorted by length and rank; one key orders both (ranks stay below 2**48)
        key = (self.length.astype(np.int64) << 48) + self.rank
        k = np.searchsorted(key, (length.astype(np.int64) << 48) + rank, side="right") - 1
        cycle, at = np.divmod(rank - self.rank[k], self.period[k])
        slot = self.slot[k] + at
        return self.sequence[slot] + cycle * self.stride[k], self.offset[slot], self.head[slot]


def laid(lengths: list[int], window: int, grain: int) -> tuple[list[tuple[int, int, int]], int]:
    """The (sequence, offset, head) of pieces that are laid end to end, cut where a sequence is full, and the sequences that they take."""
    out, sequence, at = [], 0, 0
    for v in lengths:
        room = window - at
        head = v if v <= room else room // grain * grain
        if not head:
            sequence, at, head = sequence + 1, 0, v
        out.append((sequence, at, head))
        sequence, at = (sequence, at + v) if head == v else (sequence + 1, v - head)
    return out, sequence + 1


def plan(lengths: np.ndarray, counts: np.ndarray, window: int = WINDOW, grain: int = GRAIN, cycle: int = CYCLE) -> Plan:
    """The repeat counts of every pattern of lengths; their work and size depend on the window alone."""
    left = dict(zip(map(int, lengths), map(int, counts)))
    used: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        need = {v: pattern.count(v) for v in pattern}
        times = min(times, *(left[v] // k for v, k in need.items()))
        if times > 0:
            used.append((pattern, times))
            for v, k in need.items():
                left[v] -= k * times

    if left.get(window):
        take((window,), left[window])
    keep = (lengths < window) & (counts > 0)
    short, many = lengths[keep], counts[keep]
    patterns = combinations(short, many, window)
    if len(patterns):
        x = nnls(patterns, many.astype(float))
        for k in np.argsort(-x, kind="stable"):
            if x[k] >= 0.5:
                take(tuple(int(short[j]) for j in patterns[k] if j >= 0), int(x[k] + 0.5))
    there = sorted(v for v, n in left.items() if n > 0)
    cut: dict[int, int] = {}  # pieces of the lengths that fill no sequence whole
    while there:
        pattern, room, spare = [], window, {}
        while True:
            k = np.searchsorted(there, room, side="right") - 1
            while k >= 0 and left[there[k]] - spare.get(there[k], 0) <= 0:
                k -= 1
            if k < 0:
                break
            v = there[k]
            pattern.append(v)
            spare[v] = spare.get(v, 0) + 1
            room -= v
        if room < grain:
            take(tuple(pattern), min(left[v] // n for v, n in spare.items()))
        else:
            cut[there[-1]] = left[there[-1]]
            left[there[-1]] = 0
        there = [v for v in there if left[v] > 0]
    rank: dict[int, int] = {}
    runs, slots, sequence = [], [], 0

    def run(v: int, period: int, stride: int, times: int, places: list[tuple[int, int, int]]) -> None:
        runs.append((v, rank.get(v, 0), period, stride, len(slots)))
        slots.extend(places)
        rank[v] = rank.get(v, 0) + period * times

    for pattern, times in used:
        offset = 0
        for v in pattern:
            run(v, 1, 1, times, [(sequence, offset, v)])
            offset += v
        sequence += times
    rest: list[int] = []
    for v in sorted(cut, reverse=True):
        most = max(cycle, 16 * window // v)
        if cut[v] > most:  # a cycle of the least padding, repeated; what is left of the length joins the others
            places, _ = laid([v] * most, window, grain)
            taken = np.array([s + 1 + (h < v) for s, _, h in places])
            period = int(np.argmax(np.arange(1, most + 1) * v / taken)) + 1
            times, stride = cut[v] // period, int(taken[period - 1])
            run(v, period, stride, times, [(sequence + s, o, h) for s, o, h in places[:period]])
            sequence += stride * times
            cut[v] -= period * times
        rest += [v] * cut[v]
    places, _ = laid(rest, window, grain)
    for v, (s, o, h) in zip(rest, places):
        run(v, 1, 1, 1, [(sequence + s, o, h)])
    runs.sort()
    return Plan(*(np.array([r[k] for r in runs], np.int64) for k in range(5)), *(np.array([x[k] for x in slots], np.int64) for k in range(3)))


def ranked(cut: DataFrame, most: int = 0) -> DataFrame:
    """Adds rank: the number of each piece among those of its length, from 0, in a total order of the rows' values.

    most is the count of the most frequent length, which says in how many groups the pieces of a length are ranked.
    """
    salted = cut.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, start), {max(64, -(-most // RANKED))})"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))).drop("n")
    return salted.withColumn("rank", F.row_number().over(within).cast("bigint") - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base")


OUT = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, name: str = TOKENIZER, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece with its sequence and offset. An empty table gives an empty result; repeated rows are packed each for itself; null texts are empty, null ids are carried along."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, name, window, end), "pieces")
    # at most one row per length up to the window, whatever the corpus holds
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    counts = np.array([r.n for r in histogram], np.int64)
    made = spark.sparkContext.broadcast(plan(np.array([r.length for r in histogram], np.int64), counts, window))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                length = b.column("length").to_numpy()
                sequence, offset, head = made.value.place(length, b.column("rank").to_numpy())
                crc = b.column("ids_crc32").to_numpy().copy()
                again = np.flatnonzero(head < length)
                tails = np.zeros(len(again), np.int64)
                for k, i in enumerate(again):
                    first = int(np.frombuffer(b.column("marks")[int(i)].as_buffer(), "<u4")[head[i] // GRAIN - 1])
                    tails[k] = tail_crc(int(crc[i]), first, 4 * int(length[i] - head[i]))
                    crc[i] = first
                yield batch(OUT, b.column("doc_id"), b.column("start"), head, crc, b.column("doc_tokens"), sequence, offset)
                if len(again):
                    own = pa.array(again)
                    start = b.column("start").to_numpy()[again] + head[again]
                    yield batch(OUT, b.column("doc_id").take(own), start, (length - head)[again], tails, b.column("doc_tokens").take(own), sequence[again] + 1, np.zeros(len(again), np.int64))

    return ranked(cut, int(counts.max(initial=0))).select(*PIECES.names, "marks", "rank").mapInArrow(placed, f"{PIECES_DDL}, sequence_id bigint, offset bigint")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents: nulls are empty texts, a null id is carried along, repeated rows are packed each, an empty table gives no row, texts of any length are cut."""
    return pack(read(spark, sf_dir, "documents"))
