"""Document fingerprints by a randomised edit embedding.

All texts walk over their characters with the same random bits: at step i the walk writes the character
it stands on and moves on if the bit of (i, character) is one. A few edits throw two walks apart for
a few steps only, so edit distance becomes Hamming distance. A fingerprint keeps the symbols at
``SLOTS`` steps; each slot takes the step of smallest priority among the steps of the text, so texts
of nearly equal length look at the same steps. Near pairs come from bands of sampled slots, checked by
the slots in common: 40 bands of 8 slots bring a pair of likeness 0.8 together with probability 1 - (1 - 0.8^8)^40 = 0.9994.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collisions import shared_keys
from .common import batch, input_bytes, materialise, mix, partitions_for, read, text_columns
from .components import components
from .idfilter import bitmap, perhaps
from .tiles import verified

SLOTS = 128
#: Steps of a walk for each character; a bit is one for half of them, so a walk ends near the text's end.
PACE = 2
#: Steps after which the random bits repeat, shifted.
PERIOD = 4096
SEED = 20240607
#: Characters that walk side by side.
LANES = 6_000_000
#: Bytes of text of a partition while the following text is looked up.
TARGET = 24 << 20
#: Ranges at most (their bounds are broadcast: 0.5 MB). They are sorted and read as streams, so a larger table has longer ranges: 1.5 GB each at 100 TB.
RANGES = 1 << 16
BANDS, BAND_SLOTS = 40, 8
LIKENESS = 0.8

_HEX = np.array([f"{k:x}" for k in range(16)])


@cache
def _bits() -> np.ndarray:
    """One row of moves for each step of a period: 0 on the end mark (class 0), else a random bit for each class."""
    out = np.random.default_rng(SEED).integers(0, 2, (PERIOD, 256)).astype(np.int64)
    out[:, 0] = 0
    return out


def _priority(slot: np.ndarray, step: np.ndarray) -> np.ndarray:
    x = (step.astype(np.uint64) * np.uint64(SLOTS) + slot.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Steps:
    """For each slot the steps that are of smaller priority than all before; the sampled step of a length is the last of them below it."""

    def __init__(self) -> None:
        self.known, self.records, self.least = 0, [np.zeros(0, np.int64)] * SLOTS, np.full(SLOTS, np.iinfo(np.uint64).max)

    def upto(self, n: int) -> None:
        while self.known < n:
            step = np.arange(self.known, self.known + 16384)
            for s in range(SLOTS):
                p = _priority(np.uint64(s), step)
                low = np.minimum.accumulate(np.minimum(p, self.least[s]))
                new = np.concatenate([[p[0] < self.least[s]], low[1:] < low[:-1]])
                self.records[s] = np.concatenate([self.records[s], step[new]])
                self.least[s] = low[-1]
            self.known += 16384

    def of(self, lengths: np.ndarray) -> np.ndarray:
        self.upto(int(lengths.max(initial=1)))
        return np.stack([r[np.maximum(np.searchsorted(r, lengths) - 1, 0)] for r in self.records], 1)


@cache
def _steps() -> Steps:
    return Steps()


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of SLOTS values below 16 for each whole text; equal texts have equal rows, an empty text a row of its own."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    out = np.zeros((len(texts), SLOTS), np.uint8)
    order = np.argsort([-len(p) for p in points], kind="stable")
    at = 0
    while at < len(order):
        take, held = at, 0
        while take < len(order) and (held := held + len(points[order[take]]) + 1) <= LANES or take == at:
            take += 1
        out[order[at:take]] = _walk([points[k] for k in order[at:take]])
        at = take
    return out


def _walk(points: list[np.ndarray]) -> np.ndarray:
    """Texts of falling length, all at once: at each step only those that still walk are moved."""
    n = np.array([len(p) for p in points], np.int64)
    flat = np.zeros(int(n.sum()) + len(n), np.uint8)  # an end mark after each text
    start = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
    for p, s in zip(points, start):
        flat[s : s + len(p)] = 1 + ((p * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(255)
    length = np.maximum(PACE * n, 1)
    sampled = _steps().of(length)
    # the samples in order of their steps, to be read as the walk passes them
    which = np.argsort(sampled, axis=None, kind="stable")
    due, owner = sampled.ravel()[which], which // SLOTS
    symbols = np.zeros(sampled.size, np.uint8)
    bits, pos, done = _bits(), start.copy(), 0
    alive = np.searchsorted(-length, -np.arange(length[0]), side="left") if len(n) else []
    ends = np.searchsorted(due, np.arange(length[0] + 1) + 1) if len(n) else []
    for step in range(int(length[0]) if len(n) else 0):
        here = pos[: alive[step]]
        seen = flat.take(here)
        if ends[step] > done:
            symbols[which[done : ends[step]]] = seen[owner[done : ends[step]]]
            done = ends[step]
        turn = step // PERIOD
        here += bits[(step + 37 * turn) % PERIOD].take(seen)
    slot = np.arange(SLOTS, dtype=np.uint32)
    value = (symbols.reshape(sampled.shape).astype(np.uint32) * np.uint32(0x9E3779B1) + slot * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    return ((value ^ (value >> np.uint32(15))) >> np.uint32(12) & np.uint32(15)).astype(np.uint8)


def to_text(prints: np.ndarray) -> list[str]:
    return ["".join(row) for row in _HEX[prints]]


def from_text(prints: list[str]) -> np.ndarray:
    return np.array([list(bytes.fromhex("0" + "0".join(p))) for p in prints], np.uint8).reshape(len(prints), -1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many characters of the beginning of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def band_keys(prints: np.ndarray) -> np.ndarray:
    """BANDS keys of BAND_SLOTS sampled slots each."""
    chosen = np.random.default_rng(SEED + 1).permuted(np.tile(np.arange(SLOTS), (BANDS, 1)), axis=1)[:, :BAND_SLOTS]
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(prints), 1))
    for c in chosen.T:
        key = (key << np.uint64(4)) | prints[:, c]  # four bits a slot: no two keys are one
    return mix(key)


SENT = pa.schema([("part", pa.int32()), ("last", pa.bool_()), ("doc_id", pa.int64()), ("head", pa.string()), ("tie", pa.int64()), ("packed", pa.binary())])


def followed(docs: DataFrame) -> DataFrame:
    """(part, last, doc_id, packed): the rows of docs dealt to ranges of doc_id, each range followed by the first row of the next.

    packed is the text, compressed. The row that follows (last is true) is there for its text alone. The last range is followed by the first
    row of all. Rows of one doc_id are in the order of the first 32 characters, then of a hash, of their texts; a null doc_id comes first, a null text is empty.
    """
    spark = docs.sparkSession
    rows = text_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = min(RANGES, partitions_for(spark, input_bytes(docs, "text"), TARGET))
    # n - 1 bounds between ranges, whatever the table holds
    quantiles = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], max(10_000, 4 * n)).alias("q")).first()["q"] or []
    sent = spark.sparkContext.broadcast(np.array(sorted(set(quantiles)), np.int64))

    def parts(ids: pa.Array) -> np.ndarray:
        return np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(sent.value, ids.fill_null(0).to_numpy()), 0).astype(np.int32)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("doc_id", pa.int64())])
        first: dict[int, tuple] = {}
        for b in batches:
            for part, doc_id in zip(parts(b.column("doc_id")).tolist(), b.column("doc_id").to_pylist()):
                key = (doc_id is not None, doc_id)
                if part not in first or key < first[part]:
                    first[part] = key
        if first:
            yield batch(schema, list(first), *zip(*first.values()))

    starts = rows.select("doc_id").mapInArrow(least, "part int, known boolean, doc_id bigint").groupBy("part").agg(F.min(F.struct("known", "doc_id")).alias("s")).orderBy("part").collect()
    places = spark.sparkContext.broadcast({r.part: (r.s.doc_id, starts[k - 1].part) for k, r in enumerate(starts)})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = []
            for part, doc_id, *tie, t in zip(parts(b.column("doc_id")).tolist(), *(b.column(c).to_pylist() for c in ("doc_id", "head", "tie")), b.column("text")):
                first, before = places.value[part]
                packed = packer.compress(t.as_buffer())
                out.append((part, False, doc_id, *tie, packed))
                if doc_id == first:
                    out.append((before, True, doc_id, *tie, packed))
            if out:
                yield batch(SENT, *zip(*out))

    made = rows.select("doc_id", F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("tie"), "text").mapInArrow(dealt, "part int, last boolean, doc_id bigint, head string, tie bigint, packed binary")
    return made.repartition(max(len(starts), 1), "part").sortWithinPartitions("part", "last", F.col("doc_id").asc_nulls_first(), "head", "tie").drop("head", "tie")


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_meets", pa.bool_())])
OUT_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_meets boolean"


def with_edits(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its fingerprint, that of its edited text, and their likeness to it and to the next row's.

    edited_meets tells whether the bands bring the text and its edited text together. A table of one row follows itself, an empty one gives
    no row; a null text is empty; rows that repeat an id follow each other.
    """

    def run(rows: list[tuple], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        changed = [edited(t, f) for t, f in zip(texts, [*texts[1:], following])]
        prints = fingerprints([*texts, following, *changed])
        own, after, new = prints[: len(rows)], prints[1 : len(rows) + 1], prints[len(rows) + 1 :]
        meets = (band_keys(own) == band_keys(new)).any(1)
        shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
        return batch(OUT, [d for d, _ in rows], list(map(len, texts)), shas, to_text(own), to_text(new), likeness(own, new), likeness(own, after), meets)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # rows of one range whose following text is still to come
        size, closed = 0, False
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            for last, doc_id, t in zip(b.column("last").to_pylist(), b.column("doc_id").to_pylist(), b.column("packed")):
                text = unpacker.decompress(t.as_buffer()).decode("utf-8", "surrogatepass")
                if last:
                    # of rows that repeat the next range's first doc_id, the first in order follows
                    if not closed:
                        yield run(rows, text)
                    rows, size, closed = [], 0, True
                    continue
                closed = False
                if size > LANES:
                    yield run(rows, text)
                    rows, size = [], 0
                rows.append((doc_id, text))
                size += len(text)

    return followed(docs).mapInArrow(walked, OUT_DDL)


def slot_set(packed: bytes | pa.Buffer) -> np.ndarray:
    """The slots of a packed fingerprint as a set: a slot and its value are one element, so slots in common are an intersection."""
    two = np.frombuffer(packed, np.uint8)
    slots = np.stack([two >> 4, two & 15], 1).ravel().astype(np.uint64)
    return np.sort(mix((np.arange(len(slots), dtype=np.uint64) << np.uint64(4)) + slots))


def _classed(prints: DataFrame, least: float) -> DataFrame:
    """(fingerprint, class_id): the class of every fingerprint of prints(doc_id, fingerprint) that a row with an id holds.

    Each fingerprint is first verified against the smallest one of every band key that it shares. Only the keys
    whose holders are not all linked by then have all their pairs compared, in tiles.
    """
    key_schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch(pa.schema([("doc_id", pa.int64()), ("units", pa.binary())]), b.column("id"), [k.tobytes() for k in band_keys(from_text(b.column("fingerprint").to_pylist()))])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(from_text(b.column("fingerprint").to_pylist())).ravel().view(np.int64)
                keep = perhaps(held.value, keys)
                yield batch(key_schema, keys[keep], np.repeat(b.column("id").to_numpy(), BANDS)[keep])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select(["a", "b"]).filter(pa.array(likeness(*(from_text(b.column(c).to_pylist()) for c in ("x", "y"))) >= least))

    some = prints.where("doc_id IS NOT NULL")
    classes = materialise(some.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    shared = materialise(shared_keys(classes.select("id", "fingerprint").mapInArrow(packed, "doc_id bigint, units binary"), BANDS * classes.count()), "shared")
    held = bitmap(shared.select("key"))
    met = materialise(classes.select("id", "fingerprint").mapInArrow(candidates, "key bigint, id bigint").join(shared, "key"), "met")
    own = classes.select("id", "fingerprint")
    pairs = met.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    sides = pairs.join(own.select(F.col("id").alias("a"), F.col("fingerprint").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("fingerprint").alias("y")), "b")
    links = materialise(sides.mapInArrow(checked, "a bigint, b bigint"), "links")
    known = materialise(components(links), "components")
    labelled = met.join(known, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    open_keys = materialise(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "open")
    members = met.join(open_keys, "key").join(classes, "id").select(F.col("key").alias("group"), "id", "copies", F.lit(SLOTS).cast("bigint").alias("n"), F.unhex("fingerprint").alias("shingles"))
    part = int(np.ceil(least * SLOTS))
    found, _ = verified(materialise(members, "members"), 100 * part / (2 * SLOTS - part) - 1e-9, slot_set)
    whole = components(links.union(found))
    return classes.join(whole, "id", "left").select("fingerprint", F.coalesce("component", "id").alias("class_id"))


def near_classes(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """(doc_id, class_id): the components of documents whose fingerprints share a band and at least that part of their slots.

    Documents with equal fingerprints are one class from the start. Those that share a band form groups, in which every pair is
    checked, in tiles. A null text is empty; rows with a null doc_id are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch(schema, b.column("doc_id"), to_text(fingerprints([t.as_py() or "" for t in b.column("text")])))

    some = text_columns(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(prints, "doc_id bigint, fingerprint string")
    some = materialise(some, "fingerprints")
    return some.join(_classed(some, least), "fingerprint").select("doc_id", "class_id")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of with_edits with class_id, as near_classes gives it; a row without an id has the class of its fingerprint, or null."""
    made = materialise(with_edits(read(spark, sf_dir, "documents")), "edits")
    return made.join(_classed(made.select("doc_id", "fingerprint"), LIKENESS), "fingerprint", "left").select(*made.columns, "class_id")
