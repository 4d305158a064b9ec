"""A hashed bitmap of ids, of a fixed size: rows that cannot be wanted are dropped before a shuffle.

The bitmap never decides: what it lets through is joined by the id afterwards. In a corpus so large that
most bits are set it lets everything through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import batch, mix

BITS = 1 << 26
PARTS = 64
_SPAN = BITS // PARTS
SCHEMA = pa.schema([("part", pa.int32()), ("bits", pa.binary())])


def places(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(BITS)).astype(np.int64)


def bitmap(ids: DataFrame) -> Broadcast:
    """8 MB, whatever the number of rows in ids(id)."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for b in batches:
            bits[places(b.column(0).to_numpy())] = True
        for part in np.flatnonzero(bits.reshape(PARTS, -1).any(1)):
            at = np.flatnonzero(bits[part * _SPAN : (part + 1) * _SPAN])
            yield batch(SCHEMA, [int(part)], [at.astype("<u4").tobytes()])

    def union(table: pa.Table) -> pa.Table:
        bits = np.zeros(_SPAN, bool)
        for x in table["bits"]:
            bits[np.frombuffer(x.as_buffer(), "<u4")] = True
        return pa.table([table["part"].slice(0, 1), [np.packbits(bits).tobytes()]], schema=SCHEMA)

    whole = np.zeros(BITS // 8, np.uint8)
    for r in ids.mapInArrow(marked, "part int, bits binary").groupBy("part").applyInArrow(union, "part int, bits binary").collect():
        whole[r.part * _SPAN // 8 : (r.part + 1) * _SPAN // 8] = np.frombuffer(r.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(whole)


def perhaps(held: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = places(ids)
    return (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
