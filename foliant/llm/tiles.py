"""Exact Jaccard links inside groups of candidates, by size-banded tiles of hashed bitmaps.

A group that fits one tile is compared in one task with other small groups; a larger one is cut by size band and salt into blocks,
and each pair of blocks of the same or neighbouring bands is a tile. Inside a tile three bounds go before
the exact sorted-array intersection: the sizes; the distance to a pivot, which proves most
links between copies; and the bits that one bitmap has and the other has not, which bound the
overlap from above.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collisions import forest
from .common import materialise

#: Members, and shingles, that a block of a tile should hold.
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 1 << 20
#: Members that a bucket of small groups should hold.
BUCKET_MEMBERS = 4096

FOUND = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def reaches(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: float) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def _bitmaps(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One row of 64-bit words per member; as wide as the largest member needs, up to 2**14 bits."""
    bits = 1 << min(14, max(8, int(size.max(initial=1)).bit_length() + 1))
    owner = np.repeat(np.arange(len(size)), size)
    at = (flat >> np.uint64(7)) & np.uint64(bits - 1)
    out = np.zeros((len(size), bits // 64), np.uint64)
    np.bitwise_or.at(out, (owner, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return out


def _shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of a sorted array with each of others."""
    if not len(x):
        return np.zeros(len(others), np.int64)
    joined = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, joined), len(x) - 1)] == joined
    ends = np.cumsum([len(o) for o in others])
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[ends] - total[ends - [len(o) for o in others]]


def compare(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, percent: float) -> np.ndarray:
    """The links between members left and right as a boolean table; of a block with itself (same), the upper half."""
    size = np.array([len(s) for s in sets], np.int64)
    a, b = size[left][:, None], size[right][None, :]
    able = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    able &= (a > 0) & (b > 0)
    if same:
        able &= np.triu(np.ones(able.shape, bool), 1)
    pivot = sets[left[len(left) // 2]]
    far = size + len(pivot) - 2 * _shared(pivot, sets)
    least = np.maximum(0, (a + b - (far[left][:, None] + far[right][None, :])) // 2)
    linked = able & reaches(least, a, b, percent)
    rest = able & ~linked
    if rest.any():
        maps = _bitmaps(np.concatenate(sets), size)
        for i in np.flatnonzero(rest.any(1)):
            js = np.flatnonzero(rest[i])
            mine, theirs = maps[left[i]], maps[right[js]]
            most = np.minimum(size[left[i]] - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), size[right[js]] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))
            js = js[reaches(most, size[left[i]], size[right[js]], percent)]
            if len(js):
                shared = _shared(sets[left[i]], [sets[right[j]] for j in js])
                linked[i, js] = reaches(shared, size[left[i]], size[right[js]], percent)
    return linked


def _numbers(raw: pa.Buffer) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _tile(table: pa.Table, percent: float, unpack: Callable = _numbers) -> pa.Table:
    """All tiles of one bucket: edges of a spanning forest (other not null) and link counts weighted by copies."""
    order = np.lexsort((table["id"].to_numpy(), table["side"].to_numpy(), table["tile"].to_numpy()))
    tile, side, ids, copies = (table[n].to_numpy()[order] for n in ("tile", "side", "id", "copies"))
    raw = table["shingles"].combine_chunks()
    repeated = np.zeros(len(order), bool)  # repeated rows of one member
    for k in np.flatnonzero((ids[1:] == ids[:-1]) & (tile[1:] == tile[:-1]) & (side[1:] == side[:-1])):
        repeated[k + 1] = raw[int(order[k])] == raw[int(order[k + 1])]
    order, tile, side, ids, copies = (x[~repeated] for x in (order, tile, side, ids, copies))
    out: list[tuple] = []
    cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]])) if len(tile) else np.zeros(1, int)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        sets = [unpack(raw[int(k)].as_buffer()) for k in order[lo:hi]]
        at = np.arange(hi - lo)
        same = side[lo] == 2
        left, right = (at, at) if same else (at[side[lo:hi] == 0], at[side[lo:hi] == 1])
        if not len(left) or not len(right):  # a block that no member's hash chose
            continue
        linked = compare(sets, left, right, same, percent)
        i, j = np.nonzero(linked)
        if not len(i):
            continue
        mine, weight = ids[lo:hi], copies[lo:hi]
        counts = np.bincount(left[i], weight[right[j]], hi - lo) + np.bincount(right[j], weight[left[i]], hi - lo)
        a, b = forest(mine[left[i]], mine[right[j]])
        keep = counts > 0
        out.append((np.concatenate([mine[keep], a]), np.concatenate([np.full(keep.sum(), -1), b]), np.concatenate([counts[keep].astype(np.int64), np.zeros(len(a), np.int64)]), np.concatenate([np.ones(keep.sum(), bool), np.zeros(len(a), bool)])))
    if not out:
        return FOUND.empty_table()
    a, b, n, counted = (np.concatenate([o[k] for o in out]) for k in range(4))
    return pa.table([pa.array(a), pa.array(b, mask=counted), pa.array(n)], schema=FOUND)


def assign(members: DataFrame) -> DataFrame:
    """members(group, id, copies, n, ...) with bucket, tile and side: each member once for every tile that it takes part in."""
    spark = members.sparkSession
    band = F.floor(F.log(F.col("n")) / math.log(1.25)).cast("int")
    blocks = lambda count, total: F.greatest(F.ceil(count / BLOCK_MEMBERS), F.ceil(total / BLOCK_SHINGLES)).cast("int")
    per_band = members.groupBy("group", band.alias("band")).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    whole = per_band.groupBy("group").agg(
        F.sum("m").alias("members"),
        F.when(blocks(F.sum("m"), F.sum("s")) <= 1, F.lit(None)).otherwise(F.map_from_entries(F.collect_list(F.struct("band", blocks(F.col("m"), F.col("s")))))).alias("salts"),
    ).where("members > 1")
    # a table of its own, so that the join below has a shuffle of its own, whose hot groups the adaptive plan splits
    whole = materialise(whole, "groups")
    n_small = max(1, whole.where("salts IS NULL").agg(F.sum("members")).first()[0] or 1)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_small // BUCKET_MEMBERS))
    placed = members.join(whole, "group").withColumn("band", band).withColumn("salt", F.expr("pmod(xxhash64(id), coalesce(salts[band], 1))"))
    placed = placed.withColumn("more", F.expr("coalesce(salts[band + 1], 0)")).withColumn("less", F.expr("coalesce(salts[band - 1], 0)"))
    # a block meets itself (side 2), the other blocks of its band, and all blocks of the bands above and below; of two blocks the lower one is side 0
    own = F.expr("transform(sequence(0, salts[band] - 1), s -> struct(band AS b0, least(s, salt) AS s0, band AS b1, greatest(s, salt) AS s1, if(s = salt, 2, if(s < salt, 1, 0)) AS side))")
    up = F.expr("transform(slice(sequence(0, more), 1, more), s -> struct(band AS b0, salt AS s0, band + 1 AS b1, cast(s AS bigint) AS s1, 0 AS side))")
    down = F.expr("transform(slice(sequence(0, less), 1, less), s -> struct(band - 1 AS b0, cast(s AS bigint) AS s0, band AS b1, salt AS s1, 1 AS side))")
    one = F.expr("array(struct(0 AS b0, 0L AS s0, 0 AS b1, 0L AS s1, 2 AS side))")
    tiles = F.when(F.col("salts").isNull(), one).otherwise(F.concat(own, up, down))
    each = placed.withColumn("t", F.explode(tiles))
    key = F.xxhash64("group", "t.b0", "t.s0", "t.b1", "t.s1")
    bucket = F.when(F.col("salts").isNull(), F.pmod(F.xxhash64("group"), F.lit(n))).otherwise(key)
    return each.select(bucket.alias("bucket"), key.alias("tile"), F.col("t.side").cast("int").alias("side"), *[F.col(f"`{c}`") for c in members.columns if c not in ("group", "n")])


def verified(members: DataFrame, percent: float = 80, unpack: Callable = _numbers) -> tuple[DataFrame, DataFrame]:
    """The links of members(group, id, copies, n, shingles): edges (a, b) of a forest with the same components, and (id, links).

    unpack makes the sorted 64-bit elements of a set from its shingles. links counts the rows, copies included, whose sets lie within the similarity, other than the member's own copies.
    """
    found = assign(members).groupBy("bucket").applyInArrow(lambda t: _tile(t.drop_columns("bucket"), percent, unpack), "id bigint, other bigint, links bigint")
    found = materialise(found, "links")
    return found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")), found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))

