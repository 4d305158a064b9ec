"""Exact n-gram Jaccard join.

1. Every document becomes the set of its hashed 5-word shingles; equal sets are one class.
2. Two sets within the similarity share one of the first ``n - ceil(0.8 n) + 1`` shingles of any
   common order. The order is by document frequency, rare ones first, so prefixes consist of shingles that
   stand in one document for all but copies; documents whose prefixes meet form candidate groups.
3. Inside a group, size-banded tiles with hashed bitmaps find every link exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collisions import edges
from .common import batch, fresh, input_bytes, materialise, mix, read, shingle_sets, slices, text_columns
from .components import components
from .frequencies import prefixes
from .idfilter import bitmap, perhaps
from .tiles import verified

WIDTH = 5
PERCENT = 80


def set_hash(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row per row of docs.

    A document without words, or with a null text, has an empty set and no link; a row with a null doc_id takes no part in links and
    has a null component. Rows that repeat a doc_id are one document for its component. An empty table gives no row. docs should be read from files, as the
    stages of the pipeline are; write the result of a shuffle to a table first.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for lo, texts in slices(b.column("text")):
                for doc_id, s in zip(b.column("doc_id").slice(lo, len(texts)).to_pylist(), shingle_sets(texts, width)):
                    yield doc_id, s, *set_hash(s)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("keys")):
                k = np.frombuffer(raw.as_buffer(), np.uint64)
                yield mix(k), np.full(len(k), doc_id, np.int64)

    known = text_columns(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    n_items = input_bytes(docs, "text") // 6
    sets, met = prefixes(known, hashed, n_items, percent)
    sets = materialise(sets, "sets")
    classes = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "classes")
    groups = components(edges(met, keys, n_items // 20))
    # a set goes into its group by any of its documents that the prefixes have
    named = sets.select("doc_id", "n", "h1", "h2").join(groups, F.col("doc_id") == F.col("id")).groupBy("n", "h1", "h2").agg(F.min("component").alias("group"))
    chosen = classes.join(named, ["n", "h1", "h2"])
    several = chosen.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("group")
    chosen = materialise(chosen.join(several, "group"), "candidates")

    held = bitmap(chosen.select("id"))

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("shingles", pa.binary())])
        for b in batches:
            if not b.num_rows:
                continue
            b = b.filter(pa.array(perhaps(held.value, b.column("doc_id").to_numpy())))
            for lo, texts in slices(b.column("text")):
                found = list(shingle_sets(texts, width))
                yield batch(schema, b.column("doc_id").slice(lo, len(texts)), *zip(*map(set_hash, found)), [s.tobytes() for s in found])

    # of rows that repeat an id with another text, those of a wanted class alone find their match
    members = known.mapInArrow(with_sets, "id bigint, h1 bigint, h2 bigint, shingles binary").join(chosen, ["id", "h1", "h2"])
    members = materialise(members.select("group", "id", "copies", "n", "shingles"), "members")
    found, links = verified(members, percent)
    roots = components(found)
    classes = classes.join(roots, "id", "left").join(links, "id", "left").select("n", "h1", "h2", F.coalesce("component", "id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = sets.where("n > 0").join(classes, ["n", "h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in slices(b.column("text")):
                yield batch(pa.schema([("n", pa.int64())]), [len(s) for s in shingle_sets(texts, width)])

    none = F.lit(None).cast("bigint")
    nameless = docs.where("doc_id IS NULL").select("text").mapInArrow(sized, "n bigint").select(none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return own.unionByName(alone).unionByName(nameless)


def first_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, with one row of each component: that of the smallest id, of equal ids the first in the files.

    Every row is judged by its own text, under a number of its own: rows that repeat an id with another text stay unless they are linked
    with a row that stays, rows without an id take part and come after all others. Rows alike in id and text leave one. Texts without words stay. An
    empty table stays empty. docs should be read from files, which give a row the same number at every reading. A hashed bitmap tells most of the rows that stay
    without a join, so only rows that may go are looked at again.
    """
    number = fresh(docs, "row_number")
    rows = docs.withColumn(number, F.monotonically_increasing_id())
    found = linked(rows.select(F.col(number).alias("doc_id"), "text"), width, percent).where("n_links > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    # ids of the rows that have a link, and of each component the row that stays
    linked_rows = materialise(found, "linked")
    held = bitmap(linked_rows.select(F.col("row").alias("doc_id")))

    def perhaps_linked(wanted: bool):
        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    maybe = perhaps(held.value, b.column(number).to_numpy())
                    yield b.filter(pa.array(maybe == wanted))

        return chosen

    ids = materialise(rows.select(number, "doc_id").mapInArrow(perhaps_linked(True), f"{number} bigint, doc_id bigint").join(linked_rows, F.col(number) == F.col("row")), "ids")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    # a table, so that the rows of a large component are split in the join
    groups = materialise(ids.groupBy("group").agg(F.min_by("row", order).alias("first")), "firsts")
    # under the number's own name: docs may have any other
    gone = materialise(ids.join(groups, "group").where("row <> first").select(F.col("row").alias(number)), "gone")
    doubtful = rows.mapInArrow(perhaps_linked(True), rows.schema).join(gone, number, "left_anti").select(*rows.columns)
    return rows.mapInArrow(perhaps_linked(False), rows.schema).unionByName(doubtful).drop(number)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """linked() of all documents; an empty table gives no row, texts are compared whole."""
    return linked(read(spark, sf_dir, "documents"))


#: DuckDB, by the definition alone: shared shingles are counted for all pairs, and labels run along links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w),
c AS MATERIALIZED (SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, min(doc_id) AS id, count(*) AS copies, any_value(s) AS s, any_value(len(s)) AS n FROM s WHERE len(s) > 0 GROUP BY 1),
t AS MATERIALIZED (SELECT id, n, unnest(s) AS t FROM c),
p AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.t = b.t AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(id, root) AS (SELECT id, id FROM c UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id WHERE r.root < p.b),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
l AS (SELECT p.a AS id, sum(c.copies)::BIGINT AS n FROM p JOIN c ON c.id = p.b GROUP BY p.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id,
       coalesce(c.copies - 1, 0)::BIGINT + coalesce(l.n, 0) AS n_links
FROM s LEFT JOIN c ON len(s.s) > 0 AND c.k = md5(array_to_string(list_sort(s.s), chr(10))) LEFT JOIN m ON m.id = c.id LEFT JOIN l ON l.id = c.id
"""
