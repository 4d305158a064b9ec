"""Paragraph deduplication by MinHash banding, whatever the lines of a text.

Words are compared with A-Z in lower case and single blanks. There are two kinds of paragraph:

``block``: a line of ``MIN_WORDS`` words or more, a run of shorter lines that together have as many, or a whole shorter text of ``WIDTH`` words or more. 30 permutations in
10 bands of three rows bring blocks of Jaccard similarity 0.8 together with probability 0.9992; those that meet form groups, in
which links are verified by the exact Jaccard of 5-word shingles. The connected components are the classes, of which the first
block (by doc_id, then by place) stays.

``passage``: the ``UNIT`` words that start where a window of ``PASSAGE`` words has its MinHash (the least of one permutation over
its 5-word shingles; of equal ones the first). Equal windows have equal minima, so one band of one row misses none: all ``PASSAGE``
words in a row that two documents share are found inside longer lines, over short lines, and at the ends of texts.
Units that meet are verified by all their words (a 64-bit hash), and neighbouring ones are joined to
one passage. So what is reported as a passage shares at least ``UNIT`` words in a row with another document.

What is out of reach: texts of fewer than ``WIDTH`` words; runs of short lines of fewer than ``MIN_WORDS`` words in longer texts, but for their part
in passages; and passages inside longer blocks whose edits leave no ``PASSAGE`` words in a row equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .collisions import NO_ID, edges, shared_keys
from .common import BASE, MODULUS, WORD, Words, batch, flat_shingles, fresh, input_bytes, materialise, mix, read, slices, text_columns
from .components import components
from .idfilter import bitmap, perhaps
from .tiles import verified

MIN_WORDS = 30
WIDTH = 5
PERCENT = 80
BANDS, ROWS = 10, 3
#: Words of a passage that is found wherever it stands, and of the units that are compared.
PASSAGE, UNIT = 50, 40
#: Bytes of the texts that are cut at a time.
AT_ONCE = 2_000_000

PARAGRAPHS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("paragraph", pa.int32()), ("id", pa.int64()), ("n_words", pa.int64()), ("n", pa.int64())])
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def blocks(w: Words, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word among all words of w, words) of every long line, of every run of shorter lines that together are long, and of shorter texts whole.

    >>> [x.tolist() for x in blocks(Words(["a b\\n\\nC d e\\nf\\ng h", "x"], lines=True), 3)]
    [[0, 0], [2, 5], [3, 3]]
    """
    long = w.lines >= min_words
    begins = np.concatenate([[True], (w.line_text[1:] != w.line_text[:-1]) | long[1:] | long[:-1]])[: len(long)]
    first = np.flatnonzero(begins)
    if not len(first):
        return first, first, first
    n = np.add.reduceat(w.lines, first)
    at, keep = np.cumsum(n) - n, (n >= min_words) | ((n >= WIDTH) & (n == w.counts[w.line_text[first]]))
    return w.line_text[first][keep], at[keep], n[keep]


def content_ids(w: Words, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words of each block."""
    if not len(at):
        return at
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    word = w.hashes[np.repeat(at, n) + place]
    parts = mix(word + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
    return mix(np.add.reduceat(parts, np.cumsum(n) - n) + n.astype(np.uint64)).view(np.int64)


def band_keys(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """BANDS keys for each set: hashes of the band number and of ROWS minima. n elements of flat each, one at least; repeats do not matter."""
    start = np.cumsum(n) - n
    out = np.empty((len(n), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(n), np.uint64(band + 1))
        for r in range(ROWS):
            x = flat * _SEEDS[band * ROWS + r]
            x ^= x >> np.uint64(32)
            key = mix(key ^ np.minimum.reduceat(x, start))
        out[:, band] = key
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): the rows of docs with a hash of their id and text, which rows that repeat both share; null texts are left out."""
    return text_columns(docs, "doc_id", "text").where("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, width: int = WIDTH) -> DataFrame:
    """(row, doc_id, paragraph, id, n_words, n): every block of every text and its first word's place; n is the size of its shingle list, repeats included."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in slices(b.column("text"), AT_ONCE):
                w = Words(texts, lines=True)
                text, at, n = blocks(w, min_words)
                if len(text):
                    own = pa.array(text + lo)
                    yield batch(PARAGRAPHS, b.column("row").take(own), b.column("doc_id").take(own), at - w.starts[text], content_ids(w, at, n), n, np.maximum(1, n - width + 1))

    return keyed(docs).mapInArrow(rows, "row bigint, doc_id bigint, paragraph int, id bigint, n_words bigint, n bigint")


def _shingles(w: Words, at: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of blocks one after the other, repeats included, and how many each has; a block has width words at least."""
    every, size = flat_shingles(w.hashes, width), n - width + 1
    return every[np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())], size


def _collisions(docs: DataFrame, n_keys: int, min_words: int, width: int) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for _, texts in slices(b.column("text"), AT_ONCE):
                w = Words(texts, lines=True)
                _, at, n = blocks(w, min_words)
                if len(at):
                    ids, one = np.unique(content_ids(w, at, n), return_index=True)
                    flat, size = _shingles(w, at[one], n[one], width)
                    yield band_keys(flat, size).ravel(), np.repeat(ids, BANDS)

    return edges(text_columns(docs, "text"), keys, n_keys)


def near_blocks(docs: DataFrame, min_words: int = MIN_WORDS, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(row, doc_id, first_word, n_words, first_doc_id, removed): every block whose class holds more than one.

    Documents without a repeated block do not appear, null and empty texts and an empty table give none. removed is false for the first
    block of a class alone, and in rows that repeat its id and text; a null doc_id comes before all others.
    """
    all_of = materialise(paragraphs(docs, min_words, width), "paragraphs")
    first = F.min(F.struct("doc_id", "paragraph", "row"))
    contents = all_of.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), first.alias("first"))
    n_keys = BANDS * contents.count()
    groups = components(_collisions(docs, n_keys, min_words, width))
    chosen = contents.join(groups, "id").select(F.col("component").alias("group"), "id", "copies", "n", "first.row", "first.paragraph")
    chosen = materialise(chosen, "candidates")
    # one occurrence of each candidate gives its words: gathered by row, so that a text is read once
    wanted = chosen.groupBy("row").agg(F.collect_list(F.struct("paragraph", "group", "id", "copies", "n")).alias("wanted"))

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("group", pa.int64()), ("id", pa.int64()), ("copies", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])
        for b in batches:
            for lo, texts in slices(b.column("text"), AT_ONCE):
                w = Words(texts)
                every, out = flat_shingles(w.hashes, width), []
                for start, want in zip(w.starts.tolist(), b.column("wanted").slice(lo, len(texts)).to_pylist()):
                    for x in want:
                        at = start + x["paragraph"]
                        s = np.unique(every[at : at + x["n"]])
                        out.append((x["group"], x["id"], x["copies"], len(s), s.tobytes()))
                if out:
                    yield batch(schema, *zip(*out))

    members = keyed(docs).join(wanted, "row").select("text", "wanted").mapInArrow(with_sets, "group bigint, id bigint, copies bigint, n bigint, shingles binary")
    found, _ = verified(materialise(members, "members"), percent)
    roots = components(found)
    classed = contents.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("class_id"), "copies", "first")
    whole = classed.groupBy("class_id").agg(F.sum("copies").alias("copies"), F.min("first").alias("first")).where("copies > 1")
    ids = materialise(classed.select("id", "class_id").join(whole.select("class_id", "first"), "class_id"), "classes")
    where = F.struct("doc_id", "paragraph", "row")
    return all_of.join(ids, "id").select("row", "doc_id", F.col("paragraph").alias("first_word"), "n_words", F.col("first.doc_id").alias("first_doc_id"), (~where.eqNullSafe(F.col("first"))).alias("removed"))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on, by doubling."""
    out, done, power, size = None, 0, hashes, 1
    join = lambda a, b: mix(a[: len(b)] * np.uint64(0x9E3779B97F4A7C15) + b)
    while True:
        if n & size:
            out = power if out is None else join(out, power[done:])
            done += size
        if done == n or len(power) <= size:
            return out if done == n else hashes[:0]
        power, size = join(power, power[size:]), 2 * size


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each place on, by doubling."""
    size = 1
    while 2 * size <= n:
        values, size = np.minimum(values[: len(values) - size], values[size:]), 2 * size
    rest = n - size
    return np.minimum(values[: len(values) - rest], values[rest:])


def units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the text, hash) of the units of every text of PASSAGE words or more; w has short hashes.

    >>> len(units(Words(["a b c", "w " * 60], short=True))[0]) > 0
    True
    """
    held = np.flatnonzero(w.counts >= PASSAGE)
    if not len(held):
        return held, held, held
    value = w.short[: len(w.short) - WIDTH + 1]
    for k in range(1, WIDTH):
        value = (value * np.uint64(BASE) + w.short[k : len(w.short) - WIDTH + 1 + k]) % np.uint64(MODULUS)
    # value and place in one number: the least one is the first of the least values
    placed = (value.astype(np.int64) << 32) + np.arange(len(value))
    chosen = least_of(placed, PASSAGE - UNIT + 1) & 0xFFFFFFFF
    n = w.counts[held] - PASSAGE + 1
    text = np.repeat(held, n)
    at = chosen[np.arange(n.sum()) + np.repeat(w.starts[held] - np.cumsum(n) + n, n)]
    new = np.concatenate([[True], at[1:] != at[:-1]])  # a later window never has an earlier least
    text, at = text[new], at[new]
    return text, at - w.starts[text], grams(w.hashes, UNIT).view(np.int64)[at]


UNITS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("units", pa.binary()), ("places", pa.binary())])


def text_units(docs: DataFrame) -> DataFrame:
    """(row, doc_id, units, places): the units of every text that has one, packed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in slices(b.column("text"), AT_ONCE):
                text, at, unit = units(Words(texts, short=True))
                if len(text):
                    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                    own = pa.array(text[first] + lo)
                    parts = [[x.tobytes() for x in np.split(v, first[1:])] for v in (unit, at.astype("<i4"))]
                    yield batch(UNITS, b.column("row").take(own), b.column("doc_id").take(own), *parts)

    return keyed(docs).mapInArrow(rows, "row bigint, doc_id bigint, units binary, places binary")


def passages(docs: DataFrame) -> DataFrame:
    """(row, doc_id, first_word, n_words, first_doc_id): every run of units that stand in two documents, with one smallest document.

    Any PASSAGE words in a row that two documents share lead to a unit in both. first_doc_id is the smallest id that holds the units of the
    run. A document is an id: rows that repeat one are no other document, a null doc_id comes before all others. Null and empty texts and an empty
    table give none. A hashed bitmap keeps most units of one document from the join.
    """
    rows = materialise(text_units(docs), "units")
    shared = materialise(shared_keys(rows, input_bytes(rows, "units") // 8).select(F.col("key").alias("unit"), "first"), "shared")
    held = bitmap(shared.select("unit"))
    schema = pa.schema([("unit", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.divide(pc.binary_length(b.column("units")), 8).to_numpy()
            if size.sum():
                unit, at = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in b.column(c)]) for c, kind in (("units", np.int64), ("places", "<i4")))
                keep = perhaps(held.value, unit)
                own = pa.array(np.repeat(np.arange(b.num_rows), size)[keep])
                yield batch(schema, unit[keep], b.column("row").take(own), b.column("doc_id").take(own), at[keep])

    order = Window.partitionBy("row", "first").orderBy("at")
    begins = F.col("at") > F.coalesce(F.lag("at").over(order), F.lit(-UNIT - 1)) + UNIT
    runs = rows.mapInArrow(candidates, "unit bigint, row bigint, doc_id bigint, at int").join(shared, "unit").withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order))
    each = runs.groupBy("row", "first", "run").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("first_word"), F.max("at").alias("last"))
    return each.select("row", "doc_id", "first_word", (F.col("last") - F.col("first_word") + UNIT).cast("bigint").alias("n_words"), F.nullif("first", F.lit(NO_ID)).alias("first_doc_id"))


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(row, kind, doc_id, first_word, n_words, first_doc_id, removed): the blocks and the passages that repeat.

    first_word counts the words of the whole text from 0. A passage may overlap a block. The first of a class is there too, with removed
    false. Of rows that repeat an id and a text, each block counts for itself and passages once.
    """
    near = near_blocks(docs, min_words, width, percent).withColumn("kind", F.lit("block"))
    equal = passages(docs).select("*", (~F.col("doc_id").eqNullSafe(F.col("first_doc_id"))).alias("removed"), F.lit("passage").alias("kind"))
    return near.unionByName(equal)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs with the words of their removed paragraphs taken out of text, each word with the blanks before it.

    Texts without a removed paragraph, and the other columns, stay as they are; so do null and empty texts and an empty table. Rows that repeat an id and a text
    lose the same words.
    """
    key, gone = fresh(docs, "gone_row"), fresh(docs, "gone")
    marks = repeated(docs, min_words, width, percent).where("removed").groupBy(F.col("row").alias(key)).agg(F.collect_set(F.struct("first_word", "n_words")).alias(gone))
    joined = docs.withColumn(key + "_of", F.xxhash64("doc_id", "text")).join(marks, F.col(key + "_of") == F.col(key), "left").drop(key, key + "_of")
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, ranges in zip(b.column("text"), b.column(gone)):
                text, taken = t.as_py(), ranges.as_py()
                if text is not None and taken:
                    drop = {k for r in taken for k in range(r["first_word"], r["first_word"] + r["n_words"])}
                    out, end = [], 0
                    for k, m in enumerate(WORD.finditer(text)):
                        if k not in drop:
                            out.append(text[end : m.end()])
                        end = m.end()
                    text = "".join([*out, text[end:]])
                texts.append(text)
            at = b.schema.names.index("text")
            kept = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield kept.drop_columns([gone])

    return joined.mapInArrow(cut, schema)


def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated paragraph of every whole text, wherever it stands: (kind, doc_id, first_word, n_words, first_doc_id, removed)."""
    return repeated(read(spark, sf_dir, "documents")).drop("row")


def _sql() -> str:
    """DuckDB, by the definitions: all pairs of blocks that share a shingle, not banded; units where the least shingle value stands."""
    value = "h0"
    for k in range(1, WIDTH):
        value = f"(({value}) * {BASE} + h{k}) % {MODULUS}"
    ahead = ", ".join(f"lead(h, {k}) OVER o AS h{k}" for k in range(1, WIDTH))
    return rf"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents),
y AS MATERIALIZED (SELECT doc_id, k, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
x AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
             sum(CASE WHEN len(w) >= {MIN_WORDS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS n_long, sum(len(w)) OVER (PARTITION BY doc_id) AS total FROM y),
w AS MATERIALIZED (SELECT doc_id, min(pos)::INT AS paragraph, flatten(list(w ORDER BY k)) AS w FROM x GROUP BY doc_id, n_long, len(w) >= {MIN_WORDS} HAVING sum(len(w)) >= {MIN_WORDS} OR (sum(len(w)) >= {WIDTH} AND sum(len(w)) = max(total))),
c AS MATERIALIZED (SELECT array_to_string(w, ' ') AS id, any_value(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w GROUP BY 1),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS k FROM c),
t AS MATERIALIZED (SELECT k, len(s) AS n, unnest(s) AS t FROM n),
p AS MATERIALIZED (
  SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.t = b.t AND a.k <> b.k
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
r(k, root) AS (SELECT k, k FROM n UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.k WHERE r.root < p.b),
m AS (SELECT k, min(root) AS root FROM r GROUP BY k),
o AS (SELECT w.doc_id, w.paragraph, len(w.w)::BIGINT AS n_words, m.root FROM w JOIN n ON n.id = array_to_string(w.w, ' ') JOIN m ON m.k = n.k),
f AS (SELECT *, count(*) OVER (PARTITION BY root) AS size, first_value(doc_id) OVER (PARTITION BY root ORDER BY doc_id, paragraph) AS first_doc_id,
             row_number() OVER (PARTITION BY root ORDER BY doc_id, paragraph) AS k FROM o),
d AS MATERIALIZED (SELECT doc_id, flatten(list(w ORDER BY k)) AS w FROM y GROUP BY doc_id HAVING sum(len(w)) >= {PASSAGE}),
b AS MATERIALIZED (SELECT DISTINCT unnest(w) AS word FROM d),
s AS MATERIALIZED (SELECT word, list_reduce(list_prepend(0, list_reverse(list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT))), lambda x, y: (x * {BASE} + y) % {MODULUS}) AS h FROM b),
i AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
h AS (SELECT doc_id, i, h FROM i JOIN s USING (word)),
v AS (SELECT doc_id, i, h AS h0, {ahead} FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, min(({value}) * 4294967296 + i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {PASSAGE - UNIT} FOLLOWING) AS least FROM v),
q AS (SELECT DISTINCT g.doc_id, g.least % 4294967296 AS pos FROM g JOIN d ON d.doc_id = g.doc_id WHERE g.i <= len(d.w) - {PASSAGE}),
u AS MATERIALIZED (SELECT q.doc_id, q.pos, array_to_string(d.w[q.pos + 1:q.pos + {UNIT}], ' ') AS unit FROM q JOIN d USING (doc_id)),
z AS (SELECT unit, min(doc_id) AS first FROM u GROUP BY unit HAVING min(doc_id) <> max(doc_id)),
e AS (SELECT doc_id, pos, first, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id, first ORDER BY pos), -{UNIT + 1}) + {UNIT} AS begins FROM u JOIN z USING (unit)),
j AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id, first ORDER BY pos) AS run FROM e)
SELECT 'block' AS kind, doc_id, paragraph AS first_word, n_words, first_doc_id, k > 1 AS removed FROM f WHERE size > 1
UNION ALL
SELECT 'passage', doc_id, min(pos)::INT, (max(pos) - min(pos) + {UNIT})::BIGINT, first, doc_id <> first FROM j GROUP BY doc_id, first, run
"""


SQL = _sql()
