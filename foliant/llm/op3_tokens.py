"""Token counts without token ids.

Each distinct pre-token is cut into pieces once. The per-document frequencies then meet those
counts: the most frequent pre-tokens (at most ``HEAD`` of at most ``HEAD_CHARS`` characters, a
fixed bound) by a broadcast table inside the scan, all others by a join on the pre-token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, materialise, read, text_columns
from .pretokens import byte_pretokens, tokenizer

TOKENIZER = "byte_bpe_50k.json"
HEAD = 262_144
HEAD_CHARS = 48
LIMIT = 512
#: Distinct pre-tokens that a task holds before it passes its counts on.
HELD = 300_000

TIMES = pa.schema([("pretoken", pa.string()), ("times", pa.int64())])
PIECES = pa.schema([*TIMES, ("pieces", pa.int32())])
PARTS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_bytes", pa.int64()), ("copies", pa.int64()), ("known", pa.int64()), ("pretoken", pa.string()), ("times", pa.int64())])


def vocabulary(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """(pretoken, times, pieces): every distinct pre-token of the corpus, cut once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for t in b.column("text"):
                held.update(byte_pretokens(t.as_py() or "", name)[0])
                if len(held) > HELD:
                    yield batch(TIMES, list(held), list(held.values()))
                    held.clear()
        yield batch(TIMES, list(held), list(held.values()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokenizer(name)
        for b in batches:
            found = library.encode_batch_fast(b.column("pretoken").to_pylist(), add_special_tokens=False)
            yield batch(PIECES, b.column("pretoken"), b.column("times"), [len(x) for x in found])

    times = text_columns(docs, "text").mapInArrow(counted, "pretoken string, times bigint").groupBy("pretoken").agg(F.sum("times").alias("times"))
    return times.mapInArrow(cut, "pretoken string, times bigint, pieces int")


def frequent(pieces: DataFrame, head: int) -> dict[str, int]:
    """The pieces of the most frequent pre-tokens, at most head of them; only they and one row per frequency class reach the driver."""
    short = pieces.where(F.length("pretoken") <= HEAD_CHARS).withColumn("rate", F.floor(8 * F.log2("times")).cast("int"))
    least, room = None, head
    for r in sorted(short.groupBy("rate").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if (room := room - r.n) < 0:
            break
        least = r.rate
    if least is None:
        return {}
    found = short.where(F.col("rate") >= least).select("pretoken", "pieces").toArrow()
    return dict(zip(found["pretoken"].to_pylist(), found["pieces"].to_pylist()))


def token_counts(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of docs; a null text is empty and has no token, repeated rows count each, an empty table gives no row."""
    spark = docs.sparkSession
    pieces = materialise(vocabulary(docs, name), "pieces")
    known = spark.sparkContext.broadcast(frequent(pieces, head))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = known.value
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])

            def put(*values) -> None:
                for column, v in zip(rows, values):
                    column.append(v)

            for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = t.as_py() or ""
                raw = text.encode("utf-8")
                key = xxhash.xxh3_64_intdigest(raw) - 2**63
                found, total = byte_pretokens(text, name)
                for p, n in Counter(found).items():
                    cut = lookup.get(p)
                    if cut is None:
                        put(doc_id, key, 0, 0, 0, p, n)
                    else:
                        total += cut * n
                put(doc_id, key, len(raw), 1, total, None, 0)
                if len(rows[0]) > 50_000:
                    yield batch(PARTS, *rows)
                    for column in rows:
                        column.clear()
            yield batch(PARTS, *rows)

    found = text_columns(docs, "doc_id", "text").mapInArrow(parts, "doc_id bigint, text_key bigint, n_bytes bigint, copies bigint, known bigint, pretoken string, times bigint")
    found = materialise(found, "pretokens")
    rare = found.where("pretoken IS NOT NULL").select("doc_id", "text_key", "pretoken", F.col("times").alias("n"))
    rare = rare.join(pieces.select("pretoken", "pieces"), "pretoken").groupBy("doc_id", "text_key").agg(F.sum(F.col("n") * F.col("pieces")).alias("known"))
    zero = F.lit(0).cast("bigint")
    both = found.where("pretoken IS NULL").select("doc_id", "text_key", "n_bytes", "copies", "known").unionByName(rare.select("doc_id", "text_key", zero.alias("n_bytes"), zero.alias("copies"), "known"))
    # repeated rows of one doc_id and text have put their counts together; each gets its share back
    totals = both.groupBy("doc_id", "text_key").agg(F.max("n_bytes").alias("n_bytes"), F.sum("copies").alias("copies"), F.sum("known").alias("known"))
    n = F.expr("known div copies")
    return totals.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts() of all documents: one row per row, repeated ones included; a null text is empty, an empty table gives no row, texts are counted whole."""
    return token_counts(read(spark, sf_dir, "documents"))
