"""Content, style and rhetoric of texts side by side: all counts of a text are made in its row, and the search among them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import linguistics, packed
from .linguistics import CONNECTIVES, ROLES
from .terms import WIDTH
from .vectors import FOUND, QUERY_BLOCK, QUERY_EVERY, WEIGHTS, _best

#: Queries and rows of a block: rows are copied once for every block of queries. A small table has blocks of fewer rows, LEAST or more, so that all cores have some.
ASKED, HELD, LEAST = 32_768, 65_536, 4096
#: What is counted beside the buckets of content.
SUMS = ["n_tokens", "n_types", "squares", "hapax", "chars", "words", "m", *CONNECTIVES, *ROLES]
#: Style and rhetoric have five digits.
SIZES, UNIT = (WIDTH, 32, 16), 100_000
PHRASES = [p.split() for cues in (CONNECTIVES, ROLES) for phrases in cues.values() for p in phrases]
CUES = [name for cues in (CONNECTIVES, ROLES) for name, phrases in cues.items() for _ in phrases]


@cache
def _table(pattern: str) -> np.ndarray:
    """Which code points a pattern of one character takes."""
    return np.array([re.match(pattern, chr(c)) is not None for c in range(0x110000)])


def _content(told: pa.DictionaryArray, row: np.ndarray, n: int) -> np.ndarray:
    """The tokens of every text by hashed buckets."""
    bucket = np.array([int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "little") % WIDTH for t in told.dictionary.to_pylist()], np.int64)
    return np.bincount(row * WIDTH + bucket[told.indices.to_numpy()], minlength=n * WIDTH).reshape(n, WIDTH)


def _cues(told: pa.DictionaryArray, row: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """How often the phrases of every category stand in each text: tokens beside each other."""
    words = sorted({w for p in PHRASES for w in p})
    own = pc.index_in(told.dictionary, value_set=pa.array(words)).fill_null(-1).to_numpy()[told.indices.to_numpy()]
    some = np.flatnonzero(own >= 0)
    own, row = np.concatenate([own, [-1, -1]]), np.concatenate([row, [-1, -1]])
    out = {name: np.zeros(n, np.int64) for name in CUES}
    for name, phrase in zip(CUES, PHRASES):
        at = some[own[some] == words.index(phrase[0])]
        for k, w in enumerate(phrase[1:], 1):
            at = at[(own[at + k] == words.index(w)) & (row[at + k] == row[at])]
        out[name] += np.bincount(row[at], minlength=n)
    return out


def _richness(texts: pa.Array) -> dict[str, np.ndarray]:
    """The sums of the lexical profile."""
    found, sizes = packed.tokens(texts, _table(T.PROFILE_TOKEN.removesuffix("+")))
    n, row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    told = found.dictionary_encode()
    length = pc.utf8_length(told.dictionary).to_numpy().astype(np.int64)
    lower = pc.utf8_lower(told.dictionary).dictionary_encode().indices.to_numpy().astype(np.int64)
    at = told.indices.to_numpy()
    key = np.sort(row * (len(lower) + 1) + lower[at])
    cut = packed.starts(key)
    c, of = np.diff(cut, append=len(key)), key[cut] // (len(lower) + 1)
    whole = lambda weights: np.bincount(of, weights, n).astype(np.int64)
    return {"n_tokens": sizes, "n_types": np.bincount(of, minlength=n), "squares": whole(c * c), "hapax": whole(c == 1), "chars": np.bincount(row, length[at], n).astype(np.int64)}


def counted(docs: DataFrame) -> DataFrame:
    """docs with its text replaced by content (hashed buckets of tokens) and SUMS; cues of a null text are null."""
    names, kinds = zip(*docs.drop("text").dtypes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, n = b["text"], b.num_rows
            found, sizes = packed.tokens(b["low"])
            told, row = found.dictionary_encode(), np.repeat(np.arange(n), sizes)
            sums = _richness(text) | {"words": np.maximum(packed.tokens(text, _table(r"[^ \t\n\x0b\f\r]"))[1], 1), "m": packed.characters(text, _table(linguistics.SYMBOLS))} | _cues(told, row, n)
            content = pa.FixedSizeListArray.from_arrays(pa.array(_content(told, row, n).ravel().astype(np.int32)), WIDTH).cast(pa.list_(pa.int32()))
            none = pc.is_null(text).to_numpy(zero_copy_only=False)
            told_of = {c: pa.array(sums[c].astype(np.int64), mask=none if c in (*CONNECTIVES, *ROLES, "words", "m") else None) for c in SUMS}
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), content, *told_of.values()], names=[*names, "content", *SUMS])

    ddl = [f"{c} {t}" for c, t in (*zip(names, kinds), ("content", "array<int>"), *((c, "bigint") for c in SUMS))]
    return docs.withColumn("low", F.lower("text")).mapInArrow(of, ", ".join(ddl))


def profiles(docs: DataFrame) -> DataFrame:
    """(vec_id, content, style, rhetoric): counts in hashed buckets, and normalised features in units of a hundred-thousandth."""
    own = [F.regexp_count("text", F.lit(p)).cast("bigint").alias(c) for c, p in (("n_acronyms", linguistics.ACRONYM), ("n_technical", linguistics.TECHNICAL))]
    rows = counted(linguistics.syntactic(docs.select("doc_id", "text", *own), ("doc_id", "text", "n_acronyms", "n_technical")))
    rows = rows.where("doc_id IS NOT NULL")
    for step, made in ((linguistics.richness, ["n_tokens", "n_types", "n_acronyms", "n_technical"]), (linguistics.connected, list(CONNECTIVES))):
        rows = step(rows, [c for c in rows.columns if c not in made])
    rows = linguistics.styled(rows, ["doc_id", "content", "m", *ROLES])
    roles = [F.col(r).cast("double").alias(r) for r in ROLES]
    rows = linguistics.directed(linguistics.shares(rows.select("doc_id", "content", "style", "m", *roles), ["doc_id", "content", "style"]), ["doc_id", "content", "style"])
    whole = lambda c: F.transform(c, lambda x: F.round(x * UNIT).cast("int"))
    return rows.select(F.col("doc_id").alias("vec_id"), "content", whole("style").alias("style"), whole("rhetoric").alias("rhetoric"))


def _vectors(whole: np.ndarray) -> np.ndarray:
    """One vector for each row of whole numbers, each part times the root of its weight, so that one product adds up all three."""
    content, style, rhetoric = np.split(whole.astype(np.float64), np.cumsum(SIZES)[:-1], axis=1)
    norm = np.sqrt((content * content).sum(1, keepdims=True))
    parts = (np.divide(content, norm, out=np.zeros_like(content), where=norm > 0), style / UNIT, rhetoric / UNIT)
    return np.concatenate([p * w**0.5 for p, w in zip(parts, WEIGHTS)], axis=1)


def search(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of every pair of a block of queries and a block of rows of profiles() the k best of each query. Rows go to the blocks packed, as whole numbers."""
    sizes = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % QUERY_EVERY == 0)).first()
    held = min(HELD, max(LEAST, sizes[0] // (2 * rows.sparkSession.sparkContext.defaultParallelism)))
    n_v, n_q = max(1, -(-sizes[0] // held)), max(1, -(-sizes[1] // ASKED))
    width = sum(SIZES)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["vec_id"].to_numpy()
            whole = np.concatenate([b[c].flatten().to_numpy().reshape(len(ids), -1) for c in ("content", "style", "rhetoric")], axis=1)
            block = packed.mixed(ids.astype(np.uint64))
            asked = np.flatnonzero(ids % QUERY_EVERY == 0)
            for kind, some, n, other in ((0, asked, n_q, n_v), (1, np.arange(len(ids)), n_v, n_q)):
                made = packed.blocks(kind, block[some] % n, ids[some], whole[some].T.astype(np.uint64)).to_pylist()
                pair = lambda own, x: own * n_v + x if kind == 0 else x * n_v + own
                yield from (pa.RecordBatch.from_pylist([r | {"bucket": pair(r["bucket"], x)} for x in range(other)], schema=packed.BLOCK) for r in made)

    def best(t: pa.Table) -> pa.Table:
        (asked, q), (ids, v) = (packed.opened([r for r in t.to_pylist() if r["kind"] == kind], width) for kind in (0, 1))
        if not len(asked) or not len(ids):
            return FOUND.empty_table()
        q, v = _vectors(q.T), _vectors(v.T)
        return pa.concat_tables([_best(q[lo : lo + QUERY_BLOCK], v, k, asked[lo : lo + QUERY_BLOCK], ids) for lo in range(0, len(q), QUERY_BLOCK)])

    # a task for every pair of blocks, however few bytes they have
    return rows.mapInArrow(dealt, packed.BLOCK_DDL).repartition(n_v * n_q, "bucket").groupBy("bucket").applyInArrow(best, "query_id bigint, vec_id bigint, score double")

