"""Saving, checking and loading a corpus."""

from __future__ import annotations

import glob
import gzip
import hashlib
import os
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from foliant.operators import digests
from foliant.sources import store


@pytest.fixture
def chunks(spark):
    rows = [(d, k, "s", f"text {d} {k}") for d in ("a", "b") for k in range(3)]
    df = spark.createDataFrame(rows, "document_id string, ordinal int, section string, text string")
    return df.withColumn("chunk_id", store.chunk_identity())


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_generations(spark, chunks, tmp_path):
    corpus = store.Corpus(spark, str(tmp_path))
    assert corpus.replace(chunks) == 1 and rows(corpus.read()) == rows(chunks)
    new = chunks.where("document_id = 'a' AND ordinal = 0").withColumn("text", F.lit("other words here")).withColumn("chunk_id", store.chunk_identity())
    assert corpus.put(new) == 2
    assert rows(corpus.read()) == rows(chunks.where("document_id = 'b'").union(new))
    assert corpus.remove(spark.createDataFrame([("b",)], "document_id string")) == 3
    assert rows(corpus.read()) == rows(new) and rows(corpus.read(1)) == rows(chunks)
    assert corpus.entry()["aggregate"] == {"documents": 1, "chunks": 1, "words": 3}
    with pytest.raises(KeyError):
        corpus.remove(spark.createDataFrame([("b",)], "document_id string"))
    with pytest.raises(ValueError, match="repeated"):
        corpus.put(new.union(new))
    assert corpus.replace(chunks.where("false")) == 4 and corpus.read().count() == 0
    assert corpus.put(chunks) == 5 and corpus.entry()["digest"] == corpus.entry(1)["digest"]
    with pytest.raises(store.ConcurrentUpdate):
        corpus.put(new, expected=3)


def test_two_writers(spark, chunks, tmp_path):
    """Both saw the same generation: one publishes, the other fails, and the corpus is the winner's."""
    store.Corpus(spark, str(tmp_path)).replace(chunks)
    lots = [chunks.where(f"document_id = '{d}'") for d in "ab"]

    def attempt(part):
        try:
            return store.Corpus(spark, str(tmp_path)).replace(part, expected=1)
        except store.ConcurrentUpdate:
            return None

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(attempt, lots))
    assert sorted(got, key=str) == [2, None]
    corpus = store.Corpus(spark, str(tmp_path))
    assert corpus.head() == 2 and rows(corpus.read()) == rows(lots[got.index(2)])


def rewritten(pattern, change):
    """Changes the first file of pattern that holds something; its checksum goes. What it returns puts the file back."""
    opened = lambda path, mode: gzip.open(path, mode) if path.endswith(".gz") else open(path, mode)
    path = next(p for p in sorted(glob.glob(pattern)) if opened(p, "rt").read())
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)

    def put(text):
        with opened(path, "wt") as f:
            f.write(text)

    text = opened(path, "rt").read()
    put(change(text))
    return lambda: put(text)


def test_tampering_is_found(spark, chunks, tmp_path):
    corpus = store.Corpus(spark, str(tmp_path))
    corpus.replace(chunks)
    data, listed = f"{tmp_path}/data/*/chunks/bucket=*/part-*", f"{tmp_path}/data/*/listed/bucket=*/part-*"

    def found():
        return {r.fault for r in corpus.faults().collect()}

    assert found() == set()
    for pattern, change, want in (
        (data, lambda t: t.replace(':"text', ':"test', 1), {"identity"}),
        (data, lambda t: t.split("\n", 1)[1], {"chunks", "bucket"}),
        (data, lambda t: t + t.split("\n", 1)[0] + "\n", {"repeated id", "repeated place", "chunks", "bucket"}),
        (data, lambda t: "", {"missing", "bucket"}),
        (listed, lambda t: "", {"unlisted"}),
        (listed, lambda t: t.replace('"words":9', '"words":8'), {"words"}),
        (listed, lambda t: re.sub('"digest":"..', '"digest":"zz', t), {"digest"}),
        (listed, lambda t: re.sub('"document_id":"."', '"document_id":"zz"', t), {"missing", "unlisted"}),
    ):
        back = rewritten(pattern, change)
        assert found() == want
        with pytest.raises(ValueError):
            corpus.read()
        back()
    assert found() == set()
    for change, match in ((lambda t: t.replace('"chunks": 6', '"chunks": 7'), "aggregate"), (lambda t: t.replace('"action": "replace", ', ""), "fields"), (lambda t: t.replace('"version": 3', '"version": 1'), "version"), (lambda t: t.replace('"number": 1', '"number": 2'), "names itself"), (lambda t: t.replace('"parent": "e3', '"parent": "e4'), "before")):
        back = rewritten(f"{tmp_path}/log/*.json", change)
        with pytest.raises(ValueError, match=match):
            corpus.entry()
        back()
    assert corpus.read().count() == 6


def test_faults(chunks):
    assert store.faults(chunks).count() == 0
    assert {r.fault for r in store.faults(chunks.union(chunks.limit(1))).collect()} == {"repeated id", "repeated place"}
    assert {r.fault for r in store.faults(chunks.withColumn("section", F.lit("t"))).collect()} == {"identity"}


def test_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.Corpus(spark, str(tmp_path)).read()


def test_tree_is_a_plain_fold(spark):
    """The root equals a fold in Python over the same records; a change is found by going down."""
    records = [(d, k, hashlib.sha256(f"{d}{k}".encode()).hexdigest()) for d in range(40) for k in range(1 + d % 3)] + [(50, k, "x") for k in range(3000)] + [(None, 1, "y"), (51, 7, "tie"), (51, 7, "tie"), (51, 7, "else"), (52, 0, None)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def fold(records):
        docs = {}
        for d in {r[0] for r in records} - {None}:
            own = sorted((k, x or "") for e, k, x in records if e == d)
            parts = {}
            for k, x in own:
                parts.setdefault(k // digests.RANGE, []).append(f"{k}:{x}")
            docs[sha(str(d))] = sha("\n".join(f"{p}:{sha(chr(10).join(lines))}" for p, lines in sorted(parts.items())))
        for level in digests.LEVELS:
            up = {}
            for place, digest in sorted(docs.items()):
                up.setdefault(place[:level], []).append(f"{place}:{digest}")
            docs = {p: sha("\n".join(lines)) for p, lines in up.items()}
        return docs

    def made(records):
        df = spark.createDataFrame(records, "doc_id long, ordinal int, digest string").repartition(3)
        return digests.tree(digests.document_digests(df, "doc_id", "ordinal", "digest"), "doc_id")

    before = made(records)
    assert {r.prefix: r.digest for r in before.where("level = 0").collect()} == fold(records)
    other = [r for r in records if r[0] != 3] + [(99, 0, "new")]
    found = {(r.level, r.prefix, r.state) for r in digests.changed(before, made(other)).collect()}
    assert {x for x in found if x[0] == 8} == {(8, sha("3")[:8], "removed"), (8, sha("99")[:8], "added")}
    assert (0, "", "changed") in found and digests.changed(before, made(records[::-1])).count() == 0
    assert made([]).count() == 0 and {r.state for r in digests.changed(made([]), before).collect()} == {"added"}


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])], "vec_id long, label int, embedding array<float>")
    store.save_vectors(df, str(tmp_path / "v"))
    assert store.load_vectors(spark, str(tmp_path / "v"), 2).count() == 2
    with pytest.raises(ValueError):
        store.load_vectors(spark, str(tmp_path / "v"), 3)
    new = spark.createDataFrame([(2, 5, [1.0, 0.0]), (3, 5, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    assert sorted((r.vec_id, r.label) for r in store.upsert(df, new, "vec_id").collect()) == [(1, 0), (2, 5), (3, 5)]
    with pytest.raises(Exception, match="twice"):
        store.upsert(df, new.union(new), "vec_id").collect()
