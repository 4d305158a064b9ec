"""Byte-pair training, encoding and decoding against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from conftest import SF

from foliant.operators import subwords
from foliant.plans import catalogue


def joined(parts, pair):
    out, k = [], 0
    while k < len(parts):
        n = 2 if tuple(parts[k : k + 2]) == pair else 1
        out.append("".join(parts[k : k + n]))
        k += n
    return out


def plain(words, vocabulary):
    """Counts everything anew for every merge."""
    tokens = list(subwords.BASE)
    for c in sorted({c for w in words for c in [*w, subwords.END]}):
        if len(tokens) < vocabulary and c not in tokens:
            tokens.append(c)
    now, merges = {w: [*w, subwords.END] for w in words}, []
    while len(tokens) < vocabulary:
        count = Counter()
        for w, parts in now.items():
            for p in zip(parts, parts[1:]):
                count[p] += words[w]
        if not count:
            break
        best, n = max(count.items(), key=lambda i: (i[1], i[0]))
        merges.append((*best, n))
        if best[0] + best[1] not in tokens:
            tokens.append(best[0] + best[1])
        now = {w: joined(parts, best) if best[0] in parts else parts for w, parts in now.items()}
    return tokens, merges


def cut(word, tokens, merges):
    rank = {(a, b): k for k, (a, b, _) in enumerate(merges)}
    parts = [*word, subwords.END]
    while len(parts) > 1:
        found = [(rank[p], p) for p in zip(parts, parts[1:]) if p in rank]
        if not found:
            break
        parts = joined(parts, min(found)[1])
    return [tokens.index(p) if p in tokens else subwords.UNKNOWN for p in parts]


WORDS = {"aaab": 3, "aaaa": 5, "abab": 4, "ab": 9, "b": 1, "aa": 2, "é漢": 7, "abcabc": 6, "cab": 6, "x" * 9: 4, "x" * 200: 1, "0": 5, "]": 2}


@pytest.mark.parametrize(("runs", "vocabulary"), [(20_000, 100), (9, 60), (9, 25), (9, 17)])
def test_merges_are_those_of_a_plain_trainer(spark, monkeypatch, runs, vocabulary):
    """Whatever the bound on runs, and so the number of rounds; with ties, repeated pairs and tokens that two merges give."""
    monkeypatch.setattr(subwords, "RUNS", runs)
    monkeypatch.setattr(subwords, "LEVELS", (4, 32))
    rng = random.Random(runs + vocabulary)
    words = WORDS | {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))): rng.randrange(1, 9) for _ in range(60)}
    types = spark.createDataFrame(list(words.items()), "word string, freq int").repartition(3)
    tokens, merges = subwords.learn(types, vocabulary)
    assert (tokens, merges) == plain(words, vocabulary)
    asked = [*words, "zzz", "aé", "", "[E12]"]
    found = subwords.encoded(spark.createDataFrame([(w,) for w in asked], "word string"), tokens, merges).collect()
    assert {r.word: r.ids for r in found} == {w: [5, 8, 9, 6] if w == "[E12]" else cut(w, tokens, merges) for w in asked}


def test_whole_vocabulary(spark, monkeypatch):
    """The words of a whole table, in several rounds."""
    monkeypatch.setattr(subwords, "RUNS", 500)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 10 = 0")
    types = subwords.word_types(docs)
    words = {r.word: r.freq for r in types.collect()}
    assert subwords.learn(types, 400) == plain(words, 400)


def test_pretokens(spark):
    text = "Éa1²3 [e12] [E٣] x_y!? ABC\xa0\x1c-\x85ß"
    found = spark.createDataFrame([(text,), (None,)], "text string").select(subwords.pretokens("text").alias("t")).collect()
    assert found[0].t == ["éa", "1", "²", "3", "[E12]", "[", "e", "٣", "]", "x", "y", "!", "?", "abc", "-", "ß"]
    assert found[1].t is None


def test_documents_come_back(spark):
    rows = [(1, "Hello, hello [e10] world 42"), (2, None), (3, ""), (4, "漢 unknown"), (5, "hello " * 50_000), (5, "hello"), (None, "world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens, merges = subwords.learn(subwords.word_types(docs.where("doc_id <> 4 or doc_id is null")), 60)
    found = subwords.encoded_documents(docs, tokens, merges).collect()
    back = {(r.doc_id, r.text) for r in found if r.doc_id != 4}
    assert back == {(1, "hello , hello [E10]world 42"), (2, ""), (3, ""), (5, ("hello " * 50_000).strip()), (5, "hello"), (None, "world")}
    assert subwords.UNKNOWN in next(r.ids for r in found if r.doc_id == 4)
    assert subwords.learn(subwords.word_types(docs.where("false")), 60) == (subwords.BASE, [])
    with pytest.raises(ValueError):
        subwords.learn(subwords.word_types(docs), 3)


def test_queries_agree(spark):
    """The registered queries: words and documents come back from their ids, and a document's ids are those of its words."""
    words = catalogue.QUERIES["bpe_encode"](spark, SF).collect()
    assert all(r.word == r.decoded for r in words)
    total = sum(r.freq * r.n_tokens for r in words)
    docs = catalogue.QUERIES["bpe_documents"](spark, SF).collect()
    markers = sum(len(re.findall(r"\[[eE][0-9]+\]", r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert all(r.intact and r.n_unknown == 0 for r in docs)
    assert markers or sum(r.n_tokens for r in docs) == total
