"""Cleaned passages, batch uncertainty and the closed cycle, against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from foliant.operators import answers, cycle, training


def plain_clean(s):
    """Rule by rule; leading marks until nothing changes."""
    s = re.sub(r"^[ \t\n\x0b\f\r]*>[ \t\n\x0b\f\r]*", "", s)
    while True:
        new = re.sub(r"^(?:\{[^}]*\}|[a-zA-Z0-9](?!\w)|[^\w \t\n\x0b\f\r])[ \t\n\x0b\f\r]*", "", s)
        if new == s:
            break
        s = new
    s = re.sub(r"(^|\W)(?:figure|figura|abbildung)\s+[0-9]+\.[0-9]+:?\s*", r"\1", s, flags=re.IGNORECASE)
    s = re.sub(r"(\w+)-\s+(\w+)", r"\1\2", s)
    s = re.sub(r"\[\s*[0-9]+(?:\s*,\s*[0-9]+)*\s*\]", "", s)
    s = re.sub(r"[�\x00-\x08\x0b\x0c\x0e-\x1f]", "", s)
    return re.sub(r"\s+", " ", s).strip(" ")


def test_clean_passages(spark):
    rng = random.Random(4)
    bits = ["{x}", "{", "}", ">", "a", "1", "ab", "é", "- ", "-", " ", "\n", "Figure 1.2: ", "figura 3.4", "[1, 2]", "[3]", "\x01", "�", "word", ".", "#", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["> > {a} {b} 1 . a text", "", "- " * 20_000 + "end", "# 1 " * 400 + "end", "{a} " * 400 + "end"]
    found = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", answers.clean_passage(F.col("text")).alias("t")).collect()
    for r in found:
        assert r.t == plain_clean(texts[r.k]), repr(texts[r.k][:80])
    assert spark.createDataFrame([(None,)], "text string").select(answers.clean_passage(F.col("text")).alias("t")).first().t is None


def test_batch_uncertainty(spark):
    rng = random.Random(5)
    docs = [(k, s, " ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(rng.randrange(1, 9)))) for s, n in (("nine", 9), ("five", 5), ("one", 1), ("two", 2)) for k in range(100 * n, 100 * n + n)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)
    from foliant.operators.terms import hashed_vectors

    vec = defaultdict(dict)
    for r in hashed_vectors(df, "doc_id").collect():
        vec[r.doc_id][r.bucket] = r.weight
    want = {}
    for source in {d[1] for d in docs}:
        ids = sorted(d[0] for d in docs if d[1] == source)
        for start in range(0, len(ids), 4):
            batch = ids[start : start + 4]
            others = ids[start - 1 : start] + batch if len(batch) == 1 and start else batch
            for d in batch:
                e = {o: math.exp(round(sum(w * vec[o].get(b, 0) for b, w in vec[d].items()), 6) / 0.07) for o in others if vec[d].keys() & vec[o].keys()}
                want[d] = round(1 - e[d] / sum(e.values()), 5)
    found = {r.doc_id: r.uncertainty for r in training.batch_uncertainty(df, 4).collect()}
    assert found.keys() == want.keys() and all(abs(found[d] - want[d]) < 2e-5 for d in want)
    assert found[508 - 4] >= 0 and training.batch_uncertainty(df.where("false"), 4).count() == 0


def test_closed_cycle(spark):
    rng = random.Random(6)
    found = [(k, rng.choice(["s", "t", None]), round(rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()]), 7)) for k in range(60)]
    state = {d: [source, score, score, 0] for d, source, score in found}
    want = []
    for n in (1, 2, 3, 4):
        rank = {d: round(max(0.0, max(r, 0) / (1 + max(r, 0)) - 0.1 * math.log1p(seen)), 6) for d, (_, _, r, seen) in state.items()}
        for source in {s[0] for s in state.values()}:
            best = sorted((d for d in state if state[d][0] == source), key=lambda d: (-rank[d], state[d][3], d))[:5]
            want += [(n, source, d, k, rank[d], state[d][3]) for k, d in enumerate(best, 1)]
            for d in best:
                state[d][2] = round(0.8 * state[d][2] + 0.2 * state[d][1], 10)
                state[d][3] += 1
    got = cycle.cycles(spark.createDataFrame(found, "doc_id long, source string, score double").repartition(3), 4, 5)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert cycle.cycles(spark.createDataFrame([], "doc_id long, source string, score double")).count() == 0
