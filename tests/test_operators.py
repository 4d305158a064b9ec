"""Small cases with known answers."""

from __future__ import annotations

import re
from datetime import datetime

import numpy as np
import oracle
import pytest
from conftest import SF
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.html import markdown_tables
from foliant.operators import answers, corpus, curiosity, language, operations, terms, training, vectors
from foliant.plans import catalogue
from foliant.sources.tables import spans
from foliant.streaming import events as streaming


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


def test_text_functions(spark):
    t = F.col("text")
    assert one(spark, T.tokens(t), "Écoute, l'ami 42!") == ["écoute", "l", "ami", "42"]
    assert one(spark, T.query_terms(t), "a b") == ["a", "b"]
    assert one(spark, T.query_terms(t), "a bcd") == ["bcd"]
    assert one(spark, T.sentences(t), "One. Two!\nThree") == ["One.", "Two!", "Three"]
    assert one(spark, T.syntax_sentences(t), "One\ntwo. Three") == ["One\ntwo.", "Three"]
    assert one(spark, T.markers(t), "x [e 2] y [E2] z [E10]") == ["[E2]", "[E10]"]
    assert one(spark, T.truncated_quote(t, 5), "abc defg") == "abc…"
    assert one(spark, T.hashed_bucket(t, 128), "motor") == 2
    assert one(spark, T.literals(t), "5 km and 10% of abc123, 2,5mm") == ["measure:10:%", "measure:2,5:mm", "measure:5:km", "number:10", "number:2", "number:5", "percent:10%"]
    assert one(spark, T.tokens(t), None) is None


def test_windows_cover_all_words(spark):
    rows = [(d, 0, " ".join(f"w{k}" for k in range(n))) for d, n in enumerate([1, 12, 30, 47, 60, 61, 75, 90])]
    segs = spark.createDataFrame(rows, "doc_id long, segment long, text string")
    found = corpus.windows(segs, 16, 4, 5).orderBy("doc_id", "window").collect()
    for d, _, text in rows:
        words = [w for r in found if r.doc_id == d for w in r.text.split(" ")]
        assert set(words) == set(text.split(" "))
    assert [r.n_words for r in found if r.doc_id == 2] == [16, 16, 6]


def test_orphans_are_carried(spark):
    docs = spark.createDataFrame([(1, "Head one\nHead two\nA body of many words that ends here with a mark and goes on.\nTail")], "doc_id long, text string")
    found = corpus.chunks(spans(docs), minimum=12).orderBy("ordinal").collect()
    assert [(r.section, r.text.split(" ")[:2], r.ordinal) for r in found] == [("Head two", ["Head", "one"], 0), ("Tail", ["Tail"], 1)]


def test_bm25_of_empty_and_unseen(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "gamma")], "item_id long, text string")
    found = terms.bm25(docs, asked).collect()
    assert [(r.item_id, r.doc_id) for r in found] == [(1, 1)]
    assert found[0].confidence > 0.5


def test_grounding(spark):
    answers_ = [(1, "The tower has 10 floors [E1]."), (2, "The tower has 12 floors [e1]."), (3, "The tower has not 10 floors [E1]."), (4, "The tower has 10 floors."), (5, "The tower has 10 floors [E1] [E7]."), (6, "Rain fell [E1]. The tower has 10 floors [E2].")]
    asked = spark.createDataFrame(answers_, "answer_id long, text string")
    evidence = spark.createDataFrame([(k, "[E1]", "Rain fell. The tower has 10 floors.") for k in range(1, 7)], "answer_id long, marker string, text string")
    found = {r.answer_id: r for r in answers.grounding(asked, evidence).collect()}
    assert {k: (r.supported_claims, r.total_claims, r.grounded) for k, r in found.items()} == {1: (1, 1, True), 2: (0, 1, False), 3: (0, 1, False), 4: (0, 1, False), 5: (1, 1, False), 6: (1, 2, False)}
    assert found[5].valid_markers == ["[E1]"] and found[5].invalid_markers == ["[E7]"] and found[6].invalid_markers == ["[E2]"]


def test_search_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, k % 3, [float(x) for x in rng.normal(size=8)]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    whole = sorted(map(tuple, vectors.search(df, 4).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert sorted(map(tuple, vectors.search(df, 4).collect())) == whole
    assert len(whole) == 40


def test_asof(spark):
    units = spark.createDataFrame([(1, 0, "a"), (1, 10, "b")], "k long, at long, name string")
    points = spark.createDataFrame([(1, 9), (1, 10), (2, 5)], "k long, at long")
    found = training.asof_owner(units, points, "k", "at", "name").collect()
    assert sorted((r.k, r.at, r.name) for r in found if r.name) == [(1, 9, "a"), (1, 10, "b")]


def test_task_fold(spark):
    rows = [(k, datetime(2024, 1, 1, k), 1, kind) for k, kind in enumerate(["purchase", "view", "click", "purchase", "view"])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    assert tuple(operations.fold_tasks(df).first()) == (1, "completed", 3, 2)


def test_markdown():
    assert markdown_tables("<table><tr><th>h|</th></tr><tr><td>1</td><td>2</td></tr></table>") == ["| h\\| |\n| --- |\n| 1 |"]
    assert markdown_tables("<table><tr><td>alone</td></tr></table>") == []


def test_streams(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1, k % 5), k % 2, "view", float(k), "{}" if k % 3 else None) for k in range(20)]
    spark.createDataFrame(rows, streaming.SCHEMA).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = streaming.read_events(spark, str(tmp_path / "in"))
    once = streaming.run_available(streaming.requests_once(stream, "10 hours"), "once", checkpoint=str(tmp_path / "a"))
    assert once.count() == 4
    counts = streaming.run_available(streaming.counts_by_window(stream), "counts", "complete", str(tmp_path / "b"))
    assert counts.agg(F.sum("n")).first()[0] == 20
    assert streaming.run_available(streaming.alerts(stream, {"view": 17.5}), "alerted", checkpoint=str(tmp_path / "c")).count() == 2
    assert streaming.run_available(streaming.every_nth(stream), "nth", checkpoint=str(tmp_path / "d")).count() == 4


def test_streamed_tasks(spark, tmp_path):
    kinds = ["purchase", "view", "click", "purchase", "view", "signup"]
    rows = [(k, datetime(2024, 1, 1, k), u, kind, 1.0, None) for u in (1, 2) for k, kind in enumerate(kinds[u - 1 :])]
    df = spark.createDataFrame(rows, streaming.SCHEMA)
    for n, part in enumerate((df.where("event_id < 3"), df.where("event_id >= 3"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.task_states(streaming.read_events(spark, str(tmp_path / "in"), 10))
    found = streaming.run_available(stream, "tasks", "update", str(tmp_path / "c")).collect()
    want = {r.user_id: (r.state, r.version, r.refused) for r in operations.fold_tasks(df).collect()}
    assert {r.user_id: (r.state, r.version, r.refused) for r in found} == want


def test_ranks(spark):
    from pyspark.sql import Window

    from foliant.operators import ranks

    rows = [("a", k * 7 % 501, k % 5) for k in range(1, 401)] + [("b", k, 1) for k in range(9)] + [(None, k, 2) for k in range(3)]
    df = spark.createDataFrame(rows, "g string, k long, v long").where("g IS NOT NULL")
    w = Window.partitionBy("g").orderBy("k")
    want = {(r.g, r.k): (r.n, r.s) for r in df.select("g", "k", F.row_number().over(w).alias("n"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")).collect()}
    number = {(r.g, r.k): r["rank"] for r in ranks.numbered(df, ["g"], "k").collect()}
    upto = {(r.g, r.k): r.upto for r in ranks.running(df, ["g"], "k", "v").collect()}
    assert {k: (number[k], upto[k]) for k in want} == want
    assert ranks.numbered(df.where("false"), ["g"], "k").count() == 0


def test_control_spans_are_whole(spark, tmp_path):
    """Evidence and answer hold the whole span, however long; one abstention for the corpus."""
    long = "word " * 60 + "end."
    rows = [(1, f"Head\n\n{long}", "en", "web", len(long))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.span_ord, r.kind): r.example for r in training.control_spans(spark, str(tmp_path)).collect()}
    assert set(found) == {(1, 0, "evidence"), (1, 2, "evidence"), (None, None, "abstention")}
    assert found[1, 2, "evidence"] == f"Task: quote what the evidence says.\nEvidence:\n[E1] {long}\nQuotation:\n{long} [E1]"
    assert found[None, None, "abstention"].endswith("Quotation:\nThe evidence says nothing of it.")


def manifest_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, digest string, n_bytes bigint")


def test_manifest_changes_and_digest(spark):
    from foliant.operators.ledger import changed, corpus_mark

    stored = manifest_rows(spark, [(1, "a", "x", 3), (2, "a", "y", 4), (3, "b", "z", 5)])
    put = manifest_rows(spark, [(2, "a", "w", 9), (4, "b", "v", 1)])
    gone = spark.createDataFrame([(3,), (7,)], "doc_id bigint")
    after = changed(stored, gone, put)
    assert sorted(map(tuple, after.collect())) == [(1, "a", "x", 3), (2, "a", "w", 9), (4, "b", "v", 1)]
    mark = lambda rows: tuple(corpus_mark(rows).first())
    assert mark(after) == mark(after.orderBy("n_bytes").repartition(3))
    assert mark(after) != mark(stored)
    assert mark(changed(stored, gone.limit(0), put.limit(0))) == mark(stored)
    assert mark(stored.limit(0))[:2] == (0, 0)


def test_times_need_a_zone(spark):
    from foliant.operators.ledger import zoned

    texts = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(F.unix_micros(zoned(F.col("t")))).collect()]
    assert found == [1704067200000000, 1704067200000000, None, None, None, None]


def test_hybrid_counts_low_lexical_ranks_and_leaves_out_inactive(spark):
    from foliant.operators.retrieval import hybrid

    docs = spark.createDataFrame([(0, "apple pear"), (1, "apple apple"), (2, "apple"), (3, "apple stone road river"), (4, "")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(9, "apple")], "item_id bigint, text string")
    both = hybrid(docs.where("doc_id <> 2"), docs, asked, kept=3, depth=1).collect()
    # the one dense hit, document 1 or 2, is met first by id; lexical ranks of the others count
    assert [r.doc_id for r in both] == [1, 0, 3] and all(r.doc_id != 2 for r in both)
    assert both[0].dense_score == 1.0 and both[1].dense_score is None
    plain = hybrid(docs, docs, asked, calibrate=None, kept=1, depth=3).first()
    assert 0 < plain.confidence <= 1
    assert hybrid(docs.limit(0), docs, asked).count() == 0


def test_texts_are_dealt_only_where_tasks_are_few(spark, tmp_path):
    from foliant.sources.tables import dealt

    spark.range(100).repartition(9).write.parquet(str(tmp_path / "many"))
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    one = dealt(spark.read.parquet(str(tmp_path / "one")))
    assert one.rdd.getNumPartitions() == cores and one.count() == 100
    many = spark.read.parquet(str(tmp_path / "many"))
    assert dealt(many).rdd.getNumPartitions() == max(cores, many.rdd.getNumPartitions())


def plain_concepts(candidates, asked):
    """For each concept in turn the fitting candidate that is not taken."""
    out = []
    for item in sorted({a[0] for a in asked}):
        used = set()
        for _, no, terms in sorted(a for a in asked if a[0] == item):
            fits = [(-round(len(terms & c["st"]) * (2.0 if c["defines"] else 1.0) * c["score"], 6), -c["score"], c["rank"], c["sentence_no"], c) for c in candidates if c["item_id"] == item and terms & c["st"] and c["key"] not in used]
            if fits:
                best = min(fits, key=lambda f: f[:4])[4]
                used.add(best["key"])
                out.append((item, no, best["doc_id"], best["sentence_no"]))
    return out


def test_concepts(spark):
    rows = spark.createDataFrame([(1, "Cats and dogs versus the birds or xx"), (2, "no such word"), (3, "alpha and beta and alpha"), (4, None), (5, "")], "item_id long, text string")
    found = answers.concepts(rows).collect()
    assert [(r.item_id, r.concept_no, r.concept, r.terms) for r in found] == [(1, 0, "cats", ["cats"]), (1, 1, "dogs", ["dogs"]), (1, 2, "the birds", ["the", "birds"]), (3, 0, "alpha", ["alpha"]), (3, 1, "beta", ["beta"]), (3, 2, "alpha", ["alpha"])]
    rng = np.random.default_rng(5)
    held = [{"item_id": int(rng.integers(1, 4)), "doc_id": k, "rank": 1 + k % 3, "sentence_no": k, "st": set(rng.choice(["cats", "dogs", "the", "birds", "alpha", "beta"], 2)), "defines": bool(rng.integers(2)), "score": round(float(rng.integers(1, 4)) / 4, 6), "key": f"s{rng.integers(12)}"} for k in range(40)]
    df = spark.createDataFrame([(*list(c.values())[:4], sorted(c["st"]), *list(c.values())[5:]) for c in held], "item_id long, doc_id long, rank int, sentence_no int, st array<string>, defines boolean, score double, key string")
    got = answers.concept_sentences(df, answers.concepts(rows)).collect()
    assert sorted((r.item_id, r.concept_no, r.doc_id, r.sentence_no) for r in got) == plain_concepts(held, [(r.item_id, r.concept_no, set(r.terms)) for r in found])
    assert answers.concept_sentences(df.where("false"), answers.concepts(rows)).count() == 0


def plain_chunks(sizes, minimum):
    """What every segment hands on, one after the other; the numbers of the receivers."""
    out, carry, chunk = {}, 0, 0
    for k, (segment, n_windows, n, page, kind) in enumerate(sizes):
        chunk += carry == 0
        out[segment] = chunk
        near = k + 1 < len(sizes) and sizes[k + 1][3:] == (page, kind)
        carry = carry + n if n_windows == 1 and carry + n < minimum and near else 0
    return out


def test_carried_segments(spark):
    rng = np.random.default_rng(6)
    docs = {d: [(s, int(rng.choice([1, 1, 1, 2])), int(rng.integers(1, 14)), 1 + s // 9, ("text", "table")[int(rng.random() < 0.1)]) for s in range(int(rng.integers(1, 60)))] for d in range(40)}
    df = spark.createDataFrame([(d, *row) for d, rows in docs.items() for row in rows], "doc_id long, segment long, k long, n int, page int, kind string").repartition(3)
    found = {(r.doc_id, r.segment): r.chunk for r in corpus.carried(df, 12).collect()}
    assert found == {(d, s): c for d, rows in docs.items() for s, c in plain_chunks(rows, 12).items()}
    assert corpus.carried(df.where("false"), 12).count() == 0


def test_chunks_stay_on_their_page_and_kind(spark):
    text = "Head\n| a | b |\n| c | d |\nTail words\n" + "\n".join("line ends." for _ in range(60))
    found = corpus.chunks(spans(spark.createDataFrame([(1, text), (2, None), (3, " \n")], "doc_id long, text string"))).orderBy("ordinal").collect()
    assert [(r.doc_id, r.ordinal, r.kind, r.page, r.text.split(" ")[0]) for r in found] == [(1, 0, "text", 1, "Head"), (1, 1, "table", 1, "|"), (1, 2, "text", 1, "Tail"), (1, 3, "text", 2, "line")]
    for bad in ((15, 4, 3), (20, 20, 3), (20, 4, 21), (20, 4, 0)):
        try:
            corpus.windows(spark.createDataFrame([], "doc_id long, segment long, text string"), *bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def plain_losses(docs, order):
    """The same model over dictionaries, gram by gram."""
    import math
    from collections import defaultdict

    held = [(d, ["<s>"] * (order - 1) + re.findall(r"[^\W_]+", (t or "").lower())) for d, t in docs]
    counts = {order: defaultdict(float)}
    for d, l in held:
        if d is None or d % language.HELD_OUT:
            for k in range(order - 1, len(l)):
                counts[order][tuple(l[k - order + 1 : k + 1])] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = defaultdict(float)
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    context = {n: defaultdict(list) for n in counts}
    for n, c in counts.items():
        for g, x in c.items():
            context[n][g[:-1]].append(x)

    def p(g):
        own, seen = counts[len(g)].get(g, 0), context[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        less = p(g[1:]) if len(g) > 1 else 1 / (len(seen) + 1)
        return (max(own - language.DISCOUNT, 0) + language.DISCOUNT * len(seen) * less) / sum(seen)

    out = {}
    for d, l in held:
        each = [-math.log(p(tuple(l[k - order + 1 : k + 1]))) for k in range(order - 1, len(l))]
        out.setdefault(d, []).extend(each)
    return {d: (round(sum(x) / len(x), 5), len(x)) for d, x in out.items() if x}


@pytest.mark.parametrize("order", [2, 3, 5])
def test_context_losses(spark, order):
    rng = np.random.default_rng(order)
    docs = [(int(k), " ".join(rng.choice(["a", "b", "c", "dd", "e1"], int(rng.integers(0, 30))))) for k in range(25)] + [(3, "a b a b"), (40, "unseen words a b"), (50, None), (51, ""), (None, "a b c")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (round(r.loss, 5), r.n_targets) for r in language.losses(df, order).collect()}
    want = plain_losses(docs, order)
    assert found.keys() == want.keys() and all(abs(found[d][0] - want[d][0]) < 2e-5 and found[d][1] == want[d][1] for d in want)
    assert language.losses(df.where("false"), order).count() == 0


def test_longer_contexts_tell_more(spark):
    """On documents that the model has not seen, the loss of order three lies below that of order two."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mean = [language.losses(docs, n).where("held_out").agg(F.sum(F.col("loss") * F.col("n_targets")) / F.sum("n_targets")).first()[0] for n in (2, 3)]
    assert mean[1] < mean[0]


def test_shares_at_ties_are_those_of_sql(spark, tmp_path):
    """41 commas in 640 words are 0.0640625, of which no double is the exact half; both engines round it alike."""
    docs = [(k, " ".join(f"word{i % (7 + k)}" + "," * (i < marks) for i in range(n)) + ".", "en", "s", 0) for k, (n, marks) in enumerate([(640, 41), (640, 39), (320, 7), (1280, 83), (128, 1)])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = oracle.connect(str(tmp_path))
    for name in ("lexical_profile", "syntactic_profile", "discourse_profile", "rhetorical_role", "style_vector", "rhetorical_vector"):
        oracle.same(catalogue.QUERIES[name](spark, str(tmp_path)), con, catalogue.SQL[name])


def test_counts_stay_in_rows(spark, monkeypatch):
    """Counts and scores are the same whether terms are sent to every task or joined, rows of one id are one document, and no shuffle holds a row a term."""
    docs = spark.createDataFrame([(1, "aaa bbb aaa of"), (1, "bbb ccc"), (2, "Aaa, ddd\nddd eee1"), (3, None), (4, ""), (5, "an it"), (None, "aaa zzz")], "doc_id long, text string").repartition(3)
    want = {(1, "aaa", 2), (1, "bbb", 2), (1, "ccc", 1), (2, "aaa", 1), (2, "ddd", 2), (2, "eee1", 1), (None, "aaa", 1), (None, "zzz", 1)}
    assert {tuple(r) for r in curiosity.content_counts(docs).collect()} == want
    joined = [sorted(map(str, f(docs).collect())) for f in (curiosity.scores, curiosity.tags)]
    monkeypatch.setattr(curiosity, "OFTEN", 2)
    assert joined == [sorted(map(str, f(docs).collect())) for f in (curiosity.scores, curiosity.tags)] and len(joined[0]) == 3
    once = docs.where("doc_id > 1")
    assert "Exchange hashpartitioning" not in curiosity.content_counts(once)._jdf.queryExecution().executedPlan().toString()
