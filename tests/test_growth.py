"""Steps whose cost must not grow faster than the table, and their results on odd texts."""

from __future__ import annotations

import re

from foliant.operators import linguistics
from pyspark.sql import functions as F

ODD = ["", " ", "a", "One\ntwo. Three", "x.\n\n\ny?! z|w", "a \n\n b\x0bc.", "\n- item\n2) two\n\n• β≤3 – x—y", "=a+b; (c): d, e?", "|.| .", "é.è ü!\tß"]


def texts(spark, found):
    return spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")


def test_sentence_lengths_of_odd_texts(spark):
    told = texts(spark, ODD).select("doc_id", linguistics.sentence_lengths(F.col("text")).alias("l")).orderBy("doc_id").collect()
    want = [[len(re.findall(r"[^ \t\n\x0b\f\r]+", s)) for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n\n+", t) if s.strip(" \t\n\x0b\f\r")] for t in ODD]
    assert [r.l for r in told] == want


def test_marks_are_counted_in_what_is_left(spark):
    rows = texts(spark, ODD).select("text", linguistics.marks(F.col("text")).alias("m"), linguistics.symbol_count(linguistics.marks(F.col("text"))).alias("n")).collect()
    for r in rows:
        assert r.n == len(re.findall(linguistics.SYMBOLS, r.text)) and not re.search(r"[a-zA-Z \n]", r.m)


def test_phrases_keep_their_neighbours(spark):
    found = [("Is a, is x a; IS A is a", 3), ("because", 0), ("", 0), ("is  a", 1), ("is b a", 0), ("this a", 0)]
    sp = linguistics.spaced(F.col("text"), ["is a"])
    told = texts(spark, [t for t, _ in found]).select("doc_id", sp.alias("sp"), linguistics.phrase_count(sp, ["is a"]).alias("n")).orderBy("doc_id").collect()
    assert [r.n for r in told] == [n for _, n in found]
    long = texts(spark, ["word " * 1000 + "is a"]).select(sp.alias("sp")).first().sp
    assert len(long) < 20


def test_bigrams_that_share_a_number_are_told_apart(spark):
    from foliant.operators import training

    docs = texts(spark, ["a b a b c", "b c a", "c", ""])
    seeds = []

    def keys(seed, *of):
        seeds.append(seed)
        return F.lit(7).cast("bigint") if seed == 0 else training.number(seed, *of)

    told = {(r.doc_id, r.loss, r.n_targets) for r in training.bigram_loss(docs, keys).collect()}
    assert told == {(r.doc_id, r.loss, r.n_targets) for r in training.bigram_loss(docs).collect()} and set(seeds) == {0, 1}
    # ab 2, bc 2, ba 1, ca 1; a 2, b 3, c 1; three second tokens
    import math

    cost = {"ab": 2.5 / 3.5, "bc": 2.5 / 4.5, "ba": 1.5 / 4.5, "ca": 1.5 / 2.5}
    assert told == {(d, round(sum(-math.log(cost[p]) for p in ps) / len(ps), 6), len(ps)) for d, ps in ((0, ["ab", "ba", "ab", "bc"]), (1, ["bc", "ca"]))}


def test_a_window_row_carries_its_piece_alone(spark):
    from foliant.operators import corpus

    df = corpus.windows(spark.createDataFrame([(1, 0, " ".join(map(str, range(500))))], "doc_id long, segment int, text string"), 220, 40, 3)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    exploded = next(line for line in plan.splitlines() if "Generate posexplode" in line)
    assert "words" not in exploded.split("posexplode")[0] and [(r.window, r.start, r.n_words) for r in df.orderBy("window").collect()] == [(0, 0, 220), (1, 180, 220), (2, 360, 140)]
    below = plan[plan.index("Generate posexplode") :].splitlines()[1]
    assert below.strip(" +-:").startswith("Project") and "words#" not in below.split("transform(")[0]


def test_pages_go_to_python_a_hundred_at_a_time(spark):
    from foliant.operators import cycle

    df = cycle.page_texts(spark.createDataFrame([(1, "<p>a&amp;b</p><script>x()</script> <b>c</b>"), (2, None)], "page_id long, html string"))
    assert {tuple(r) for r in df.collect()} == {(1, "a&b c"), (2, "")}
    assert "BatchEvalPython" in df._jdf.queryExecution().executedPlan().toString()


def test_overlap_is_counted_by_more_tasks_in_a_larger_table(spark, monkeypatch):
    from foliant.operators import curiosity

    whole = {tuple(r) for r in curiosity.overlap_search(spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(curiosity, "AT_ONCE", 20)
    df = curiosity.overlap_search(spark, "/root/testdata/sf0.001")
    assert "hashpartitioning(doc_id" in (plan := df._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan
    assert {tuple(r) for r in df.collect()} == whole


def test_nearest_in_parts_is_the_whole_search(monkeypatch):
    import numpy as np

    from foliant.operators import vectors

    monkeypatch.setattr(vectors, "PART", 64)
    rng = np.random.default_rng(3)
    v = np.abs(rng.normal(size=(700, 20))) * (rng.random((700, 20)) < 0.4)
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
    v[100:180], v[300], v[5] = v[7], v[7] * (1 - 4e-7), 0  # copies, a likeness that rounds to theirs, a zero vector
    ids, asked = rng.permutation(700).astype(np.int64), np.arange(40, dtype=np.int64)
    score = v[:40] @ v.T
    want = vectors.best_of(np.where(score > 0, np.round(score, 6), -np.inf), asked, ids, 6)
    assert vectors._best(v[:40], v, 6, asked, ids).to_pylist() == want.to_pylist()


def test_word_types_are_held_by_their_symbols(monkeypatch):
    import pyarrow as pa

    from foliant.operators import subwords

    monkeypatch.setattr(subwords, "HELD", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([[1] * 20, [2] * 10], pa.list_(pa.int32())), pa.array([3, 4], pa.int64())], names=["symbols", "freq"])
    found = [(len(t.symbols), len(t.sizes)) for t in subwords.held(iter([batch] * 5))]
    assert found == [(120, 8), (30, 2)]


def test_a_change_writes_what_it_changes(spark, monkeypatch, tmp_path):
    """A put writes its documents, a removal none; a bucket changed CHANGES times is written whole, and every generation stays readable."""
    from foliant.sources import store

    monkeypatch.setattr(store, "CHANGES", 2)
    monkeypatch.setattr(store, "DIGITS", 1)
    ids = [str(k) for k in range(60)]
    same = next(d for d in ids[1:] if store.hashlib.sha256(d.encode()).hexdigest()[0] == store.hashlib.sha256(b"0").hexdigest()[0])  # of one bucket with 0

    def of(told):
        df = spark.createDataFrame([(d, k, "", f"{t} {d} {k}") for d, t in told for k in range(2)], "document_id string, ordinal int, section string, text string")
        return df.withColumn("chunk_id", store.chunk_identity())

    def size():
        return spark.read.text(str(tmp_path / "data/*/chunks/bucket=*")).count()

    corpus, now, was = store.Corpus(spark, str(tmp_path)), dict.fromkeys(ids, "a"), []
    corpus.replace(of(now.items()))
    held = size()
    for step in ("put", "remove", "put"):
        was.append(dict(now))
        if step == "put":
            now["0"] = f"b{len(was)}"
            corpus.put(of([("0", now["0"])]))
        else:
            del now[same]
            corpus.remove(spark.createDataFrame([(same,)], "document_id string"))
        if len(was) < 3:
            assert size() == held + 2
    assert size() > held + 4 and not any("changes" in b for b in corpus.entry()["buckets"].values())
    seen = corpus.seen([1, 2, 3, 4])
    for number, want in enumerate([*was, now], 1):
        assert corpus.faults(number, seen).count() == 0 and corpus.entry(number)["aggregate"]["documents"] == len(want)
        assert {(r.document_id, r.text.split()[0]) for r in corpus._content(corpus.entry(number)["buckets"]).collect()} == set(want.items())


def test_spans_of_odd_blanks(spark):
    from foliant.sources import tables

    lines = ["a b", " a  b ", "a\t b\x0b\x0cc", "\ra \r b\r", "\t", "  ", "a \x0b", "x\xa0 y", "", "a   b c\t\td"]
    told = tables.spans(texts(spark, ["\n".join(lines)])).orderBy("span_ord").collect()
    want = [(k, re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")) for k, t in enumerate(lines)]
    assert [(r.span_ord, r.text) for r in told] == [w for w in want if w[1]]


def test_a_task_encodes_a_pretoken_once(spark, monkeypatch):
    """Lots of one text each: a pre-token of an earlier lot is not encoded again, and the rows are those without anything kept."""
    import pyarrow as pa

    from foliant.operators import subwords

    tokens = [*subwords.BASE, subwords.END, "a", "b", "é"]
    merges = [("a", "b", 3), ("ab", subwords.END, 2)]
    tokens += ["ab", "ab" + subwords.END]
    docs = [["ab", "[E12]", "a"], [], ["ab", "é漢", "a", "a"], ["ab"] * 5, ["[", "ab"]]
    asked, kept = [], subwords.Encoder.encode_all

    class Docs:  # the frame and its session, for the function of a task alone
        sparkSession = sparkContext = property(lambda self: self)
        broadcast = staticmethod(lambda x: type("B", (), {"value": x}))
        select = lambda self, *_: self
        mapInArrow = lambda self, f, _: f

    monkeypatch.setattr(subwords.Encoder, "encode_all", lambda self, words: (asked.extend(words), kept(self, words))[1])
    monkeypatch.setattr(subwords, "AT_ONCE", 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.list_(pa.string()))], names=["doc_id", "words"])

    def run():
        return [r for b in subwords.encoded_documents(Docs(), tokens, merges)(iter([batch])) for r in b.to_pylist()]

    first = run()
    assert sorted(asked) == sorted({w for t in docs for w in t})
    i = tokens.index
    assert [r["ids"] for r in first] == [[i("ab</w>"), 5, 8, 9, 6, i("a"), i("</w>")], [], [i("ab</w>"), i("é"), 1, i("</w>"), *[i("a"), i("</w>")] * 2], [i("ab</w>")] * 5, [1, i("</w>"), i("ab</w>")]]
    assert [(r["text"], r["intact"]) for r in first] == [("ab [E12]a", True), ("", True), ("ab é a a", False), ("ab ab ab ab ab", True), ("ab", False)]
    monkeypatch.setattr(subwords, "KEPT", 0)
    assert run() == first


def test_of_many_creators_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from foliant.sources import store

    files = store.Files(spark)
    with ThreadPoolExecutor(8) as pool:
        for k in range(40):
            assert sum(pool.map(lambda n: files.create(str(tmp_path / f"log/{k}.json"), str(n)), range(8))) == 1
    assert files.names(str(tmp_path / "log")) == sorted(f"{k}.json" for k in range(40))


def test_positions_are_shuffled_once_in_blocks(spark, monkeypatch):
    """Frequent words dealt over buckets of their own, words without a number and lots of a few tokens give the same losses; no row is a token's."""
    from test_operators import plain_losses

    from foliant.operators import language, packed

    docs = [(k, " ".join("abcdef"[(k * i * i + i) % 6] for i in range(k % 13))) for k in range(40)] + [(3, "Éa_b a"), (None, "a b"), (50, None), (60, "x 12 ٣ a")]
    monkeypatch.setattr(language, "MOST", 6)
    monkeypatch.setattr(language, "LEAST", 6)
    monkeypatch.setattr(packed, "NUMBERED", 4)
    monkeypatch.setattr(packed, "LOT", 4)
    for digits, order, some in ((15, 1, docs), (15, 2, docs), (15, 3, docs), (1, 4, docs[:30])):
        monkeypatch.setattr(packed, "DIGITS", digits)  # of one digit alone, so that words share a hash under most seeds
        found = language.losses(spark.createDataFrame(some, "doc_id long, text string").repartition(3), order)
        told, want = {r.doc_id: (r.loss, r.n_targets) for r in found.collect()}, plain_losses(some, order)
        assert told.keys() == want.keys() and all(abs(told[d][0] - want[d][0]) < 2e-5 and told[d][1] == want[d][1] for d in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroupsInArrow" in plan


def test_tokens_of_all_texts_at_once():
    import pyarrow as pa

    from foliant.operators import packed

    found = ["aé_b", None, "", "漢字 x", "zz", "𝒳y-😀1", "é", " ", "a\n٣²b"]
    for told in (found, found[2:]):
        t, sizes = packed.tokens(pa.array(["-", *told])[1:])
        want = [re.findall(r"[^\W_]+", x or "") for x in told]
        assert t.to_pylist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    assert packed.tokens(pa.array([None, ""], pa.string()))[0].to_pylist() == []


def test_profiles_are_made_in_the_row_of_a_text(spark):
    """No shuffle makes the vectors of profile_search; they are those of the profiles that are registered by themselves."""
    from foliant.operators import profiles, terms

    odd = [*ODD, "But is a, is a than ÀÉ àé x1 AB12 co-op CamelCase. because such as", "für zum beispiel étape étape = ≤≥ – _a_ Für", "İstanbul ǅ 漢字 𝒳 x²", None]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    made = profiles.profiles(docs)
    assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    told = {r.vec_id: r for r in made.collect()}
    style, rhetoric = ({r[0]: [round(x * 100_000) for x in r[1]] for r in f(docs).collect()} for f in (linguistics.style_vectors, linguistics.rhetorical_vectors))
    assert {d: r.style for d, r in told.items()} == style and {d: r.rhetoric for d, r in told.items()} == rhetoric
    for r in terms.dense_vectors(docs, "doc_id").collect():
        norm = sum(c * c for c in told[r.vec_id].content) ** 0.5
        assert all(abs(c / norm - w) < 1e-12 for c, w in zip(told[r.vec_id].content, r.embedding))


def test_search_in_packed_blocks_is_the_whole_search(spark, monkeypatch):
    import numpy as np

    from foliant.operators import profiles, vectors

    rng = np.random.default_rng(5)
    whole = rng.integers(0, 9, (300, 112)) * (rng.random((300, 112)) < 0.3)
    whole[40:60] = whole[20]
    whole[7] = 0
    rows = spark.createDataFrame([(k - 30, r[:64].tolist(), r[64:96].tolist(), r[96:].tolist()) for k, r in enumerate(whole)], "vec_id long, content array<int>, style array<int>, rhetoric array<int>")
    v, ids = profiles._vectors(whole), np.arange(300) - 30
    score = v[ids % 20 == 0] @ v.T
    want = vectors.best_of(np.where(score > 0, np.round(score, 6), -np.inf), ids[ids % 20 == 0], ids, 6).to_pylist()
    monkeypatch.setattr(profiles, "ASKED", 4)
    monkeypatch.setattr(profiles, "HELD", 400)
    assert sorted(map(tuple, profiles.search(rows, 6).collect())) == sorted(tuple(r.values()) for r in want)
    monkeypatch.setattr(profiles, "HELD", 50)
    assert set(tuple(r.values()) for r in want) <= set(map(tuple, profiles.search(rows, 6).collect()))


def test_shuffle_files_go_when_their_table_is_there(spark):
    from foliant.sources import shared

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = held.shuffleStatuses().size()
    found = shared.released(spark.range(1000).repartition(3).groupBy("id").count())
    assert found.count() == 1000 and spark.conf.get(key, "false") == was
    assert held.shuffleStatuses().size() <= before + 1  # the count's own
