"""Operators on many documents: collisions, components, tiles, joins, paragraphs, archives, mixing, packing, the pipeline."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from oracle import connect, same
from pyspark.sql import functions as F
from test_documents import EDGES, edges, empty  # noqa: F401

from foliant.llm import collisions, common, components, frequencies, op5_paragraphs, op7_ngram_join, op8_warc, op9_mixing, op10_packing, registry, tiles
from foliant.llm.pretokens import tokenizer


def roots(pairs, vertices):
    parent = {v: v for v in vertices}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in vertices}


@pytest.mark.parametrize("name", ["op5_paragraphs", "op7_ngram_join", "op8_warc", "op9_mixing"])
def test_sql(spark, name):
    same(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name])


def test_forest_and_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 500)] + [(7, 7)]
    vertices = {v for p in pairs for v in p}
    want = roots(pairs, vertices)
    a, b = collisions.forest(*map(np.array, zip(*pairs)))
    assert dict(zip(a.tolist(), b.tolist())) == {v: r for v, r in want.items() if v != r}
    found = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {v: r for v, r in want.items() if v in found} and {v for v, r in want.items() if v != r} <= set(found)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(n, words=60, seed=4):
    """One text, n copies with a few words changed, and as many other texts; more than a tile holds when tiles are small."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(words)] = f"x{rng.randrange(9)}"
        out.append(" ".join(w[: words - k % 9]))
        out.append(" ".join(f"y{rng.randrange(4000)}" for _ in range(rng.randrange(0, 40))))
    return [(k, t) for k, t in enumerate(out)]


def brute_join(rows):
    sets = {}
    for d, t in rows:
        w = common.words((t or "").encode().lower().decode())
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]]
    degree = Counter(x for p in links for x in p)
    comp = roots(links, sets)
    return {(d, len(s), comp[d], degree[d]) for d, s in sets.items()}


@pytest.mark.parametrize("small", [0, 5, 2])
def test_join_brute(spark, monkeypatch, small):
    if small:  # many flushes, buckets and tiles; blocks of two leave some blocks empty
        for module, name, value in ((tiles, "BLOCK_MEMBERS", small), (tiles, "BUCKET_MEMBERS", 7), (frequencies, "HELD", 500), (frequencies, "BUCKET", 300), (collisions, "HELD", 100)):
            monkeypatch.setattr(module, name, value)
    rows = near_copies(40) + [(1000 + k, t) for k, (d, t) in enumerate(EDGES) if d is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in op7_ngram_join.linked(df).collect()} == brute_join(rows)


def test_join_edges(spark, edges, empty):  # noqa: F811
    found = op7_ngram_join.linked(edges).collect()
    assert len(found) == len(EDGES)
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    assert [(r.n_shingles, r.component_id) for r in by[4] + by[5]] == [(1, 4)] * 3
    assert {r.component_id for r in by[None]} == {None} and {r.n_shingles for r in by[1] + by[2] + by[3]} == {0}
    assert op7_ngram_join.linked(empty).count() == 0


def test_first_of_each(spark, edges, empty):  # noqa: F811
    found = op7_ngram_join.first_of_each(edges)
    assert found.columns == edges.columns
    assert sorted(r.doc_id for r in found.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    assert found.where("doc_id IS NULL").count() == 2 and op7_ngram_join.first_of_each(empty).count() == 0
    rows = spark.createDataFrame(near_copies(20), "doc_id long, text string")
    kept = {r.doc_id for r in op7_ngram_join.first_of_each(rows).collect()}
    assert kept == {d for d, _, c, _ in brute_join(near_copies(20)) if d == c}


def test_first_of_repeated_ids(spark):
    """Rows are judged by their own texts: another text under a used id stays, copies without an id go but for one."""
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, "one two three four five six"), (1, long), (1, "another text under the same id here"), (2, long + " x"), (3, None), (3, ""), (None, "no id at all here now"), (None, "no id at all here now"), (None, long), (7, "last copy of a text below"), (5, "last copy of a text below"), (5, "last copy of a text below")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = [tuple(r) for r in op7_ngram_join.first_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[1], rows[2], rows[4], rows[5], rows[6], rows[10]], key=str)


def test_prefixes_meet():
    """Sets within the similarity always share a key, whatever the frequencies."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = int(np.ceil(0.8 * len(a)))
        b = np.unique(rng.permutation(a)[:keep])
        docs = [(1, len(a), 1, 1, 0), (2, len(b), 2, 2, 1)]
        table = frequencies._count(common_table(frequencies._packed(0, docs, [a, b], 1)))
        keys = {r["doc_id"]: set(np.frombuffer(r["keys"], "<u8")) for r in frequencies._prefix(table, 80).to_pylist()}
        assert keys.get(1, set()) & keys.get(2, set())


def common_table(b):
    import pyarrow as pa

    return pa.Table.from_batches([b])


def test_paragraphs_brute(spark, edges, empty):  # noqa: F811
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for d in range(12):
        lines = [" ".join(f"z{rng.randrange(9999)}" for _ in range(40)) for _ in range(3)]
        if d % 3 == 0:
            lines.insert(1, " ".join(passage if d % 2 else [*passage[:30], f"edit{d}", *passage[31:]]))
        rows.append((d, "\n".join(lines)))
    rows.append((12, rows[1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = op5_paragraphs.near_blocks(df).collect()
    assert {(r.doc_id, r.first_word) for r in found if r.first_doc_id == 0} == {(d, 40) for d in (0, 3, 6, 9)}
    assert {(r.doc_id, r.first_doc_id, r.removed) for r in found if r.doc_id in (1, 12)} == {(1, 1, False), (12, 1, True)}
    cleaned = {r.doc_id: r.text for r in op5_paragraphs.without_repeats(df).collect()}
    assert cleaned[12] == "" and cleaned[0] == rows[0][1] and len(cleaned[9].split("\n")) == 3
    assert {r.doc_id for r in op5_paragraphs.repeated(edges).collect()} <= {8}
    assert op5_paragraphs.without_repeats(edges).columns == edges.columns
    assert op5_paragraphs.repeated(empty).count() == 0


def test_short_texts_are_blocks(spark):
    """A text of five words or more is compared whole, however short; of fewer it is not."""
    words = [f"w{k}" for k in range(28)]
    rows = [(1, " ".join(words)), (2, "\n".join(words).upper()), (3, " ".join(words)), (4, " ".join(words[:14])), (5, "a b c d"), (6, "a b c d"), (7, "a b c d e"), (8, " a  b\nc d e ")]
    found = op5_paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.kind, r.doc_id, r.first_doc_id, r.n_words, r.removed) for r in found} == {("block", d, f, n, d != f) for d, f, n in ((1, 1, 28), (2, 1, 28), (3, 1, 28), (7, 7, 5), (8, 7, 5))}


def test_passages_brute(spark, edges, empty, monkeypatch):  # noqa: F811
    """Every 50 words in a row that two documents hold lead to a passage in both, whatever the lines; its words stand in another document."""
    for module, name in ((collisions, "HELD"), (collisions, "BUCKET_KEYS"), (op5_paragraphs, "AT_ONCE")):  # many blocks, buckets and slices
        monkeypatch.setattr(module, name, 200)
    rng = random.Random(10)
    fill = lambda n: [f"z{rng.randrange(10**6)}" for _ in range(n)]
    shared = [f"p{k}" for k in range(60)]
    wrapped = "\n".join(" ".join(shared[k : k + 7]) for k in range(0, 60, 7))
    rows = [(1, wrapped), (2, " ".join([*fill(200), *shared, *fill(200)])), (3, " ".join([*fill(40), *shared[:31], *fill(40)])), (4, " ".join(fill(300))), (5, "\n".join([*fill(9), *shared[5:55]])), (6, "same " * 200), (7, "same " * 80)]
    rows += [(8 + k, " ".join([*fill(rng.randrange(60)), *shared[:50], *fill(rng.randrange(60))])) for k in range(40)]
    some = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows += [(100 + r.doc_id, r.text) for r in some]
    held = {d: common.words(common.ascii_lower(t or "")) for d, t in rows}

    def places(n):
        at = defaultdict(set)
        for d, w in held.items():
            for k in range(len(w) - n + 1):
                at[tuple(w[k : k + n])].add((d, k))
        return [p for p in at.values() if len({d for d, _ in p}) > 1]

    found = op5_paragraphs.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    units = {(d, k) for p in places(op5_paragraphs.UNIT) for d, k in p}
    words = {(d, k + j) for d, k in units for j in range(op5_paragraphs.UNIT)}
    marked = {(r.doc_id, r.first_word + j) for r in found for j in range(r.n_words)}
    assert marked <= words
    for p in places(op5_paragraphs.PASSAGE):
        for d, k in p:
            assert sum((d, k + j) in marked for j in range(op5_paragraphs.PASSAGE)) >= op5_paragraphs.UNIT
    assert {5, *range(8, 48), 1, 2, 6, 7} == {r.doc_id for r in found if r.doc_id < 100}
    assert all(r.first_doc_id <= r.doc_id for r in found)


def test_passages_of_edges(spark, edges, empty):  # noqa: F811
    assert op5_paragraphs.passages(empty).count() == 0 and op5_paragraphs.passages(edges).count() == 0
    text = " ".join(f"p{k}" for k in range(60))
    rows = spark.createDataFrame([(None, text), (None, text), (3, text.upper()), (4, None), (5, "")], "doc_id long, text string")
    found = sorted((r.doc_id is None, r.first_word, r.n_words, r.first_doc_id, r.removed) for r in op5_paragraphs.repeated(rows).where("kind = 'passage'").collect())
    assert [f[0] for f in found] == [False, True] and all(f[3] is None and f[2] >= 32 for f in found) and [f[4] for f in found] == [True, False]
    inside = spark.createDataFrame([(1, text), (2, "one two " + text.replace(" ", "\n") + " three"), (3, "x " + text.replace("p33", "edit"))], "doc_id long, text string")
    cleaned = {r.doc_id: r.text for r in op5_paragraphs.without_repeats(inside).collect()}
    assert cleaned[1] == text and len(common.words(cleaned[2])) <= 63 - op5_paragraphs.UNIT


def test_bands_recall():
    """Sets of similarity 0.8 meet in a band nearly always."""
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(400):
        x = rng.integers(0, 2**63, 100).astype(np.uint64)
        a, b = np.unique(x[:90]), np.unique(x[10:])
        one, other = op5_paragraphs.band_keys(np.concatenate([a, b]), np.array([len(a), len(b)]))
        met += (one == other).any()
    assert met >= 396


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op8_warc, "ARCHIVE_BYTES", 3000)
    rows = [(k, f"http://e/{k}", f"<p>page {k % 5}</p>" * 20) for k in range(60)] + [(60, None, None), (61, "u", ""), (3, "http://e/3", "<p>page 3</p>" * 20), (None, "n", "alone"), (None, "n", "<p>page 4</p>" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = op8_warc.write_archives(pages, f"file://{tmp_path}/warc")
    assert files.count() == len(list((tmp_path / "warc").glob("*.warc.zst"))) > 3
    assert not list((tmp_path / "warc").glob("*.tmp"))
    found = op8_warc.read_archives(files).collect()
    assert len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r.payload_digest].append(r)
    for html in {r[2] or "" for r in rows}:
        group = by[base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()]
        ids = [r[0] for r in rows if (r[2] or "") == html]
        assert sorted(r.page_id if r.page_id is not None else -1 for r in group) == sorted(i if i is not None else -1 for i in ids)
        first = [r for r in group if r.record_type == "response"]
        assert len(first) == 1 and first[0].page_id == max((i for i in ids if i is not None), default=None)
        assert all(r.refers_to == first[0].page_id for r in group if r.record_type == "revisit")
        assert {r.payload_bytes for r in group} == {len(html.encode())}
    assert op8_warc.read_archives(op8_warc.write_archives(pages.where("false"))).count() == 0


def test_archive_is_standard(tmp_path):
    """The first frame is skippable and holds the dictionary; every record is a frame that it decodes."""
    import zstandard

    records = [op8_warc.record(k, f"u{k}", b"hello world %d" % k * 50, op8_warc.digest(b""), None, False) for k in range(40)]
    path = tmp_path / "a.warc.zst"
    with path.open("wb") as out:
        op8_warc.write_archive(out, records)
    raw = path.read_bytes()
    size = int.from_bytes(raw[4:8], "little")
    assert raw[:4] == bytes.fromhex("5d2a4d18") and size > 0
    held = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    assert held.decompressobj().decompress(raw[8 + size :]) == records[0]
    with path.open("rb") as source:
        assert [h["X-Page-ID"] for h, _ in op8_warc.read_archive(source)] == [str(k) for k in range(40)]
    path.write_bytes(raw[:-5])
    with path.open("rb") as source, pytest.raises((ValueError, zstandard.ZstdError)):
        list(op8_warc.read_archive(source))


def test_mixing(spark, edges, empty):  # noqa: F811
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op9_mixing.described(docs)
    cells = op9_mixing.raked(op9_mixing.cell_totals(rows)).toPandas()
    assert abs(cells.weight.sum() - 1) < 1e-9
    for m in op9_mixing.MARGINS:
        got = cells.groupby(f"mix_{m}").agg(w=("weight", "sum"), share=(f"share_{m}", "first"))
        assert (got.w - got.share).abs().max() < 1e-3
        observed = cells.groupby(f"mix_{m}").tokens.sum() / cells.tokens.sum()
        target = observed ** op9_mixing.TEMPERATURES[m]
        assert (got.share - target / target.sum()).abs().max() < 1e-9
    found = op9_mixing.mixed(docs).toPandas()
    spent = (found.probability * found.mix_tokens).sum() / found.mix_tokens.sum()
    assert len(found) == docs.count() and abs(spent - op9_mixing.BUDGET) < 0.02
    assert abs(found.sampled.mean() - found.probability.mean()) < 0.05
    small = op9_mixing.mixed(edges)
    assert small.count() == len(EDGES) and small.columns[: len(edges.columns)] == edges.columns
    assert op9_mixing.mixed(empty).count() == 0


def test_residuals(spark, edges, empty):  # noqa: F811
    """The fitted margins reach their targets; the shares of the sample are told as they are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op9_mixing.residuals(docs).toPandas()
    for _, part in found.groupby("margin"):
        assert all(abs(part[c].sum() - 1) < 1e-9 for c in ("target", "raked", "expected", "sampled"))
    assert (found.raked - found.target).abs().max() < 1e-3
    assert (found.expected - found.target).abs().max() < 0.05 and (found.sampled - found.expected).abs().max() < 0.05
    assert op9_mixing.residuals(empty).count() == 0 and op9_mixing.residuals(edges).count() > 3


def test_small_archives_have_a_dictionary(tmp_path):
    records = [op8_warc.record(1, "u", b"alone", op8_warc.digest(b"alone"), None, False)]
    with (tmp_path / "a").open("wb") as out:
        op8_warc.write_archive(out, records)
    assert int.from_bytes((tmp_path / "a").read_bytes()[4:8], "little") > 0
    with (tmp_path / "a").open("rb") as source:
        assert [p for _, p in op8_warc.read_archive(source)] == [b"alone"]


def test_archive_ids_and_long_pages(spark, tmp_path):
    """No two records share an id, revisits name their response's, and a page of millions of characters comes back whole."""
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (3, "w", "x" * 3_000_000), (None, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS key", "'clash' AS hex", "1 AS first")
    files = op8_warc.write_archives(pages, f"file://{tmp_path}/warc")
    heads = []
    for r in files.collect():
        with open(r.path.removeprefix("file://"), "rb") as source:
            heads += [h for h, _ in op8_warc.read_archive(source)]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == len(ids) == len(rows) + files.count()
    response = {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    assert {h["WARC-Refers-To"] for h in heads if h["WARC-Type"] == "revisit"} <= response and len(response) == 2
    assert max(r.payload_bytes for r in op8_warc.read_archives(files).collect()) == 3_000_000


def sequences(found):
    """The pieces of each sequence lie gapless from 0 and within the window; the ids of padding."""
    filled = defaultdict(list)
    for r in found:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    assert set(filled) == set(range(len(filled)))
    return 4096 * len(filled) - sum(r.length for r in found)


def test_packing(spark, edges, empty):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(80).union(edges.select("doc_id", "text"))
    library = tokenizer(op10_packing.TOKENIZER)
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4"))
    found = op10_packing.pack(docs).collect()
    covered = Counter()
    for r in found:  # rows that repeat an id (5 and none) are told by their lengths
        ids = next(x for x in want[r.doc_id] if len(x) == r.doc_tokens)
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        covered[r.doc_id] += r.length
    assert covered == {d: sum(map(len, x)) for d, x in want.items()}
    places = Counter((r.doc_id, r.doc_tokens, r.start + k) for r in found for k in range(r.length))
    assert places == Counter((d, len(x), k) for d, xs in want.items() for x in xs for k in range(len(x)))
    assert sequences(found) < 4096 + 32 * len({r.sequence_id for r in found})
    assert op10_packing.pack(empty).count() == 0


@pytest.mark.parametrize("n", [2049, 2731, 3000])
def test_packing_of_equal_lengths(spark, n):
    """A thousand documents of one length leave less than one in a hundred ids of padding."""
    words = ("a " * (n - 1)).strip()
    docs = spark.range(1000).selectExpr("id AS doc_id", f"'{words}' AS text")
    found = op10_packing.pack(docs).collect()
    assert {r.doc_tokens for r in found} == {n} and sum(r.length for r in found) == 1000 * n
    assert sequences(found) < 0.01 * 1000 * n
    one = np.array(tokenizer(op10_packing.TOKENIZER).encode(words, add_special_tokens=False).ids + [2], "<u4")
    assert all(zlib.crc32(one[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in found)


def test_plan_uses_every_piece():
    rng = np.random.default_rng(2)
    for window, hot in ((256, 128), (256, 100), (1024, 682), (1024, 513), (4096, 4095), (4096, 33)):
        lengths = np.arange(1, window + 1)
        counts = rng.integers(0, 50, window) * (rng.random(window) < 0.6)
        counts[hot - 1] += 90_000  # one length that many documents have
        keep = counts > 0
        plan = op10_packing.plan(lengths[keep], counts[keep], window, 8)
        length = np.repeat(lengths[keep], counts[keep])
        rank = np.concatenate([np.arange(c) for c in counts[keep]])
        sequence, offset, head = plan.place(length, rank)
        tail = head < length
        assert ((head % 8 == 0) | ~tail).all() and (head > 0).all()
        s, o, n = (np.concatenate(x) for x in ((sequence, sequence[tail] + 1), (offset, np.zeros(tail.sum(), int)), (head, (length - head)[tail])))
        order = np.lexsort((o, s))
        s, o, n = s[order], o[order], n[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        assert (o[first] == 0).all() and (o[~first] == (o + n)[:-1][~first[1:]]).all()
        assert (o + n).max() <= window and s.max() + 1 < (1 + 8 / window) * n.sum() / window + 2 + 0.004 * len(set(s.tolist()))


def test_nnls():
    rng = np.random.default_rng(3)
    columns = np.stack([rng.permutation(12)[:3] for _ in range(30)])
    a = np.zeros((12, 30))
    for k, c in enumerate(columns):
        a[c, k] = 1
    target = a @ np.maximum(rng.normal(size=30), 0)
    x = op10_packing.nnls(columns, target, 2000)
    assert (x >= 0).all() and np.abs(a @ x - target).max() < 1e-3


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, columns = docs, docs.columns
    for name, stage in p.STAGES[:-1]:
        new = common.materialise(stage(spark, now, SF), name)
        assert new.columns == columns and 0 < new.count() <= now.count()
        assert new.join(now, "doc_id", "left_anti").count() == 0
        if name == "ngram_join_7":
            linked = op7_ngram_join.linked(new)
            assert linked.where("doc_id <> component_id").count() == 0
        if name == "pseudonyms_4":
            assert new.count() == now.count() and new.where(F.length("text") != F.col("n_chars")).count() == 0
        now = new
    packed = p.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == now.count()
    assert p.run(spark, SF).count() == packed.count()


def test_pipeline_brute(spark):
    """Every stage on the rows that the stage before should have kept, each by a plain version of its rule."""
    import re

    import corpus_pipeline as p

    from foliant.llm import op6_langid

    stages = dict(p.STAGES)
    rows = [(d, t, "en", f"s{d % 3}", len(t)) for d, t in near_copies(12)] + [(900, None, None, None, None), (901, "call +1 (274) 555-9629 or write a.b@mail.example.com " + "some english words here " * 9, "en", "s1", 262), (902, "123 !!", "en", "s2", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(1)
    model = op6_langid.fit(docs)
    kept = [r for r in rows if not model.predict(r[1])[2]]
    one = common.materialise(stages["language_6"](spark, docs, SF), "one")
    assert sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in kept) and not {900, 902} & {r[0] for r in kept}
    first = {d for d, _, c, _ in brute_join([r[:2] for r in kept]) if d == c}
    two = common.materialise(stages["ngram_join_7"](spark, one, SF), "two")
    assert {r.doc_id for r in two.collect()} == first
    three = common.materialise(stages["pseudonyms_4"](spark, two, SF), "three")
    texts = {r[0]: r[1] for r in kept}
    for r in three.collect():
        private = re.search(r"[0-9]{3}-[0-9]{4}|@", texts[r.doc_id])
        assert (r.text == texts[r.doc_id]) == (private is None) and r.n_chars == len(r.text)
    four = stages["mixing_9"](spark, three, SF)
    con = connect(SF)
    con.execute("DROP VIEW documents")
    con.register("documents", three.toArrow())
    assert {r.doc_id for r in four.collect()} == {r[0] for r in con.execute(f"SELECT doc_id FROM ({op9_mixing.SQL}) WHERE sampled").fetchall()}
    library = tokenizer(op10_packing.TOKENIZER)
    packed = stages["packing_10"](spark, common.materialise(four, "four"), SF).collect()
    assert {(r.doc_id, r.doc_tokens) for r in packed} == {(r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids) + 1) for r in four.collect()}


def test_clashing_columns(spark):
    """Extra columns with the names that the operators use inside keep their values."""
    import corpus_pipeline as p

    names = ["row", "mix_source", "mix_topic", "probability", "sampled", "first_id", "doubtful_id", "n_pii", "pii_found", "gone", "gone_id", "key", "group", "id", "component", "sequence_id", "rank", "feature", "quality"]
    rows = [(d, t + " call 555-010-9629", "en", "s", len(t), *range(len(names))) for d, t in near_copies(6) if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)).repartition(1)
    for _, stage in p.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        assert all([r[n] for n in names] == list(range(len(names))) for r in found.collect())
    assert p.STAGES[-1][1](spark, docs, SF).count() == len(rows)
    assert op5_paragraphs.without_repeats(docs).columns == docs.columns
    assert "sampled" in op9_mixing.mixed(docs).columns and op9_mixing.mixed(docs).count() == len(rows)
    for name in ("op1_quality", "op2_fingerprints", "op3_tokens", "op6_langid"):
        assert name in registry.queries()


@pytest.mark.parametrize("kind", ["empty", "edges"])
def test_stages_on_edges(spark, edges, empty, kind):  # noqa: F811
    import corpus_pipeline as p

    docs = (edges if kind == "edges" else empty).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() <= len(EDGES) + 10
