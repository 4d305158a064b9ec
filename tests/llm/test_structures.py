"""Filter audits, chats of reply trees, and repaired conversations, held against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

import pytest
from conftest import SF
from oracle import connect, same
from pyspark.sql import functions as F
from test_documents import edges, empty  # noqa: F401

from foliant.llm import common, op11_audit, op12_chat, op13_repair, registry


@pytest.mark.parametrize("name", ["op11_audit", "op12_chat"])
def test_sql(spark, name):
    same(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name])


# ---- op 11


def test_shares_are_shapley():
    rng = random.Random(1)
    for m in (2, 3, 5):
        factors = op11_audit.shares(m)
        v = [0] + [rng.randrange(1000) for _ in range((1 << m) - 1)]
        for i in range(m):
            plain = Fraction(0)
            for size in range(m):
                for others in combinations([k for k in range(m) if k != i], size):
                    s = sum(1 << k for k in others)
                    plain += Fraction(factorial(size) * factorial(m - size - 1), factorial(m)) * (v[s | 1 << i] - v[s])
            assert sum(f * x for f, x in zip(factors[i], v)) == plain


def played(docs, labels):
    """The contract's rows, filter by filter."""
    least, good, toxic = {}, set(), set()
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    for d, q, x in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if x == 1 else set()
    held = defaultdict(list)
    for d, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {k for k, bad in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), d is not None and least[t] < d]) if bad}
        held[source or ""].append((fails, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part, rows in held.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, k in enumerate(order, 1):
                gone, left = [r for r in left if k in r[0]], [r for r in left if k not in r[0]]
                total[k] += len(gone)
                failing = [r for r in rows if k in r[0]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(len(r[0]) == 1 for r in failing), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(total[key[1][key[2] - 1]])
    return out


def test_audit_brute(spark):
    rng = random.Random(2)
    texts = [None, "", "a b", "X" * 9, "# x", " ".join(f"w{k}" for k in range(250)), "Ab " * 300, "tail " * 250 + "|"]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "s", "t"])) for _ in range(200)]
    docs += [(3, "same", "s"), (3, "same", "s"), (3, "same", "t"), (4, "same", "s"), (None, "same", "s"), (900, "word " * 200_000, "long")]
    labels = [(k % 25, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(40)] + [(None, 1, 1)]
    found = op11_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in found.collect()} == played(docs, labels)


def test_audit_edges(spark, edges, empty):  # noqa: F811
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op11_audit.audit(edges, labels).where("good_lost + toxic_lost > 0").count() == 0
    assert op11_audit.audit(edges, labels).count() == 600
    assert op11_audit.audit(empty, labels).count() == 0


# ---- op 12


def chosen(messages, top):
    """Every path from root to leaf, ranked, by walking up."""
    by = {m[0]: m for m in messages}
    answered = {m[1] for m in messages}
    paths = defaultdict(list)
    for leaf in by:
        if leaf in answered:
            continue
        way, at = [], leaf
        while at in by and at not in way:
            way.append(at)
            at = by[at][1]
        if at not in by:
            paths[way[-1]].append((-sum(by[x][2] or 0 for x in way), leaf, way[::-1]))
    return {(root, leaf, k, x, place) for root, found in paths.items() for k, (_, leaf, way) in enumerate(sorted(found)[:top], 1) for place, x in enumerate(way)}


@pytest.mark.parametrize("top", [1, 3])
def test_branches_brute(spark, top):
    rng = random.Random(3)
    messages = [(k, rng.choice([None, *range(max(k - 6, 0), k)]) if k % 40 else None, rng.choice([None, 0.0, 1.0, 2.5])) for k in range(300)]
    messages += [(1000 + k, 1000 + k - 1 if k else 77_777, 1.0) for k in range(70)]  # a long chain below a message that is not there
    messages += [(2000, 2001, 1.0), (2001, 2000, 1.0), (2002, 2001, 1.0)]  # a ring, and a message below it
    found = op12_chat.branches(spark.createDataFrame(messages, "id long, parent long, score double"), top)
    assert {(r.root, r.path, r.rank, r.id, r.place) for r in found.collect()} == chosen(messages, top)
    every = op12_chat.branches(spark.createDataFrame(messages, "id long, parent long, score double"))
    assert {(r.path, r.id, r.place) for r in every.collect()} == {(x[1], x[3], x[4]) for x in chosen(messages, 10**9)}


def test_branches_of_nothing(spark):
    assert op12_chat.branches(spark.createDataFrame([], "id long, parent long, score double"), 1).count() == 0


HARD = ["<turn>", r"<\turn>", r"<\\turn>", "<<turn>turn>", "</turn>\n", r"<\/turn>", "<text>a<text>", "<", "\\", "<turn", r"\### Assistant: </turn> ok", "", None, "<turn>" * 3, "\n", "é漢😀<text>", "$1 \\1"]


def test_chats_read_back(spark):
    """Texts and roles with every control string come back; the mask covers the assistants' texts and nothing else."""
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate((r, x) for r in ("user", "assistant", "<turn>", None) for x in HARD)]
    messages = op12_chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    back = op12_chat.read_back(op12_chat.chats(*messages, ["conv_id"])).orderBy("conv_id", "piece").collect()
    for c in range(3):
        mine = [r for r in back if r.conv_id == c]
        assert [(t.role, t.text) for r in mine for t in r.turns] == [(a or "", x or "") for k, _, a, x in rows if k == c]
        assert [x for r in mine for x in r.learned] == [x or "" for k, _, a, x in rows if k == c and a == "assistant"]
        for r in mine:
            assert r.formatted.count(op12_chat.CLOSE) == len(r.turns) == r.formatted.count(op12_chat.OPEN) == r.formatted.count(op12_chat.BODY)


def test_chat_edges(spark, tmp_path):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, None, "assistant", "first"), (2, 5, "assistant", "long " * 200_000)]
    rows += [(9, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(100)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash")).repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    same(op12_chat.op12_chat(spark, str(tmp_path)), connect(str(tmp_path)), op12_chat.SQL)
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert [r.conv_id for r in op12_chat.op12_chat(spark, str(tmp_path / "none")).collect()] == [-7]


# ---- op 13


def test_trails():
    """Comparisons agree with those of the strings, also where the hashes of all trails collide."""
    rng = random.Random(5)
    for base in (op13_repair.BASE, 0):
        t = op13_repair.Trails(base)
        nodes = [0]
        for _ in range(300):
            nodes.append(t.add(rng.choice(nodes[-20:]), rng.choice(["D", "I", "K", "KI", "KD"])))
        for _ in range(3000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert t.less(a, b) == (t.text(a) < t.text(b))
            n = t.common(a, b)
            x, y = t.pieces(a), t.pieces(b)
            assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def mended(rows):
    """The contract's row of one conversation: states and whole audits, side by side."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{r[2]}\n{r[3]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    after = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    given = {0: (2, "user"), 1: (2, "user"), 3: (2, "user"), 2: (3, "assistant")}

    def put(best, state, *value):
        if state not in best or value < best[state]:
            best[state] = value

    def insertions(best):
        for _ in range(3):
            for s, (cost, audit, made) in list(best.items()):
                put(best, given[s][0], cost + 3, audit + "I", (*made, (given[s][1], "")))

    best = {0: (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults):
        insertions(best)
        new = {}
        for s, (cost, audit, made) in best.items():
            put(new, s, cost + 4, audit + "D", made)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if s in after.get(role[:1], {}):
                put(new, after[role[:1]][s], cost + more, audit + "K", (*made, (role, text)))
            put(new, given[s][0], cost + more + 3, audit + "R", (*made, (given[s][1], text)))
        best = new
    insertions(best)
    cost, audit, made = min(best[s] for s in (0, 3) if s in best)
    turns = [r[1] for r in rows if r[1] is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
    )


def whole(rows):
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    return {c: mended(x) for c, x in by.items()}


@pytest.mark.parametrize("shift", [8, 1])
def test_repair_brute(spark, tmp_path, monkeypatch, shift):
    monkeypatch.setattr(op13_repair, "SHIFT", shift)
    rng = random.Random(shift)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "use"], ["Yes.", "No", "", None, " \t", "a!\n", "ok?"]
    rows = [(c, t, rng.choice(roles if c % 3 else roles[:3]), rng.choice(texts if c % 2 else [f"t{t}.", f"x{t}"])) for c in range(120) for t in range(rng.randrange(1, 14))]
    rows += [(None, t, "user", "hm.") for t in (None, None, 3)] + [(500, k // 3, rng.choice(roles[:2]), f"n{k % 40}.") for k in range(400)] + [(600, 1, "user", "long " * 200_000)]
    rows += [(700, None, "user", "x."), (700, None, "assistant", "y.")] + [(c, 0, "user", "gone?") for c in range(1000, 1030)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("first", F.lit("clash")).repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: tuple(r)[1:] for r in op13_repair.op13_repair(spark, str(tmp_path)).collect()}
    assert found == whole(rows)
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in found.values())


def test_repair_query(spark):
    rows = [tuple(r) for r in common.read(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in op13_repair.op13_repair(spark, SF).collect()} == whole(rows)


def test_repair_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert op13_repair.op13_repair(spark, str(tmp_path)).count() == 0
