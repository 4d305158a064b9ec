"""Conversation structure repair: the cheapest edits that give a conversation's roles a lawful order, and their audit.

Rows are put in order once and cut into segments of neighbours. A segment is a short string of codes (role initial and fault
of every row); by a dynamic program over four states it becomes the cheapest edits from every state before it to every
state behind it. A conversation folds the tables of its segments in order. Both programs keep their audits as a trail of
linked nodes that share their prefixes; ties go to the audit that is least in ASCII, which the longest common prefix of two
trails decides.

Two audits of one cost over the same rows are never one the beginning of the other: what follows would be insertions, which
cost. So the order of two prefixes stands whatever comes behind them, and the least may be kept by state and segment.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read
from .ordered import in_order

#: A segment covers 2 ** SHIFT numbers of neighbouring rows.
SHIFT = 8
#: The costs of the edits, and of a row that stays though it is cut off.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user's, after an assistant's; the second of each pair is the state behind that role.
STATES = range(4)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
#: The state behind a user's or assistant's turn that is put in or given its role.
GIVEN = {0: 2, 1: 2, 3: 2, 2: 3}
ROLE = {2: "user", 3: "assistant"}
DONE = (0, 3)
#: Modulus and base of the rolling hashes.
MODULUS, BASE = (1 << 61) - 1, 911382323


class Trails:
    """Strings of edits as linked nodes: a trail is its last node; trails share the nodes of their common beginnings.

    Every node has its ancestors at distances of the powers of two, and the hash of all pieces up to it.

    >>> t = Trails()
    >>> a, b = t.add(t.add(0, "K"), "D"), t.add(t.add(0, "K"), "R")
    >>> t.less(a, b), t.less(b, a), t.text(a)
    (True, False, 'KD')
    """

    def __init__(self, base: int = BASE) -> None:
        self.piece, self.depth, self.hash, self.up, self.base = [""], [0], [0], [[]], base

    def add(self, node: int, piece: str) -> int:
        ups, at, k = [node], node, 0
        while k < len(self.up[at]):
            at = self.up[at][k]
            ups.append(at)
            k += 1
        self.piece.append(piece)
        self.depth.append(self.depth[node] + 1)
        code = int.from_bytes(piece.encode(), "big") + 1
        self.hash.append((self.hash[node] * self.base + code) % MODULUS)
        self.up.append(ups)
        return len(self.piece) - 1

    def above(self, node: int, depth: int) -> int:
        """The ancestor of node (or node) that has so many pieces."""
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def pieces(self, node: int, depth: int = 0) -> list[str]:
        """The pieces of a trail behind its first so many."""
        out = []
        while self.depth[node] > depth:
            out.append(self.piece[node])
            node = self.up[node][0]
        return out[::-1]

    def text(self, node: int) -> str:
        return "".join(self.pieces(node))

    def common(self, a: int, b: int) -> int:
        """How many first pieces two trails share: a search by powers of two over hashes, each equality of which is verified."""
        a, b = (self.above(x, min(self.depth[a], self.depth[b])) for x in (a, b))
        if self.hash[a] != self.hash[b]:
            for k in reversed(range(len(self.up[a]))):
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
            a, b = self.up[a][0], self.up[b][0]
        # a shared node is a shared beginning; of two nodes with one hash the pieces are compared up to where they meet
        found, least = self.depth[a], self.depth[a]
        while a != b:
            least -= 1
            if self.piece[a] != self.piece[b]:
                found = least
            a, b = self.up[a][0], self.up[b][0]
        return found

    def less(self, a: int, b: int) -> bool:
        """Whether the text of trail a stands before that of b in ASCII."""
        n = self.common(a, b)
        x, y = (self.piece[self.above(t, n + 1)] if self.depth[t] > n else "" for t in (a, b))
        if x.startswith(y) or y.startswith(x):
            # pieces of several edits can begin alike: what follows decides
            x, y = ("".join(self.pieces(t, n)) for t in (a, b))
        return x < y


def _offer(trails: Trails, best: dict, state: int, cost: int, node: int, piece: str) -> None:
    """Takes node with piece behind it as the trail of state where it is cheaper, or as cheap and less."""
    held = best.get(state)
    if held is None or cost < held[0]:
        best[state] = (cost, trails.add(node, piece))
    elif cost == held[0] and trails.less(new := trails.add(node, piece), held[1]):
        best[state] = (cost, new)


def _inserted(trails: Trails, best: dict) -> None:
    """Every state that inserted turns reach, beside the states that best has; two turns reach all."""
    for _ in range(2):
        for state, (cost, node) in list(best.items()):
            _offer(trails, best, GIVEN[state], cost + INSERT, node, "I")


@lru_cache(4096)
def paths(codes: str) -> list[tuple[int, int, int, str]]:
    """(start, end, cost, audit): the cheapest edits of a segment from every state to every state, insertions behind its last row left out.

    A code is two characters: the role's initial (s, u, a or x for any other) and the fault (. none, t truncated, - to be deleted).
    """
    out = []
    for start in STATES:
        trails = Trails()
        best = {start: (0, 0)}
        for k in range(0, len(codes), 2):
            role, fault = codes[k], codes[k + 1]
            _inserted(trails, best)
            new: dict[int, tuple[int, int]] = {}
            for state, (cost, node) in best.items():
                _offer(trails, new, state, cost + DELETE, node, "D")
                if fault == "-":
                    continue
                stays = cost + (TRUNCATED if fault == "t" else 0)
                if state in KEPT[role]:
                    _offer(trails, new, KEPT[role][state], stays, node, "K")
                _offer(trails, new, GIVEN[state], stays + REROLE, node, "R")
            best = new
        out += [(start, end, cost, trails.text(node)) for end, (cost, node) in sorted(best.items())]
    return out


def folded(tables: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """The cost of a whole conversation, and the state before and the audit of every segment; the last one has the insertions at the end too."""
    trails = Trails()
    best, before = {0: (0, 0)}, {0: 0}
    for table in tables:
        new: dict[int, tuple[int, int]] = {}
        for start, end, cost, audit in table:
            if start in best:
                at, n = best[start][1], len(trails.piece)
                _offer(trails, new, end, best[start][0] + cost, at, audit)
                if len(trails.piece) > n:
                    before[n] = start
        best = new
    last = dict(best)
    _inserted(trails, last)
    cost, node, ends = None, 0, None
    for state in DONE:
        if state in last and (cost is None or last[state][0] < cost or last[state][0] == cost and trails.less(last[state][1], node)):
            cost, node, ends = *last[state], state
    end = ""
    while trails.depth[node] > len(tables):
        end, node = trails.piece[node] + end, trails.up[node][0]
    out = []
    while node:
        out.append((before[node], trails.piece[node]))
        node = trails.up[node][0]
    out.reverse()
    if end:
        out[-1] = (out[-1][0], out[-1][1] + end)
    return cost, out


def edits(start: int, audit: str, initials: str) -> list[tuple[int | None, str | None]]:
    """(row, role) of every turn that a segment's audit leaves: row None for an inserted turn, role None where it stays as it is."""
    out, row, state = [], 0, start
    for letter in audit:
        if letter != "D":
            kept = letter == "K"
            state = KEPT[initials[row]][state] if kept else GIVEN[state]
            out.append((None if letter == "I" else row, None if kept else ROLE[state]))
        row += letter != "I"
    return out


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): what is left of conversations after faults that follow from a checksum of conv_id and turn.

    A null counts as one space. By the remainder: 0 drops the row, 1 empties its text, 2 takes its sentence marks, 3 repeats it, 4 gives it to the user.
    """
    blank = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(blank[0], F.lit(":"), blank[1]).cast("binary")) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(blank[2])
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank[3], "[.!?]", "")).otherwise(blank[3])
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text"), copies.alias("c")).where("kind <> 0").select("conv_id", "turn", "role", "text", F.explode("c")).drop("col")


def last_mark(text: Column) -> Column:
    """The last character that is not blank; empty where there is none."""
    return F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, seg, first, rows, codes, n_blank, n_duplicate, n_truncated, turns): the neighbours of a conversation that one segment holds; a table.

    Rows stand by turn (nulls first), then by a digest of role and text. first is the number of the segment's first row, by which it is known.
    """
    digest = F.sha2(F.concat_ws("\n", "role", "text"), 256)
    table = in_order(rows.withColumn("digest", digest), ["conv_id"], ["turn", "digest"], "id")
    # the first of rows alike is one row; no row of a hot group looks for the others
    firsts = table.groupBy("conv_id", "digest").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("new"))
    both = table.join(firsts, "id", "left")
    mark = last_mark(F.col("text"))
    initial = F.substring("role", 1, 1)
    fault = F.when(mark == "", "b").when(F.col("new").isNull(), "d").when(~mark.rlike("[.!?]"), "t").otherwise(".")
    coded = both.select("conv_id", (F.shiftrightunsigned("id", SHIFT)).alias("seg"), "id", "turn", "role", "text", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault.alias("fault"))
    held = coded.groupBy("conv_id", "seg").agg(F.min("id").alias("first"), F.sort_array(F.collect_list(F.struct("id", "turn", "role", "text", "initial", "fault"))).alias("rows"))
    codes = F.array_join(F.transform("rows", lambda r: F.concat(r["initial"], F.when(r["fault"].isin("b", "d"), "-").otherwise(r["fault"]))), "")
    turns = F.array_distinct(F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull()))

    def faults(kind: str) -> Column:
        return F.size(F.filter("rows", lambda r: r["fault"] == kind)).cast("bigint")

    out = held.select("conv_id", "seg", "first", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows"), codes.alias("codes"), faults("b").alias("n_blank"), faults("d").alias("n_duplicate"), faults("t").alias("n_truncated"), turns.alias("turns"))
    return materialise(out, "segments")


PATHS = "array<struct<start: int, end: int, cost: bigint, audit: string>>"
FOLD = "struct<cost: bigint, audit: string, segments: array<struct<first: bigint, edits: array<struct<row: int, role: string>>>>>"


def paths_of(codes: pd.Series) -> pd.Series:
    return pd.Series([paths(c) for c in codes], dtype=object)


def fold_of(parts: pd.Series) -> pd.DataFrame:
    out = []
    for p in parts:
        cost, chosen = folded([[(t["start"], t["end"], t["cost"], t["audit"]) for t in s["paths"]] for s in p])
        out.append((cost, "".join(a for _, a in chosen), [{"first": s["first"], "edits": [{"row": r, "role": x} for r, x in edits(*c, s["initials"])]} for s, c in zip(p, chosen)]))
    return pd.DataFrame(out, columns=["cost", "audit", "segments"])


def audits(segs: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation of conversations(conv_id): gaps, the counts of faults, illegal, cost, audit, and the edits by segment; a table."""
    ends = segs.select("conv_id", F.struct("seg", "first", F.pandas_udf(paths_of, PATHS)("codes").alias("paths"), "n_blank", "n_duplicate", "n_truncated", F.size("turns").alias("n_turns"), F.get("turns", F.lit(0)).alias("low"), F.element_at(F.when(F.size("turns") > 0, F.col("turns")), -1).alias("high"), F.regexp_replace("codes", "(.).", "$1").alias("initials")).alias("p"))
    every = conversations.select("conv_id").distinct().select("conv_id", F.lit(None).cast(ends.schema["p"].dataType).alias("p"))
    whole = ends.unionByName(every).groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))

    def total(name: str) -> Column:
        return F.coalesce(F.aggregate("p", F.lit(0).cast("bigint"), lambda a, s: a + s[name]), F.lit(0))

    # neighbours across the border of two segments: an equal turn counts once, and the pair of initials is one more pair
    shared = F.aggregate(F.zip_with(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", F.lit(2), F.size("p")), lambda a, b: F.coalesce((a["high"] == b["low"]).cast("bigint"), F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    initials = F.array_join(F.transform("p", lambda s: s["initials"]), "")
    pairs = F.greatest(F.length(initials) - 1, F.lit(0))
    lawful = F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    span = F.array_max(F.transform("p", lambda s: s["high"])) - F.array_min(F.transform("p", lambda s: s["low"])) + 1
    fold = F.pandas_udf(fold_of, FOLD)(F.transform("p", lambda s: F.struct(s["first"].alias("first"), s["paths"].alias("paths"), s["initials"].alias("initials"))))
    out = whole.select("conv_id", F.coalesce(span - (total("n_turns") - shared), F.lit(0)).alias("gaps"), total("n_blank").alias("blank"), total("n_duplicate").alias("duplicate"), total("n_truncated").alias("truncated"), (pairs - lawful).cast("bigint").alias("illegal"), fold.alias("f"))
    return materialise(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "f.cost", "f.audit", F.col("f.segments").alias("segments")), "audits")


def repaired(segs: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, seg, turns): what every segment's edits leave, as turns of role and text in order; an inserted turn has an empty text."""
    plan = audited.select(F.explode("segments").alias("s")).select("s.first", "s.edits")
    rows = segs.select("conv_id", "seg", "first", "rows").join(plan, "first")
    turns = F.transform("edits", lambda e: F.struct(F.coalesce(e["role"], F.get("rows", e["row"])["role"]).alias("role"), F.when(e["row"].isNull(), "").otherwise(F.get("rows", e["row"])["text"]).alias("text")))
    return rows.select("conv_id", "seg", turns.alias("turns"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conv_id, null included, with the counts, costs and digest of the contract.

    Nulls count as one space, null turns stand first, rows alike all count (the later ones as duplicates), and rows of one turn
    stand by a digest of role and text. Texts and conversations of any length are taken whole; a conversation's digest needs its
    repaired turns in one row in the end. An empty table gives no row.
    """
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    segs = segments(damage(rows))
    audited = audits(segs, rows)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    pieces = repaired(segs, audited).where(F.size("turns") > 0).select("conv_id", F.struct("seg", lines.alias("lines")).alias("piece"))
    own = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    base = audited.select("conv_id", *own).unionByName(pieces, allowMissingColumns=True)
    whole = base.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in own], F.sort_array(F.collect_list("piece")).alias("pieces"))
    return whole.select("conv_id", *own, F.sha2(F.array_join("pieces.lines", "\n"), 256).alias("repaired_sha256"))
