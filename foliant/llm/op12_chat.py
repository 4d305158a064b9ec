"""Chat formatting of reply trees: paths from root to leaf, branches ranked by score, one conversation a path.

Messages point to the message that they answer. Iterated self-joins double the reach of the pointers, so a tree of depth n
takes log2(n) rounds, each on the pointers that reach that far alone. From these tables every leaf finds its root
and the score of its branch, and every chosen branch its messages, again a join for each power of two.
A path is formatted in pieces of a few turns, so that neither a shuffle nor a mask ever holds a long conversation
as one row. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read
from .ordered import in_order

#: The template: a turn is OPEN, its role, BODY, its text, CLOSE. The characters of an assistant's text are under the loss mask.
OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>\n"
LEARNED = "assistant"
#: A control string inside a text or role gets one more backslash behind its first character than it has; those without stay as they are.
CONTROL = r"(turn>|text>|/turn>)"
#: Turns that one formatted piece holds.
PIECE = 16
#: A conversation that tries the escapes.
TRIAL = (-7, r"\### Assistant: </turn> ok")


def escaped(text: Column) -> Column:
    r"""text without control strings: <turn> becomes <\turn>, <\turn> becomes <\\turn>, and so on.

    A match begins with < and holds no other, so matches are apart, and unescaped() takes one backslash from each of them.
    """
    return F.regexp_replace(text, r"<(\\*)" + CONTROL, r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)" + CONTROL, "<$1$2")


def jumps(edges: DataFrame, n_messages: int) -> tuple[list[DataFrame], bool]:
    """Tables (id, up, total): by k, the ancestor 2 ** k steps above id and the scores from id up to, and without, it.

    Also whether the last table holds messages that never reach a root, as their replies form a ring.
    """
    out = [materialise(edges, "jumps")]
    while out[-1].limit(1).count():
        if 1 << len(out) > 2 * max(n_messages, 1):
            return out, True
        a, b = out[-1].alias("a"), out[-1].alias("b")
        out.append(materialise(a.join(b, F.col("a.up") == F.col("b.id")).select("a.id", "b.up", (F.col("a.total") + F.col("b.total")).alias("total")), "jumps"))
    return out[:-1], False


def branches(messages: DataFrame, top: int | None = None) -> DataFrame:
    """(root, path, rank, id, place): the messages of every chosen path from root to leaf, place counting from 0 at the root.

    messages has id (unique, not null), parent and score. A path is named by its leaf. The paths of a root rank by the sum of
    their messages' scores, the larger first, ties by the smaller leaf; top keeps the first so many (all where it is null). A message
    whose parent is null or not there is a root; a null score is 0. Messages on a ring of replies, or below one, are on no path. An
    empty table gives an empty one.
    """
    nodes = materialise(messages.select("id", "parent", F.coalesce("score", F.lit(0)).cast("double").alias("score")), "nodes")
    edges = nodes.join(nodes.select(F.col("id").alias("parent")), "parent").select("id", F.col("parent").alias("up"), F.col("score").alias("total"))
    tables, ring = jumps(edges, nodes.count())
    leaves = nodes.join(nodes.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    if ring:
        leaves = leaves.join(tables[-1].select("id"), "id", "left_anti")
    # every leaf goes up by the largest powers first: at is its root in the end
    found = leaves.select(F.col("id").alias("path"), F.col("id").alias("at"), F.lit(0).cast("bigint").alias("depth"), F.lit(0.0).alias("total"))
    for k in reversed(range(len(tables))):
        step = tables[k].select(F.col("id").alias("at"), "up", F.col("total").alias("more"))
        found = found.join(step, "at", "left").select("path", F.coalesce("up", "at").alias("at"), (F.col("depth") + F.when(F.col("up").isNull(), 0).otherwise(1 << k)).alias("depth"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"))
    roots = nodes.select(F.col("id").alias("at"), F.col("score").alias("own"))
    found = found.join(roots, "at").select("path", F.col("at").alias("root"), "depth", (F.col("total") + F.col("own")).alias("total"))
    if top is None:
        chosen = found.withColumn("rank", F.lit(None).cast("int"))
    else:
        # a bound on the rank is applied in every task before the shuffle
        chosen = found.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("total"), "path"))).where(F.col("rank") <= top)
    chosen = materialise(chosen, "paths")
    # and down again: the messages at every distance from the leaf, by the powers of two in the distance
    members = chosen.select("root", "path", "rank", "depth", F.col("path").alias("id"), F.lit(0).cast("bigint").alias("far"))
    for k in reversed(range(len(tables))):
        both = members.join(tables[k].select("id", "up"), "id", "left")
        reached = F.array(F.struct(F.col("id").alias("id"), F.col("far").alias("far")), F.struct(F.col("up").alias("id"), (F.col("far") + (1 << k)).alias("far")))
        members = both.select("root", "path", "rank", "depth", F.explode(F.when(F.col("up").isNull(), F.slice(reached, 1, 1)).otherwise(reached)).alias("m")).select("root", "path", "rank", "depth", "m.id", "m.far")
    return members.select("root", "path", "rank", "id", (F.col("depth") - F.col("far")).alias("place"))


def formatted(chosen: DataFrame, messages: DataFrame, keep: list[str]) -> DataFrame:
    """(root, path, rank, keep..., piece, formatted, loss): the pieces of every path; a path's text is its pieces in order, joined by nothing.

    loss has (start, length) in code points of the piece, start from 0, of every text under the mask. keep are columns of messages
    that are the same in all messages of a path. Null roles and texts are empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = messages.select("id", *keep, F.concat(F.lit(OPEN), escaped(role), F.lit(BODY)).alias("head"), escaped(text).alias("body"), (role == LEARNED).alias("learned"))
    rows = chosen.join(said, "id").withColumn("piece", F.floor(F.col("place") / PIECE))
    turns = rows.groupBy("root", "path", "rank", *keep, "piece").agg(F.sort_array(F.collect_list(F.struct("place", "head", "body", "learned"))).alias("turns"))
    sizes = F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE))
    spans = F.transform("turns", lambda t, i: F.struct((F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n) + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"), t["learned"].alias("learned")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    loss = F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return turns.select("root", "path", "rank", *keep, "piece", whole.alias("formatted"), loss.alias("loss"))


def read_back(pieces: DataFrame) -> DataFrame:
    """pieces with turns (role and text, unescaped) and learned (the texts under the mask, unescaped), both from formatted alone."""
    parts = F.split("formatted", CLOSE)
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct(unescaped(F.substr(F.substring_index(p, BODY, 1), F.lit(len(OPEN) + 1))).alias("role"), unescaped(F.substr(p, F.instr(p, BODY) + len(BODY))).alias("text")))
    learned = F.transform("loss", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["length"])))
    return pieces.withColumns({"turns": turns, "learned": learned})


def chains(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations without branches, as messages: (id, parent, score), where every row answers the one before it, and (id, conv_id, role, text).

    Rows stand by turn (nulls first), then by a digest of role and text. Rows without conv_id are one conversation. The texts stay apart
    from the pointers, which alone are joined again and again.
    """
    digest = F.sha2(F.concat_ws("\n", "role", "text"), 256)
    table = in_order(rows.select("conv_id", "turn", "role", "text", digest.alias("digest")), ["conv_id"], ["turn", "digest"], "id")
    part = F.shiftrightunsigned("id", 33)
    slim = table.select("conv_id", "id", part.alias("part"))
    near = slim.withColumn("parent", F.lag("id").over(Window.partitionBy("conv_id", "part").orderBy("id")))
    # a conversation goes on from an earlier part in the first rows of a part only: at most one row a part
    ends = slim.groupBy("conv_id", "part").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    far = materialise(ends.select("id", F.lag("last").over(Window.partitionBy("conv_id").orderBy("part")).alias("far")).where("far is not null"), "far")
    linked = near.select("id", "parent").join(F.broadcast(far), "id", "left").select("id", F.coalesce("parent", "far").alias("parent"))
    return linked.withColumn("score", F.lit(0.0)), table.select("id", "conv_id", "role", "text")


def chats(tree: DataFrame, messages: DataFrame, keep: list[str], top: int | None = 1) -> DataFrame:
    """The pieces of the best paths of every tree(id, parent, score), formatted with the texts of messages; a table of the shared folder."""
    return materialise(formatted(branches(tree, top), messages, keep), "chats")


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, read back from what was formatted.

    Null roles and texts are empty, a null turn stands first, repeated rows all count, rows without conv_id are one conversation, and an
    empty table leaves the trial conversation alone. Texts of any length are formatted whole; a conversation's digest needs its turns
    in one row in the end, which is the only place where they meet.
    """
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    trial = spark.range(2).select(F.lit(TRIAL[0]).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRIAL[1]).alias("text"))
    back = read_back(chats(*chains(rows.unionByName(trial)), ["conv_id"]))
    piece = back.select(
        "conv_id", "path", "piece", F.size("turns").cast("bigint").alias("n"), F.length("formatted").cast("bigint").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), F.array_join("learned", "").alias("learned"),
    )
    whole = piece.groupBy("conv_id", "path").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("piece", "said", "learned"))).alias("p"))
    learned = F.array_join("p.learned", "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join("p.said", ""), 256).alias("turns_sha256"), F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(concat_ws(chr(10), role, text)) AS digest FROM conversations
  UNION ALL SELECT -7, k, role, '\### Assistant: </turn> ok', '' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, role)),
e AS (SELECT *, regexp_replace(role, '<(\\*)(turn>|text>|/turn>)', '<\\\1\2', 'g') AS er, regexp_replace(text, '<(\\*)(turn>|text>|/turn>)', '<\\\1\2', 'g') AS et FROM r),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, digest) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, digest) FILTER (role = 'assistant'), '') AS learned, sum(length('<turn>' || er || '<text>' || et || '</turn>' || chr(10)))::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g"""
