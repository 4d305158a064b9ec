"""Filter interaction audit: what every filter removes in every order, and each filter's Shapley share.

A document is reduced to the set of filters that it fails, a part of the corpus to the counts of its 32 sets, and those to
a table of coalitions: the documents that any filter of the coalition removes. Everything follows from that table. A step of
an order removes the difference of two coalitions. The shares are the weighted least squares fit of an additive model to the
coalitions, bound to be exact on the whole one (efficiency): the normal equations are solved in rationals, once, as they are
the same for every part but for their right side.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise, read

#: The filters; bit k of a mask stands for the letter at place k.
LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 200, 50, 2, "[#$%&*|]"
ALL = (1 << len(LETTERS)) - 1
ORDERS = ["".join(p) for p in permutations(LETTERS)]
COUNTS = ("n", "good", "toxic")


def solved(left: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The matrix x of left @ x = right, by elimination in rationals; left is square and regular."""
    rows = [[*a, *b] for a, b in zip(left, right, strict=True)]
    for k in range(len(rows)):
        at = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[at] = rows[at], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(len(rows)):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k])]
    return [r[len(left) :] for r in rows]


def shares(m: int = len(LETTERS)) -> list[list[Fraction]]:
    """For each of m filters, the factor of every coalition's removals (by mask) in its Shapley value.

    Minimise the sum over coalitions S, neither empty nor whole, of w(S) * (v(S) - sum of x_i in S) ** 2 with
    w(S) = (m - 1) / (comb(m, |S|) * |S| * (m - |S|)), subject to the x_i adding up to v(whole). With a multiplier that is a
    system of m + 1 equations, linear in v.

    >>> [str(x) for x in shares(2)[0]]
    ['0', '1/2', '-1/2', '1/2']
    """
    whole = (1 << m) - 1
    weight = {s: Fraction(m - 1, comb(m, c := s.bit_count()) * c * (m - c)) for s in range(1, whole)}
    left = [[sum((w for s, w in weight.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(m)] + [Fraction(1)] for i in range(m)]
    left.append([Fraction(1)] * m + [Fraction(0)])
    right = [[weight.get(s, Fraction(0)) * (s >> i & 1) for s in range(whole + 1)] for i in range(m)]
    right.append([Fraction(int(s == whole)) for s in range(whole + 1)])
    return solved(left, right)[:m]


def failed(text: Column) -> Column:
    """The mask of the filters A to D that a text fails, by the whole text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    n = F.size(words)
    tests = [
        n < LEAST_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * DISTINCT_PERCENT,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * UPPER_PERCENT,
        text.rlike(MARKS),
    ]
    return sum((F.when(t, F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(tests)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by source and by the set of filters that they fail.

    Texts are read once and go on as digests. Rows of one id and text are counted before the first shuffle, and those of one text,
    source and label before the second, so that a text with a third of all rows is a few rows by task where its smallest id is
    found. A row without an id has no smaller one and is none: it never fails E. An id has a label where any of its rows in labels has.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), digest.alias("digest"), failed(F.col("text")).alias("mask")).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    rows = rows.join(materialise(marks.where("good + toxic > 0"), "labels"), "doc_id", "left").na.fill(0, ["good", "toxic"])
    one = rows.groupBy("digest", "part", "mask", "good", "toxic", F.col("doc_id").isNull().alias("bare")).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    # a table, so that the join below has shuffles of its own, whose hot texts the adaptive plan splits
    one = materialise(one, "copies")
    least = materialise(one.groupBy("digest").agg(F.min("first").alias("least")), "least")
    both = one.join(least, "digest")
    kept = F.when(F.col("bare"), F.col("n")).when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(F.lit(0))
    last = F.lit(1 << (len(LETTERS) - 1))
    sides = F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - kept).alias("n")))
    split = both.select("part", "good", "toxic", F.explode(sides).alias("s"))
    return split.groupBy("part", F.col("s.mask").alias("mask")).agg(F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("good")).alias("good"), F.sum(F.col("s.n") * F.col("toxic")).alias("toxic"))


def coalitions(counted: DataFrame) -> DataFrame:
    """(part, total, n, good, toxic): the rows of a part, and as arrays by mask what the filters of that coalition remove together."""
    removed = [F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c)).otherwise(0)) for s in range(ALL + 1)]).alias(c) for c in COUNTS]
    return counted.groupBy("part").agg(F.sum("n").alias("total"), *removed)


def _steps() -> list[dict]:
    """Every step of every order: its filter's place, and the coalitions before and after it."""
    out = []
    for order in ORDERS:
        before = 0
        for k, letter in enumerate(order):
            own = LETTERS.index(letter)
            out.append({"filter_order": order, "step": k + 1, "own": own, "before": before, "after": before | 1 << own})
            before |= 1 << own
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; the columns are those of the contract.

    Nulls: a null text is empty, a null source the part ''; a row without an id neither fails E nor makes others fail it. Repeated
    rows of one id and text all count, and none is the copy of another. Texts of any length are read whole. An empty table gives
    no row; an empty table of labels only zeros.
    """
    table = coalitions(cells(docs, labels))
    orders = factorial(len(LETTERS))
    factors = [[x * orders for x in row] for row in shares()]
    if any(x.denominator != 1 for row in factors for x in row):
        raise ArithmeticError("the shares over all orders are not whole numbers")
    fit = F.array(*[sum((F.col("n")[s] * F.lit(int(x)) for s, x in enumerate(row) if x), F.lit(0)).cast("bigint") for row in factors])
    kind = "array<struct<filter_order: string, step: int, own: int, before: int, after: int>>"
    rows = table.withColumn("fit", fit).withColumn("s", F.explode(F.from_json(F.lit(json.dumps(_steps())), kind)))

    def gone(counts: str, mask: Column) -> Column:
        return F.get(counts, mask)

    before, after = F.col("s.before"), F.col("s.after")
    alone = F.element_at(F.array(*[F.lit(1 << k) for k in range(len(LETTERS))]), F.col("s.own") + 1)
    removed = gone("n", after) - gone("n", before)
    return rows.select(
        "part", "s.filter_order", "s.step",
        (F.col("total") - gone("n", after)).alias("kept"), removed.alias("removed"), (gone("n", alone) - removed).alias("redundant"),
        (gone("n", F.lit(ALL)) - gone("n", F.lit(ALL) - alone)).alias("unique_fails"),
        (gone("good", after) - gone("good", before)).alias("good_lost"), (gone("toxic", after) - gone("toxic", before)).alias("toxic_lost"),
        F.get("fit", F.col("s.own")).alias("shapley"),
    )


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit() of the whole tables documents and labels; its docstring says what odd input gives."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


#: Every order is played through, step by step, over the documents' sets of failed filters.
SQL = r"""WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS MATERIALIZED (
  SELECT part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN least < d.doc_id THEN 'E' ELSE '' END) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN l USING (doc_id)),
c AS MATERIALIZED (SELECT part, fails, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM f GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || k FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(k) WHERE NOT contains(filter_order, k)),
s AS (SELECT filter_order, i::INT AS step, filter_order[i] AS own, filter_order[:i - 1] AS before FROM o, range(1, 6) r(i) WHERE len(filter_order) = 5),
p AS (SELECT part, filter_order, step, own, n, g, x, contains(fails, own) AS hit, len(translate(fails, before, '')) < len(fails) AS gone, fails = own AS sole FROM c, s),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN sole THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN x ELSE 0 END)::BIGINT AS toxic_lost FROM p GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
