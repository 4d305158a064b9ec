"""Mixing sources to target weights by iterative proportional fitting.

The corpus is summed to cells of source, language and topic. Their token weights are raked in turn to the
target shares of each of the three, ``ROUNDS`` times, after which ``residuals`` tells how well all marginals fit; a cell's weight over its tokens gives the
probability by which each of its documents is sampled, scaled so that the expected tokens are the
budget. A document's fate follows from a hash of its id alone, so a second run samples the same ones.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise, read

#: The margins, in the order in which they are raked.
MARGINS = ("source", "lang", "topic")
#: A target share is the observed one to this power, normalised: 1 keeps the mix, 0 gives all values the same.
TEMPERATURES = {"source": 0.5, "lang": 0.7, "topic": 0.9}
ROUNDS = 12
#: The share of all tokens that the sample should hold.
BUDGET = 0.7
#: What a null source or language counts as.
NONE = ""


def topic(text: Column) -> Column:
    """A coarse topic by form, the first that fits: legal, tabular, noisy, short, long, prose. A null text is short."""
    n = F.greatest(F.length(text), F.lit(1))
    return (
        F.when(text.contains("License"), "legal")
        .when(F.regexp_count(text, F.lit(r"\|")) * 20 > n, "tabular")
        .when(F.regexp_count(text, F.lit(r"[#*$%&!]")) * 20 > n, "noisy")
        .when(text.isNull() | (F.length(text) < 400), "short")
        .when(F.length(text) > 8000, "long")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """Each row of docs as row, beside mix_source, mix_lang, mix_topic and mix_tokens (words; at least one, so that no document is free)."""
    text = F.col("text")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce("source", F.lit(NONE)).alias("mix_source"),
        F.coalesce("lang", F.lit(NONE)).alias("mix_lang"),
        topic(text).alias("mix_topic"),
        F.greatest(F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)), F.lit(1)).cast("bigint").alias("mix_tokens"),
    )


def cell_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*[f"mix_{m}" for m in MARGINS]).agg(F.sum("mix_tokens").alias("tokens"))


def _sum(cells: DataFrame, what) -> float:
    return float(cells.agg(F.sum(what).alias("x")).first()["x"] or 0)


def raked(cells: DataFrame, temperatures: dict[str, float] = TEMPERATURES, rounds: int = ROUNDS) -> DataFrame:
    """cells with weight: token shares raked to the targets of every margin, one after the other, rounds times.

    residuals() tells how far the margins are from their targets after that.
    """
    total = _sum(cells, "tokens")
    out = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    for m in MARGINS:
        share = F.pow(F.sum("tokens") / F.lit(total), F.lit(temperatures[m]))
        whole = _sum(cells.groupBy(f"mix_{m}").agg(share.alias("share")), "share")
        out = out.withColumn(f"share_{m}", F.pow(F.sum("tokens").over(Window.partitionBy(f"mix_{m}")) / F.lit(total), F.lit(temperatures[m])) / F.lit(whole))
    for k in range(rounds):
        for m in MARGINS:
            out = out.withColumn("weight", F.col("weight") * F.col(f"share_{m}") / F.sum("weight").over(Window.partitionBy(f"mix_{m}")))
        if k % 3 == 2:
            out = materialise(out, "cells")
    return out


def probabilities(cells: DataFrame, budget: float = BUDGET, turns: int = 8) -> DataFrame:
    """cells with probability: the weight over the cell's tokens, scaled to the budget; what probabilities of one cannot take, the others share."""
    total = _sum(cells, "tokens")
    out = cells.withColumn("p", F.least(F.lit(1.0), F.col("weight") * F.lit(total) / F.col("tokens") * budget))
    for _ in range(turns):
        spent = out.agg(F.sum(F.col("p") * F.col("tokens")).alias("all"), F.sum(F.when(F.col("p") < 1, F.col("p") * F.col("tokens"))).alias("room")).first()
        if not spent["room"]:
            break
        grow = 1 + max(budget * total - spent["all"], 0.0) / spent["room"]
        out = out.withColumn("p", F.when(F.col("p") < 1, F.least(F.lit(1.0), F.col("p") * F.lit(grow))).otherwise(F.col("p")))
    return out.withColumn("probability", F.round("p", 9)).drop("p")


def residuals(docs: DataFrame, temperatures: dict[str, float] = TEMPERATURES, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """(margin, value, tokens, target, raked, expected, sampled): the token shares of every value of every margin.

    target is what was asked for, raked what the fitting gives, expected the sample's share by the probabilities (which
    cannot pass one, so small cells may miss their targets), and sampled that of the rows that the hash samples. An empty table gives no row.
    """
    rows = described(docs)
    cells = materialise(raked(materialise(cell_totals(rows), "cells"), temperatures, rounds), "cells")
    cells = materialise(probabilities(cells, budget), "cells")
    keys = [f"mix_{m}" for m in MARGINS]
    taken = rows.join(cells.select(*keys, "probability"), keys).where(chance(F.col("row.doc_id")) < F.col("probability"))
    cells = materialise(cells.join(taken.groupBy(*keys).agg(F.sum("mix_tokens").alias("taken")), keys, "left"), "cells")
    expected, sampled = _sum(cells, F.col("probability") * F.col("tokens")), _sum(cells, "taken")
    each = [
        cells.groupBy(F.lit(m).alias("margin"), F.col(f"mix_{m}").alias("value")).agg(
            F.sum("tokens").alias("tokens"), F.first(f"share_{m}").alias("target"), F.sum("weight").alias("raked"),
            (F.sum(F.col("probability") * F.col("tokens")) / F.lit(max(expected, 1e-300))).alias("expected"), (F.coalesce(F.sum("taken"), F.lit(0)) / F.lit(max(sampled, 1e-300))).alias("sampled"),
        )
        for m in MARGINS
    ]
    return each[0].unionByName(each[1]).unionByName(each[2])


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) that follows from the id alone; a null id counts as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def _mixed(docs: DataFrame, temperatures: dict[str, float], budget: float, rounds: int) -> DataFrame:
    """(row, mix_topic, mix_tokens, probability, sampled), one row per row of docs."""
    rows = described(docs)
    keys = [f"mix_{m}" for m in MARGINS]
    # sums of cells and their raking are small beside the corpus; the join back is left to the optimiser, which splits a hot cell
    cells = materialise(probabilities(raked(materialise(cell_totals(rows), "cells"), temperatures, rounds), budget).select(*keys, "probability"), "cells")
    return rows.join(cells, keys).withColumn("sampled", chance(F.col("row.doc_id")) < F.col("probability"))


def mixed(docs: DataFrame, temperatures: dict[str, float] = TEMPERATURES, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """docs with mix_topic, mix_tokens, probability and sampled; every row of docs is there, repeated rows with the same fate.

    A null source or language is a value of its own, a null text is short with one token, an empty table stays empty. Columns of docs keep their values, but for those with the new names.
    """
    own = ["mix_topic", "mix_tokens", "probability", "sampled"]
    return _mixed(docs, temperatures, budget, rounds).select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in own], *own)


def sample(docs: DataFrame, temperatures: dict[str, float] = TEMPERATURES, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """The sampled rows of docs, all columns as they were."""
    return _mixed(docs, temperatures, budget, rounds).where("sampled").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixed() of all documents: one row per row, repeated ones with the same fate; nulls are values of their own, an empty table gives no row, texts are counted whole."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixed(docs).select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), "probability", "sampled")


def _sql() -> str:
    """The same steps for DuckDB, written out round by round."""
    steps = [
        """d AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l,
  CASE WHEN contains(text, 'License') THEN 'legal'
       WHEN len(regexp_extract_all(text, '\\|')) * 20 > greatest(length(text), 1) THEN 'tabular'
       WHEN len(regexp_extract_all(text, '[#*$%&!]')) * 20 > greatest(length(text), 1) THEN 'noisy'
       WHEN text IS NULL OR length(text) < 400 THEN 'short' WHEN length(text) > 8000 THEN 'long' ELSE 'prose' END AS t,
  greatest(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0), 1)::BIGINT AS n FROM documents)""".replace("\\\\", "\\"),
        "c AS MATERIALIZED (SELECT s, l, t, sum(n)::DOUBLE AS n FROM d GROUP BY ALL)",
        "whole AS MATERIALIZED (SELECT sum(n) AS n FROM c)",
    ]
    for k, m in zip("slt", MARGINS):
        steps.append(f"g{k} AS MATERIALIZED (SELECT {k}, pow(sum(n) / (SELECT n FROM whole), {TEMPERATURES[m]}) AS g FROM c GROUP BY {k})")
    steps.append("w0 AS MATERIALIZED (SELECT s, l, t, n, n / (SELECT n FROM whole) AS w FROM c)")
    now = 0
    for _ in range(ROUNDS):
        for k in "slt":
            steps.append(f"w{now + 1} AS MATERIALIZED (SELECT s, l, t, n, w * (g / (SELECT sum(g) FROM g{k})) / sum(w) OVER (PARTITION BY {k}) AS w FROM w{now} JOIN g{k} USING ({k}))")
            now += 1
    steps.append(f"p0 AS MATERIALIZED (SELECT s, l, t, n, least(1.0, w * (SELECT n FROM whole) / n * {BUDGET}) AS p FROM w{now})")
    for k in range(8):
        steps.append(f"f{k} AS MATERIALIZED (SELECT greatest({BUDGET} * sum(n) - sum(p * n), 0) / nullif(sum(CASE WHEN p < 1 THEN p * n ELSE 0 END), 0) AS f FROM p{k})")
        steps.append(f"p{k + 1} AS MATERIALIZED (SELECT s, l, t, n, CASE WHEN p < 1 THEN least(1.0, p * (1 + coalesce(f, 0))) ELSE p END AS p FROM p{k}, f{k})")
    return f"""WITH {", ".join(steps)}
SELECT doc_id, source, lang, t AS topic, d.n AS n_tokens, round(p, 9) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < round(p, 9) AS sampled
FROM d JOIN p8 USING (s, l, t)"""


SQL = _sql()
