"""Answers with citations: evidence lists, extractive sentences, grounding checks, gates, and rules on questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.shared import written
from ..sources.tables import documents, table
from .terms import BM25_SQL, bm25, top

#: The confidence below which no answer is given, and the overlap that supports a claim.
GATE, SUPPORT, FRACTION = 0.18, 0.55, 0.8
QUOTE = 900
NEGATIONS = ["not", "never", "no", "pas", "jamais", "nicht", "kein", "nie", "nunca", "sin"]
_ASCII_BLANKS = r"[ \t\n\x0B\f\r]+"

QUOTE_SQL = "CASE WHEN length(text) > 900 THEN rtrim(substr(text, 1, 899)) || '…' ELSE text END"
TOP3_SQL = BM25_SQL + """,
hit AS MATERIALIZED (SELECT * FROM (SELECT item_id, doc_id, bm25, confidence, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id)::INT AS rank FROM lex) WHERE rank <= 3)"""


def best_documents(docs: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """(item_id, doc_id, rank, bm25, confidence): the k best documents of each question, as a table: so its size is known where texts join it, and a small one is sent to them."""
    return written(top(bm25(docs, questions), "bm25", k), "hits")


def evidence(docs: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """(item_id, doc_id, rank, marker, quote, bm25, confidence): the k best documents of each question as citations."""
    found = best_documents(docs, questions, k)
    return found.join(docs.select("doc_id", "text"), "doc_id").select("item_id", "doc_id", "rank", F.concat(F.lit("[E"), "rank", F.lit("]")).alias("marker"), T.truncated_quote(F.col("text"), QUOTE).alias("quote"), "bm25", "confidence")


@query(f"WITH {TOP3_SQL} SELECT item_id, doc_id, rank, '[E' || rank || ']' AS marker, bm25, confidence, md5({QUOTE_SQL}) AS quote_digest FROM hit JOIN documents USING (doc_id)")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).withColumn("quote_digest", F.md5("quote")).drop("quote")


@query(f"WITH {TOP3_SQL} SELECT b.item_id, coalesce(max(confidence), 0) AS confidence, CASE WHEN count(doc_id) = 0 THEN 'no evidence' WHEN max(confidence) < 0.18 THEN 'low confidence' ELSE 'answer' END AS decision FROM benchmark b LEFT JOIN hit USING (item_id) GROUP BY b.item_id")
def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each question may be answered at all."""
    questions = table(spark, sf_dir, "benchmark")
    best = top(bm25(documents(spark, sf_dir), questions), "bm25", 3).groupBy("item_id").agg(F.max("confidence").alias("best"))
    decision = F.when(F.col("best").isNull(), "no evidence").when(F.col("best") < GATE, "low confidence").otherwise("answer")
    return questions.select("item_id").join(best, "item_id", "left").select("item_id", F.coalesce("best", F.lit(0.0)).alias("confidence"), decision.alias("decision"))


def _distinct_content(text: Column) -> Column:
    return F.array_distinct(T.content_tokens(text))


#: Our own cues in the corpus languages: words by which a sentence says what something is, and words between the concepts of a question.
DEFINES = ["are", "was", "means", "called", "defined", "sont", "est", "signifie", "ist", "sind", "bedeutet", "heißt", "son", "fue", "significa"]
BETWEEN = r" (?:and|or|versus|vs|et|ou|und|oder|y|o) "
#: The weight of a sentence that defines, in its score and once more where it is matched with a concept.
DEFINITION, MATCHED = 1.8, 2.0
_CUES = ", ".join(f"'{w}'" for w in DEFINES)

SENTENCES_SQL = rf"""
sen AS (SELECT item_id, doc_id, rank, bm25, i::INT AS sentence_no, s AS sentence FROM (
  SELECT item_id, doc_id, rank, bm25, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
    SELECT item_id, doc_id, rank, bm25, list_filter(list_transform(string_split_regex(regexp_replace(q, '([.!?])\s+', '\1' || chr(30), 'g'), '\x1E|\n+'), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(12) || chr(13))), lambda s: s <> '') AS l
    FROM (SELECT item_id, doc_id, rank, bm25, text AS q FROM hit JOIN documents USING (doc_id))))),
qc AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 2)) AS qt FROM benchmark),
cand AS (SELECT item_id, doc_id, rank, sentence_no, sentence, bm25, qt, list_distinct(list_filter(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 2)) AS st FROM sen JOIN qc USING (item_id)),
score AS (SELECT *, len(list_intersect(qt, st)) AS shared, list_has_any(st, [{_CUES}]) AS defines FROM cand),
ranked AS MATERIALIZED (SELECT item_id, doc_id, rank, sentence_no, st, defines, round((0.75 * shared / len(qt) + 0.25 * shared / len(st) + 0.05 * bm25 / (1 + bm25)) * CASE WHEN defines THEN {DEFINITION} ELSE 1.0 END, 6) AS score, lower(sentence) AS key FROM score WHERE shared > 0),
first AS (SELECT *, row_number() OVER (PARTITION BY item_id, key ORDER BY score DESC, rank, sentence_no) AS copy FROM ranked)"""


def candidates(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(item_id, doc_id, rank, sentence_no, st, defines, score, key): the sentences of each question's evidence, whole texts, that share a term with it.

    st are a sentence's distinct content tokens, key tells repeated sentences. A sentence that defines weighs more.
    """
    cited = docs.select("doc_id", "text").join(best_documents(docs, questions), "doc_id").select("item_id", "doc_id", "rank", "bm25", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))
    asked = questions.select("item_id", _distinct_content(F.col("text")).alias("qt"))
    rows = cited.join(asked, "item_id").withColumn("st", _distinct_content(F.col("sentence"))).withColumn("shared", F.size(F.array_intersect("qt", "st"))).where("shared > 0")
    score = 0.75 * F.col("shared") / F.size("qt") + 0.25 * F.col("shared") / F.size("st") + 0.05 * F.col("bm25") / (1 + F.col("bm25"))
    defines = F.arrays_overlap("st", F.array(*map(F.lit, DEFINES)))
    return rows.select("item_id", "doc_id", "rank", (F.col("n") + 1).alias("sentence_no"), "st", defines.alias("defines"), F.round(score * F.when(defines, DEFINITION).otherwise(1.0), 6).alias("score"), F.lower("sentence").alias("key"))


def best_sentences(rows: DataFrame, k: int = 4) -> DataFrame:
    """The k best candidates of each question; a sentence that is repeated counts once, ties go to the better document and the earlier sentence."""
    order = [F.desc("score"), F.asc("rank"), F.asc("sentence_no")]
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("item_id", "key").orderBy(*order))).where("copy = 1")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("place") <= k).select("item_id", "place", "doc_id", "sentence_no", "score")


def extract(docs: DataFrame, questions: DataFrame, k: int = 4) -> DataFrame:
    """The k sentences of each question's evidence that share most with it."""
    return best_sentences(candidates(docs, questions), k)


@query(f"WITH {TOP3_SQL}, {SENTENCES_SQL} SELECT item_id, place, doc_id, sentence_no, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank, sentence_no)::INT AS place FROM first WHERE copy = 1) WHERE place <= 4")
def extractive_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def concepts(questions: DataFrame) -> DataFrame:
    """(item_id, concept_no, concept, terms): the parts of a question between words such as and; a question without one has none, nor has a part without content tokens."""
    parts = F.transform(F.split(F.lower("text"), BETWEEN), lambda p: F.trim(p))
    several = F.when(F.size(parts) > 1, parts).otherwise(F.expr("cast(array() AS array<string>)"))
    rows = questions.select("item_id", F.posexplode(several).alias("concept_no", "concept"))
    return rows.withColumn("terms", _distinct_content(F.col("concept"))).where("size(terms) > 0")


def concept_sentences(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(item_id, concept_no, doc_id, sentence_no, score): for each concept in turn the candidate that fits it best and that no earlier concept has taken.

    The fit is the number of shared terms times the candidate's score, twice that where it defines; of equal fits the first candidate
    is taken, and repeated sentences are one. Concepts meet the sentences that share a term with them alone, and are dealt with by a fold over
    a question's pairs in the order of concept and fit.
    """
    terms = asked.select("item_id", "concept_no", F.explode("terms").alias("term"))
    held = rows.select("item_id", "doc_id", "rank", "sentence_no", "defines", "score", "key", F.explode("st").alias("term"))
    own = ["item_id", "concept_no", "doc_id", "rank", "sentence_no", "defines", "score", "key"]
    met = held.join(terms, ["item_id", "term"]).groupBy(*own).agg(F.count(F.lit(1)).alias("matches"))
    fit = F.round(F.col("matches") * F.when(F.col("defines"), MATCHED).otherwise(1.0) * F.col("score"), 6)
    pairs = F.sort_array(F.collect_list(F.struct("concept_no", (-fit).alias("fit"), (-F.col("score")).alias("less"), "rank", "sentence_no", "doc_id", "key")))
    start = F.expr("named_struct('last', -1, 'used', cast(array() AS array<string>), 'took', cast(array() AS array<struct<concept_no: int, doc_id: bigint, sentence_no: int, score: double>>))")

    def taken(state: Column, pair: Column) -> Column:
        with_pair = F.struct(pair["concept_no"].alias("last"), F.array_append(state["used"], pair["key"]).alias("used"), F.array_append(state["took"], F.struct(pair["concept_no"].alias("concept_no"), pair["doc_id"].cast("bigint").alias("doc_id"), pair["sentence_no"].alias("sentence_no"), (-pair["fit"]).alias("score"))).alias("took"))
        return F.when((pair["concept_no"] == state["last"]) | F.array_contains(state["used"], pair["key"]), state).otherwise(with_pair)

    chosen = met.groupBy("item_id").agg(F.aggregate(pairs, start, taken, lambda s: s["took"]).alias("took"))
    return chosen.select("item_id", F.explode("took").alias("t")).select("item_id", "t.*")


@query(
    f"""WITH RECURSIVE {TOP3_SQL}, {SENTENCES_SQL},
part AS (SELECT item_id, i - 1 AS concept_no, trim(p, ' ') AS concept, list_distinct(list_filter(regexp_extract_all(p, '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 2)) AS ct FROM (
  SELECT item_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT item_id, string_split_regex(lower(text), '{BETWEEN}') AS l FROM benchmark) WHERE len(l) > 1)),
pair AS (SELECT item_id, concept_no::INT AS concept_no, doc_id, rank, sentence_no, score, key, round(len(list_intersect(ct, st)) * CASE WHEN defines THEN {MATCHED} ELSE 1.0 END * score, 6) AS fit FROM part JOIN ranked USING (item_id) WHERE list_has_any(ct, st)),
seq AS MATERIALIZED (SELECT item_id, list({{'c': concept_no, 'f': fit, 'd': doc_id, 'n': sentence_no, 'k': key}} ORDER BY concept_no, fit DESC, score DESC, rank, sentence_no, doc_id, key) AS l FROM pair GROUP BY item_id),
walk AS (
  SELECT item_id, 0 AS i, -1 AS last, []::VARCHAR[] AS used, []::INT[] AS took FROM seq
  UNION ALL
  SELECT item_id, i + 1, CASE WHEN ok THEN l[i + 1].c ELSE last END, CASE WHEN ok THEN list_append(used, l[i + 1].k) ELSE used END, CASE WHEN ok THEN list_append(took, i + 1) ELSE took END
  FROM (SELECT walk.*, l, l[i + 1].c <> last AND NOT list_contains(used, l[i + 1].k) AS ok FROM walk JOIN seq USING (item_id) WHERE i < len(l))),
took AS (SELECT item_id, l[t] AS x FROM (SELECT item_id, l, unnest(took) AS t FROM walk JOIN seq USING (item_id) WHERE i = len(l)))
SELECT item_id, 'concept' AS kind, x.c::INT AS place, concept, x.d AS doc_id, x.n AS sentence_no, x.f AS score FROM took JOIN part ON part.item_id = took.item_id AND concept_no = x.c
UNION ALL SELECT item_id, 'sentence', place, NULL, doc_id, sentence_no, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank, sentence_no)::INT AS place FROM first WHERE copy = 1) WHERE place <= 4 AND item_id NOT IN (SELECT item_id FROM took)""".replace("\\\\", "\\").replace("SELECT item_id, 'concept' AS", "SELECT took.item_id, 'concept' AS")
)
def concept_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to every question: one sentence for each concept that it names, or its four best sentences where it names none or none fits."""
    questions = table(spark, sf_dir, "benchmark")
    rows, asked = written(candidates(documents(spark, sf_dir), questions), "candidates"), concepts(questions)
    found = written(concept_sentences(rows, asked), "concepts")
    named = found.join(asked.select("item_id", "concept_no", "concept"), ["item_id", "concept_no"])
    plain = best_sentences(rows.join(found.select("item_id").distinct(), "item_id", "left_anti"))
    out = named.select("item_id", F.lit("concept").alias("kind"), F.col("concept_no").alias("place"), "concept", "doc_id", "sentence_no", "score")
    return out.unionByName(plain.select("item_id", F.lit("sentence").alias("kind"), "place", F.lit(None).cast("string").alias("concept"), "doc_id", "sentence_no", "score"))


def grounding(answers: DataFrame, evidence: DataFrame, support: float = SUPPORT, fraction: float = FRACTION) -> DataFrame:
    """answers(answer_id, text) against evidence(answer_id, marker, text): one row per answer.

    A claim is a sentence with content tokens. It is supported if a sentence of the evidence that it cites by marker holds enough
    of its content tokens, all its literal facts, and the same polarity. An answer is grounded if it has claims, all are supported, and
    it cites no marker without evidence. Each claim meets the sentences of its own markers only.
    """
    negated = lambda tokens: F.arrays_overlap(tokens, F.array(*map(F.lit, NEGATIONS)))
    known = evidence.groupBy("answer_id").agg(F.collect_set("marker").alias("known"))
    cited = answers.select("answer_id", T.markers(F.col("text")).alias("cited")).join(known, "answer_id", "left")
    has = F.coalesce("known", F.expr("cast(array() AS array<string>)"))
    cited = cited.select("answer_id", F.array_sort(F.array_intersect("cited", has)).alias("valid_markers"), F.array_sort(F.array_except("cited", has)).alias("invalid_markers"))
    each = answers.select("answer_id", F.posexplode(T.sentences(F.col("text"))).alias("claim_no", "claim")).where(F.size(_distinct_content(F.col("claim"))) > 0)
    clean = F.trim(F.regexp_replace("claim", T.MARKER, ""))
    asked = each.select("answer_id", "claim_no", F.explode(T.markers(F.col("claim"))).alias("marker"), _distinct_content(clean).alias("ct"), T.literals(clean).alias("cl"), negated(T.tokens(clean)).alias("cn")).where("size(ct) > 0")
    s = F.col("sentence")
    units = evidence.select("answer_id", "marker", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    units = units.select("answer_id", "marker", _distinct_content(s).alias("st"), T.literals(s).alias("sl"), negated(T.tokens(s)).alias("sn")).where("size(st) > 0")
    fits = (F.size(F.array_except("cl", "sl")) == 0) & (F.col("cn") == F.col("sn"))
    overlap = F.when(fits, F.size(F.array_intersect("ct", "st")) / F.size("ct")).otherwise(F.lit(0.0))
    best = asked.join(units, ["answer_id", "marker"]).groupBy("answer_id", "claim_no").agg(F.max(overlap).alias("best"))
    total = each.groupBy("answer_id").agg(F.count(F.lit(1)).alias("total_claims"))
    backed = best.groupBy("answer_id").agg(F.count_if(F.col("best") >= support).alias("supported_claims"))
    none = F.lit(0).cast("bigint")
    out = cited.join(total, "answer_id", "left").join(backed, "answer_id", "left").withColumns({"total_claims": F.coalesce("total_claims", none), "supported_claims": F.coalesce("supported_claims", none)})
    share = F.when(F.col("total_claims") > 0, F.col("supported_claims") / F.col("total_claims")).otherwise(F.lit(0.0))
    whole = (F.col("total_claims") > 0) & (F.size("invalid_markers") == 0) & (F.col("supported_claims") == F.col("total_claims")) & (share >= fraction)
    return out.select("answer_id", "total_claims", "supported_claims", share.alias("support_fraction"), whole.alias("grounded"), "valid_markers", "invalid_markers")


#: Word boundaries stand for look-around, which DuckDB lacks; a unit takes the character after it along.
_LITERALS_SQL = r"""list_sort(list_distinct(
  list_transform(regexp_extract_all(lower(regexp_replace({x}, '\s+', ' ', 'g')), '\b[0-9]{{1,4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,4}}\b'), lambda m: 'date:' || m)
  || list_transform(regexp_extract_all(lower(regexp_replace({x}, '\s+', ' ', 'g')), '\b([0-9]+(?:[.,][0-9]+)?\s*%)(?:[^\p{{L}}\p{{N}}_]|$)', 1), lambda m: 'percent:' || replace(m, ' ', ''))
  || list_transform(regexp_extract_all(lower(regexp_replace({x}, '\s+', ' ', 'g')), '\b([0-9]+(?:[.,][0-9]+)?\s*(?:[%°ºµ]|\p{{L}}{{1,12}}))(?:[^\p{{L}}\p{{N}}_]|$)', 1), lambda m: 'measure:' || regexp_replace(m, '^([0-9]+(?:[.,][0-9]+)?)\s*', '\1:'))
  || list_transform(regexp_extract_all(lower(regexp_replace({x}, '\s+', ' ', 'g')), '\b[0-9]+(?:[.,][0-9]+)?\b'), lambda m: 'number:' || m)))"""
_SPLIT_SQL = r"list_filter(list_transform(string_split_regex(regexp_replace({x}, '([.!?])\s+', '\1' || chr(30), 'g'), '\x1E|\n+'), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(12) || chr(13))), lambda s: s <> '')"
_CONTENT_SQL = r"list_distinct(list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) > 2))"
_NEGATED_SQL = r"list_has_any(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), [" + ", ".join(f"'{n}'" for n in NEGATIONS) + "])"


@query(
    f"""WITH b AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM conversations),
a AS MATERIALIZED (SELECT conv_id, turn, before, earlier, before || ' [E1] ' || coalesce(earlier, '') || ' [E2] ' || text || ' [e1]' AS answer FROM b WHERE before IS NOT NULL),
ev AS (SELECT conv_id, turn, '[E1]' AS marker, before AS text FROM a UNION ALL SELECT conv_id, turn, '[E2]', earlier FROM a WHERE earlier IS NOT NULL),
mk AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[[eE][0-9]+\\]'), lambda m: upper(m)))) AS cited, CASE WHEN earlier IS NULL THEN ['[E1]'] ELSE ['[E1]', '[E2]'] END AS known FROM a),
cl AS MATERIALIZED (SELECT conv_id, turn, claim_no, claim, regexp_replace(claim, '\\[[eE][0-9]+\\]', '', 'g') AS clean
      FROM (SELECT conv_id, turn, unnest(l) AS claim, generate_subscripts(l, 1) AS claim_no FROM (SELECT conv_id, turn, {_SPLIT_SQL.format(x="answer")} AS l FROM a)) WHERE len({_CONTENT_SQL.format(x="claim")}) > 0),
c AS (SELECT conv_id, turn, claim_no, unnest(list_distinct(list_transform(regexp_extract_all(claim, '\\[[eE][0-9]+\\]'), lambda m: upper(m)))) AS marker, {_CONTENT_SQL.format(x="clean")} AS ct, {_LITERALS_SQL.format(x="clean")} AS cl, {_NEGATED_SQL.format(x="clean")} AS cn FROM cl),
s AS (SELECT conv_id, turn, marker, {_CONTENT_SQL.format(x="sentence")} AS st, {_LITERALS_SQL.format(x="sentence")} AS sl, {_NEGATED_SQL.format(x="sentence")} AS sn
      FROM (SELECT conv_id, turn, marker, unnest({_SPLIT_SQL.format(x="text")}) AS sentence FROM ev)),
p AS (SELECT c.conv_id, c.turn, claim_no, max(CASE WHEN len(list_filter(cl, lambda x: NOT list_contains(sl, x))) = 0 AND cn = sn THEN len(list_intersect(ct, st)) / len(ct) ELSE 0 END) AS best
      FROM c JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn AND s.marker = c.marker WHERE len(ct) > 0 AND len(st) > 0 GROUP BY ALL),
n AS (SELECT conv_id, turn, count(*) AS total FROM cl GROUP BY ALL), k AS (SELECT conv_id, turn, count(*) FILTER (best >= 0.55) AS backed FROM p GROUP BY ALL)
SELECT mk.conv_id, mk.turn, coalesce(total, 0) AS total_claims, coalesce(backed, 0) AS supported_claims, round(CASE WHEN total > 0 THEN coalesce(backed, 0) / total ELSE 0 END, 6) AS support_fraction,
  coalesce(total > 0 AND len(list_filter(cited, lambda x: NOT list_contains(known, x))) = 0 AND coalesce(backed, 0) = total, false) AS grounded,
  array_to_string(list_filter(cited, lambda x: list_contains(known, x)), ' ') AS valid_markers, array_to_string(list_filter(cited, lambda x: NOT list_contains(known, x)), ' ') AS invalid_markers
FROM mk LEFT JOIN n USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn)"""
)
def grounding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn that echoes the two before it, each with its marker: the turn before is evidence [E1], the one before that, where there is one, [E2]."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(order).alias("before"), F.lag("text", 2).over(order).alias("earlier")).where("before IS NOT NULL")
    rows = rows.withColumn("answer_id", F.struct("conv_id", "turn"))
    asked = rows.select("answer_id", F.concat("before", F.lit(" [E1] "), F.coalesce("earlier", F.lit("")), F.lit(" [E2] "), "text", F.lit(" [e1]")).alias("text"))
    held = rows.select("answer_id", F.lit("[E1]").alias("marker"), F.col("before").alias("text")).unionByName(rows.where("earlier IS NOT NULL").select("answer_id", F.lit("[E2]").alias("marker"), F.col("earlier").alias("text")))
    marks = {c: F.array_join(c, " ") for c in ("valid_markers", "invalid_markers")}
    out = grounding(asked, held).withColumns(marks).withColumn("support_fraction", F.round("support_fraction", 6))
    return out.select("answer_id.conv_id", "answer_id.turn", *[c for c in out.columns if c != "answer_id"])


@query(f"SELECT doc_id, array_to_string({_LITERALS_SQL.format(x='text')}, ' ') AS literals FROM documents WHERE len({_LITERALS_SQL.format(x='text')}) > 0")
def literal_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal facts of every document that states any."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.literals(F.col("text")), " ").alias("literals")).where("literals <> ''")


@query(
    rf"""WITH s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1)::INT AS sentence_no FROM (SELECT doc_id, {_SPLIT_SQL.format(x="text")} AS l FROM documents)),
d AS (SELECT doc_id, sentence_no, s, coalesce(list_sum(list_transform(list_filter(list_transform(string_split_regex(s, '\s+'), lambda t: trim(t, '.,;:()[]{{}}–—')), lambda t: regexp_matches(t, '^[+-]?\d+([.,:/]\d+)*%?$')), lambda t: length(regexp_replace(t, '\D', '', 'g')))), 0) AS bare,
  length(s) - length(translate(s, ',-–', '')) AS marks FROM s),
n AS (SELECT doc_id, length(s) < 20 OR (length(s) > 30 AND (bare / length(s) > 0.12 OR marks > 5)) AS noise FROM d)
SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (noise) AS n_noise FROM n GROUP BY doc_id"""
)
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences of each document are too short, mostly bare numbers, or lists of marks."""
    # fixed values: the form of a bare number, and the limits 20, 30, 0.12 and 5
    s = F.col("s")
    cores = F.transform(F.split(s, r"\s+"), lambda t: F.regexp_replace(t, r"^[.,;:()\[\]{}–—]+|[.,;:()\[\]{}–—]+$", ""))
    bare = F.aggregate(F.filter(cores, lambda t: t.rlike(r"^[+-]?\d+([.,:/]\d+)*%?$")), F.lit(0), lambda n, t: n + F.length(F.regexp_replace(t, r"\D", "")))
    marks = T.count_of(s, ",-–")
    noise = (F.length(s) < 20) | ((F.length(s) > 30) & ((bare / F.length(s) > 0.12) | (marks > 5)))
    rows = documents(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).select("doc_id", noise.alias("noise"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if("noise").alias("n_noise"))


@query(f"SELECT doc_id, count(*) AS n_sentences, max(length(s))::BIGINT AS longest FROM (SELECT doc_id, unnest({_SPLIT_SQL.format(x='text')}) AS s FROM documents) GROUP BY doc_id")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("s")).cast("bigint").alias("longest"))


#: What is taken out of a passage, in this order, and what stands in its place. Leading quotation marks; leading braces, marks and
#: single letters or digits, again and again; labels of figures; hyphens of broken words; numeric references; control characters; runs of blanks.
_W = r"\p{L}\p{N}_"
_MARKS = rf"\{{[^}}]*\}}\s*|[^{_W}\s{{][^{_W}{{]*|\{{\s*"
PASSAGE_RULES = [
    (r"^\s*>\s*", ""),
    (rf"^(?:{_MARKS}|[a-zA-Z0-9]\s+|[a-zA-Z0-9](?:{_MARKS})|[a-zA-Z0-9]$)+", ""),
    (rf"(?i)(^|[^{_W}])(?:figure|figura|abbildung)\s+[0-9]+\.[0-9]+:?\s*", "{}1"),
    (rf"([{_W}]+)-\s+([{_W}]+)", "{}1{}2"),
    (r"\[\s*[0-9]+(?:\s*,\s*[0-9]+)*\s*\]", ""),
    (r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]", ""),
    (r"\s+", " "),
]


def clean_passage(text: Column) -> Column:
    """A passage without the marks and remains of layout that PASSAGE_RULES name."""
    for pattern, put in PASSAGE_RULES:
        text = F.regexp_replace(text, pattern, put.replace("{}", "$"))
    return F.trim(text)


def _clean_sql() -> str:
    out = "text"
    for pattern, put in PASSAGE_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{put.replace('{}', chr(92))}', 'g')"
    return f"trim({out})"


@query(f"SELECT doc_id, md5({_clean_sql()}) AS digest FROM documents")
def clean_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts, as digests."""
    return documents(spark, sf_dir).select("doc_id", F.md5(clean_passage(F.col("text"))).alias("digest"))


#: Intents in the order in which they are tried, our own cues in four languages.
INTENTS = {
    "greeting": r"^(hello|hi|bonjour|hallo|hola)",
    "question": r"\?",
    "search": r"(find|search|cherche|suche|busca)",
    "list": r"(list|liste|lista)",
    "explain": r"(explain|explique|erklär|explica)",
    "compare": r"(compare|versus|vergleich)",
    "train": r"(train|entraîn|entren)",
    "status": r"(status|état|estado)",
    "upload": r"(upload|import)",
    "code": r"(code|function|script)",
}


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in INTENTS.items()) + " ELSE 'chat' END AS intent FROM conversations")
def intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first intent whose cue a turn holds."""
    t, out = F.lower("text"), F.lit("chat")
    for name, pattern in reversed(INTENTS.items()):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", out.alias("intent"))


PLANS = {"procedural": r"(step|how to|first)", "math": r"[=<>^]|(formula|equation)", "comparative": r"(than|versus|between)"}
_SEPARATOR = r" (?:versus|vs|and|or|than) "


@query(
    "WITH p AS (SELECT item_id, text, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}')" + (f" AND regexp_matches(lower(text), '{_SEPARATOR}')" if n == "comparative" else "") + f" THEN '{n}'" for n, p in PLANS.items()) + " ELSE 'definition' END AS plan FROM benchmark)"
    f" SELECT item_id, plan, CASE WHEN plan = 'comparative' THEN len(string_split_regex(lower(text), '{_SEPARATOR}')) ELSE 1 END::INT AS n_subtopics FROM p"
)
def query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of answer each question asks for, and into how many topics a comparison falls."""
    t = F.lower("text")
    plan = F.when(t.rlike(PLANS["procedural"]), "procedural").when(t.rlike(PLANS["math"]), "math").when(t.rlike(PLANS["comparative"]) & t.rlike(_SEPARATOR), "comparative").otherwise("definition")
    return table(spark, sf_dir, "benchmark").select("item_id", plan.alias("plan"), F.when(plan == "comparative", F.size(F.split(t, _SEPARATOR))).otherwise(1).alias("n_subtopics"))
