"""Lexical, syntactic, discourse and rhetorical profiles of documents, and the vectors made of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.tables import documents

#: Cue phrases by category, our own, in the four languages of the corpus. The order of categories settles ties.
CONNECTIVES = {
    "additive": ["also", "furthermore", "moreover", "aussi", "auch", "también"],
    "adversative": ["but", "however", "although", "mais", "aber", "pero"],
    "consecutive": ["therefore", "thus", "hence", "donc", "daher", "entonces"],
    "sequential": ["first", "then", "finally", "ensuite", "dann", "luego"],
    "exemplificative": ["for example", "such as", "par exemple", "zum beispiel", "por ejemplo"],
}
ROLES = {
    "definition": ["is a", "is the", "est un", "ist ein", "es un"],
    "explanation": ["because", "since", "parce que", "weil", "porque"],
    "comparison": ["than", "unlike", "plus que", "als", "más que"],
    "procedure": ["step", "first", "then", "étape", "schritt", "paso"],
    "mathematical_formulation": ["equation", "formula", "équation", "gleichung", "ecuación"],
    "example": ["for example", "such as", "par exemple", "zum beispiel", "por ejemplo"],
    "conclusion": ["finally", "therefore", "enfin", "schließlich", "finalmente"],
    "evidence": ["shown", "according to", "selon", "laut", "según"],
}
#: Acronyms, technical terms, list items, symbols.
ACRONYM = r"\b[A-Z0-9]{2,8}\b"
TECHNICAL = r"\b(?:[A-Z][a-z]+(?:[A-Z][a-z]+)+|[a-z]+(?:-[a-z]+)+|\d+[a-zA-Z]+|[a-zA-Z]+\d+)\b"
LIST_ITEM = r"(?:^|\n)\s*(?:[•*-]|\d+[.)])\s+"
SYMBOLS = r"[=+*/^_{}\\<>≤≥±∑∏∫√αβγθλμπσωτ-]"


def _words_sql(pattern: str) -> str:
    """Counts a pattern between word ends in an engine whose word ends are ASCII: marks are doubled, so that each end has its own."""
    other = r"[^\p{L}\p{N}_]"
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b").replace("(?:-[a-z]+)", "(?:--[a-z]+)")
    return rf"len(regexp_extract_all(regexp_replace(text, '({other})', '\1\1', 'g'), '(?:^|{other})(?:{inner})(?:$|{other})'))::BIGINT"


def spaced(text: Column, phrases: Iterable[str]) -> Column:
    """The tokens of a text that stand in phrases, two spaces between neighbours and around them, so that phrases are found whole; four where others stood between.

    What is left is short, so looking for every phrase reads little.
    """
    words = sorted({w for p in phrases for w in p.split()})
    apart = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    left = F.array_join(F.transform(apart, lambda t: F.when(t.isin(words), t).otherwise("")), "  ")
    return F.concat(F.lit("  "), F.regexp_replace(left, " {5,}", "    "), F.lit("  "))


#: ASCII marks that the profiles count. What is neither one of them nor beyond ASCII is taken out first, so that counting reads what is left alone.
ASCII_MARKS = r":;,\-()?=+*/^_{}\\<>"


def marks(text: Column) -> Column:
    """The counted marks of a text, and its characters beyond ASCII."""
    return F.regexp_replace(text, rf"[[^{ASCII_MARKS}]&&[\x00-\x7F]]+", "")


def symbol_count(marks: Column) -> Column:
    """How many of SYMBOLS stand among marks()."""
    return T.count_of(marks, r"=+*/^_{}\<>≤≥±∑∏∫√αβγθλμπσωτ-")


def sentence_lengths(text: Column) -> Column:
    """The words of every sentence that has any. A word becomes one letter and an end of a sentence one bar before the text is cut."""
    ended = F.regexp_replace(text, r"([.!?])\s+", "$1\n\n")
    bars = F.regexp_replace(F.regexp_replace(F.regexp_replace(ended, r"\S+", "w"), r"\n\n+", "|"), r"\s+", "")
    return F.filter(F.transform(F.split(bars, r"\|"), lambda s: F.length(s).cast("bigint")), lambda n: n > 0)


def _phrase(p: str) -> str:
    return " " + "  ".join(p.split()) + " "


def phrase_count(spaced_text: Column, phrases: list[str]) -> Column:
    """How often the phrases stand in a text made by spaced()."""
    return sum((((F.octet_length(spaced_text) - F.octet_length(F.replace(spaced_text, F.lit(_phrase(p)), F.lit("")))) / len(_phrase(p).encode())).cast("bigint") for p in phrases), F.lit(0).cast("bigint"))


def _phrase_sql(phrases: list[str]) -> str:
    return "(" + " + ".join(f"(length(sp) - length(replace(sp, '{_phrase(p)}', ''))) // {len(_phrase(p))}" for p in phrases) + ")"


SPACED_SQL = r"'  ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), '  ') || '  ' AS sp"


def lexical(docs: DataFrame) -> DataFrame:
    """Richness of each document's vocabulary: two levels of sums, the first on (document, term)."""
    term = T.each(docs, ["doc_id"], T.profile_tokens(F.col("text")), "t")
    counts = term.groupBy("doc_id", F.lower("t").alias("term")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("t")).alias("chars"))
    n, types = F.sum("c"), F.count(F.lit(1))
    sums = counts.groupBy("doc_id").agg(n.alias("n_tokens"), types.alias("n_types"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.sum((F.col("c") == 1).cast("bigint")).alias("hapax"), F.sum("chars").alias("chars"))
    own = docs.select("doc_id", F.regexp_count("text", F.lit(ACRONYM)).cast("bigint").alias("n_acronyms"), F.regexp_count("text", F.lit(TECHNICAL)).cast("bigint").alias("n_technical"))
    return richness(own.join(sums, "doc_id", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0))).withColumn("n_types", F.coalesce("n_types", F.lit(0))), ["doc_id"])


def richness(out: DataFrame, keys: list[str]) -> DataFrame:
    """The lexical profile of what has been counted."""
    some = F.col("n_tokens") > 0
    ratio = lambda x: T.rounded(F.when(some, x).otherwise(F.lit(0.0)), 6)
    yule = 10000.0 * (F.col("squares") - F.col("n_tokens")) / (F.col("n_tokens") * F.col("n_tokens"))
    return out.select(
        *keys, "n_tokens", "n_types", "n_acronyms", "n_technical",
        ratio(F.col("n_types") / F.col("n_tokens")).alias("ttr"),
        ratio(F.col("n_types") / F.sqrt("n_tokens")).alias("root_ttr"),
        ratio(F.when(F.col("n_tokens") > 1, F.greatest(yule, F.lit(0.0))).otherwise(F.lit(0.0))).alias("yule_k"),
        ratio(F.col("hapax") / F.col("n_types")).alias("hapax_ratio"),
        ratio(F.col("chars") / F.col("n_tokens")).alias("mean_word_length"),
    )


LEXICAL_SQL = rf"""
lt AS (SELECT doc_id, unnest(regexp_extract_all(text, '{T.PROFILE_TOKEN}')) AS t FROM documents),
lc AS (SELECT doc_id, lower(t) AS term, count(*) AS c, sum(length(t)) AS chars FROM lt GROUP BY ALL),
ls AS (SELECT doc_id, sum(c)::BIGINT AS n, count(*) AS v, sum(c * c) AS sq, count(*) FILTER (c = 1) AS hapax, sum(chars) AS chars FROM lc GROUP BY doc_id),
lexical AS MATERIALIZED (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, coalesce(v, 0)::BIGINT AS n_types,
  {_words_sql(ACRONYM)} AS n_acronyms, {_words_sql(TECHNICAL)} AS n_technical,
  round(coalesce(v / n, 0), 6) AS ttr, round(coalesce(v / sqrt(n), 0), 6) AS root_ttr,
  round(coalesce(CASE WHEN n > 1 THEN greatest(10000.0 * (sq - n)::DOUBLE / (n * n)::DOUBLE, 0) END, 0), 6) AS yule_k,
  round(coalesce(hapax / v, 0), 6) AS hapax_ratio, round(coalesce(chars / n, 0), 6) AS mean_word_length
  FROM documents LEFT JOIN ls USING (doc_id))"""


@query(f"WITH {LEXICAL_SQL} SELECT * FROM lexical")
def lexical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(documents(spark, sf_dir))


def syntactic(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Sentence lengths and densities of marks, row by row; keys are kept."""
    items = F.regexp_count(F.concat(F.lit("\n"), "text"), F.lit(LIST_ITEM.replace(r"(?:^|\n)", r"\n")))  # the line end put before is its ^
    rows = docs.select(*keys, sentence_lengths(F.col("text")).alias("l"), marks(F.col("text")).alias("marks"), items.alias("items"))
    total = F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + x)
    n = F.size("l").cast("bigint")
    rows = rows.withColumn("n", n).withColumn("words", total)
    mean = F.when(F.col("n") > 0, F.col("words") / F.col("n")).otherwise(F.lit(0.0))
    rows = rows.withColumn("mean", mean)
    spread = F.aggregate("l", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    some = F.greatest("words", F.lit(1))
    density = lambda c: T.rounded(F.when(F.col("n") > 0, c / some).otherwise(F.lit(0.0)), 6)
    text = F.col("marks")
    return rows.select(
        *keys, F.col("n").alias("n_sentences"), T.rounded(F.col("mean"), 6).alias("mean_sentence"),
        T.rounded(F.when(F.col("n") > 0, F.sqrt(spread / F.col("n"))).otherwise(F.lit(0.0)), 6).alias("std_sentence"),
        F.coalesce(F.array_min("l"), F.lit(0)).alias("min_sentence"), F.coalesce(F.array_max("l"), F.lit(0)).alias("max_sentence"),
        density(T.count_of(text, ":")).alias("colons"), density(T.count_of(text, ";")).alias("semicolons"), density(T.count_of(text, ",")).alias("commas"),
        density(T.count_of(text, "-–—")).alias("dashes"), density(T.count_of(text, "()")).alias("parens"), density(T.count_of(text, "?")).alias("questions"),
        density(symbol_count(text)).alias("symbols"),
        T.rounded(F.when(F.col("n") > 0, F.col("items") / F.col("n")).otherwise(F.lit(0.0)), 6).alias("list_items"),
    )


def _marks_sql(marks: str) -> str:
    return f"length(text) - length(translate(text, '{marks}', ''))"


SYNTAX_SQL = rf"""
sl AS (SELECT doc_id, text, list_transform(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), '\x1E|\n\n+'),
  lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(12) || chr(13))), lambda s: s <> ''), lambda s: len(string_split_regex(s, '\s+'))::BIGINT) AS l FROM documents),
sn AS (SELECT *, len(l)::BIGINT AS n, coalesce(list_sum(l), 0)::BIGINT AS w FROM sl),
syntax AS MATERIALIZED (SELECT doc_id, n AS n_sentences, round(CASE WHEN n > 0 THEN w / n ELSE 0 END, 6) AS mean_sentence,
  round(CASE WHEN n > 0 THEN list_stddev_pop(l) ELSE 0 END, 6) AS std_sentence, coalesce(list_min(l), 0) AS min_sentence, coalesce(list_max(l), 0) AS max_sentence,
  """ + ",\n  ".join(f"round(CASE WHEN n > 0 THEN ({_marks_sql(m)}) / greatest(w, 1) ELSE 0 END, 6) AS {name}" for name, m in {"colons": ":", "semicolons": ";", "commas": ",", "dashes": "-–—", "parens": "()", "questions": "?"}.items()) + rf""",
  round(CASE WHEN n > 0 THEN len(regexp_extract_all(text, '{SYMBOLS}')) / greatest(w, 1) ELSE 0 END, 6) AS symbols,
  round(CASE WHEN n > 0 THEN len(regexp_extract_all(text, '{LIST_ITEM}')) / n ELSE 0 END, 6) AS list_items FROM sn)"""


@query(f"WITH {SYNTAX_SQL} SELECT * FROM syntax")
def syntactic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntactic(documents(spark, sf_dir))


def _first_best(names: list[str], otherwise: str) -> Column:
    """The first of the columns names that is largest; otherwise where all are 0."""
    best = F.greatest(*map(F.col, names))
    out = F.lit(otherwise)
    for c in reversed(names):
        out = F.when((F.col(c) == best) & (best > 0), F.lit(c)).otherwise(out)
    return out


def _first_best_sql(names: list[str], otherwise: str) -> str:
    best = f"greatest({', '.join(names)})"
    return "CASE " + " ".join(f"WHEN {c} = {best} AND {best} > 0 THEN '{c}'" for c in names) + f" ELSE '{otherwise}' END"


def discourse(docs: DataFrame) -> DataFrame:
    """Connectives of each category, their density, and the category with most of them."""
    sp = docs.select("doc_id", F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).cast("bigint").alias("words"), spaced(F.col("text"), sum(CONNECTIVES.values(), [])).alias("sp"))
    return connected(sp.select("doc_id", "words", *[phrase_count(F.col("sp"), p).alias(c) for c, p in CONNECTIVES.items()]), ["doc_id"])


def connected(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The discourse profile of what has been counted."""
    total = sum((F.col(c) for c in CONNECTIVES), F.lit(0).cast("bigint"))
    return rows.select(*keys, *CONNECTIVES, total.alias("n_connectives"), T.rounded(total / F.greatest("words", F.lit(1)), 6).alias("density"), _first_best(list(CONNECTIVES), "neutral_informative").alias("primary_function"))


DISCOURSE_SQL = rf"""
dsp AS (SELECT doc_id, len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '))::BIGINT AS words, {SPACED_SQL} FROM documents),
dc AS (SELECT doc_id, words, {", ".join(f"({_phrase_sql(p)})::BIGINT AS {c}" for c, p in CONNECTIVES.items())} FROM dsp),
discourse AS MATERIALIZED (SELECT doc_id, {", ".join(CONNECTIVES)}, {" + ".join(CONNECTIVES)} AS n_connectives, round(({" + ".join(CONNECTIVES)}) / greatest(words, 1), 6) AS density,
  {_first_best_sql(list(CONNECTIVES), "neutral_informative")} AS primary_function FROM dc)"""


@query(f"WITH {DISCOURSE_SQL} SELECT * FROM discourse")
def discourse_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse(documents(spark, sf_dir))


def rhetorical(docs: DataFrame) -> DataFrame:
    """The share of each role's cues, the best role and its share; without a cue an explanation at one half."""
    rows = docs.select("doc_id", symbol_count(marks(F.col("text"))).alias("m"), spaced(F.col("text"), sum(ROLES.values(), [])).alias("sp")).select("doc_id", "m", *[phrase_count(F.col("sp"), p).cast("double").alias(r) for r, p in ROLES.items()])
    return shares(rows, ["doc_id"])


def shares(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rhetorical profile of what has been counted."""
    boost = F.when(F.col("m") > 3, 1.5 + F.col("m") * 0.1).otherwise(F.lit(0.0))
    rows = rows.withColumn("mathematical_formulation", F.col("mathematical_formulation") + boost)
    total = sum((F.col(r) for r in ROLES), F.lit(0.0))
    rows = rows.withColumn("total", total)
    best = F.greatest(*ROLES)
    return rows.select(
        *keys, _first_best(list(ROLES), "explanation").alias("role"),
        T.rounded(F.when(F.col("total") > 0, best / F.col("total")).otherwise(F.lit(0.5)), 6).alias("confidence"),
        *[T.rounded(F.when(F.col("total") > 0, F.col(r) / F.col("total")).otherwise(F.lit(0.125)), 6).alias(r) for r in ROLES],
    )


RHETORIC_SQL = rf"""
rsp AS (SELECT doc_id, len(regexp_extract_all(text, '{SYMBOLS}')) AS m, {SPACED_SQL} FROM documents),
rc AS (SELECT doc_id, {", ".join(f"{_phrase_sql(p)}::DOUBLE" + (" + CASE WHEN m > 3 THEN 1.5 + m * 0.1 ELSE 0 END" if r == "mathematical_formulation" else "") + f" AS {r}" for r, p in ROLES.items())} FROM rsp),
rt AS (SELECT *, {" + ".join(ROLES)} AS total FROM rc),
rhetoric AS MATERIALIZED (SELECT doc_id, {_first_best_sql(list(ROLES), "explanation")} AS role, round(CASE WHEN total > 0 THEN greatest({", ".join(ROLES)}) / total ELSE 0.5 END, 6) AS confidence,
  {", ".join(f"round(CASE WHEN total > 0 THEN {r} / total ELSE 0.125 END, 6) AS {r}" for r in ROLES)} FROM rt)"""


@query(f"WITH {RHETORIC_SQL} SELECT * FROM rhetoric")
def rhetorical_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rhetorical(documents(spark, sf_dir))


#: The features of the style vector in their order, in SQL that both engines read; the last four are composites of v.
STYLE = [
    "ttr", "hapax_ratio", "yule_k / 250", "mean_word_length / 12", "n_technical / greatest(n_tokens, 1)", "n_acronyms / greatest(n_tokens, 1)", "n_tokens / 300", "root_ttr / 10",
    "mean_sentence / 40", "std_sentence / 20", "n_sentences / 10", "colons * 20", "semicolons * 30", "commas * 10", "dashes * 15", "parens * 15", "questions * 10", "symbols * 5", "list_items", "(max_sentence - min_sentence) / 50",
    "density * 20", "additive / 4", "adversative / 4", "consecutive / 4", "sequential / 4", "exemplificative / 4", "n_connectives / 8", "CASE WHEN n_connectives > 0 THEN 1 ELSE 0 END",
]
COMPOSITES = [(0, 8), (17, 4), (11, 18), (20, 13)]


def _in_units(vector: str) -> Column:
    """A vector as text, in units of a hundred-thousandth."""
    return F.array_join(F.transform(vector, lambda x: F.round(x * 100_000).cast("bigint").cast("string")), " ")


def style_vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, style): 32 clamped features, L2-normalised."""
    return styled(lexical(docs).join(syntactic(docs), "doc_id").join(discourse(docs), "doc_id"), ["doc_id"])


def styled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The style vectors of lexical, syntactic and discourse profiles."""
    v = rows.select(*keys, F.array(*[F.expr(f"least(1D, cast({e} AS double))") for e in STYLE]).alias("v"))
    v = v.select(*keys, F.concat("v", F.array(*[(F.get("v", F.lit(a)) + F.get("v", F.lit(b))) / 2 for a, b in COMPOSITES])).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("norm", norm).select(*keys, F.when(F.col("norm") > 1e-8, F.transform("v", lambda x: T.rounded(x / F.col("norm"), 5))).otherwise(F.col("v")).alias("style"))


STYLE_SQL = (
    f"{LEXICAL_SQL}, {SYNTAX_SQL}, {DISCOURSE_SQL}, v0 AS (SELECT doc_id, [" + ", ".join(f"least(1::DOUBLE, ({e})::DOUBLE)" for e in STYLE) + "] AS v FROM lexical JOIN syntax USING (doc_id) JOIN discourse USING (doc_id)),"
    + " v1 AS (SELECT doc_id, v || [" + ", ".join(f"(v[{a + 1}] + v[{b + 1}]) / 2" for a, b in COMPOSITES) + "] AS v FROM v0),"
    + " v2 AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v1),"
    + " style AS MATERIALIZED (SELECT doc_id, CASE WHEN norm > 1e-8 THEN list_transform(v, lambda x: round(x / norm, 5)) ELSE v END AS style FROM v2)"
)


@query(f"WITH {STYLE_SQL} SELECT doc_id, array_to_string(list_transform(style, lambda x: round(x * 100000)::BIGINT::VARCHAR), ' ') AS style FROM style")
def style_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_vectors(documents(spark, sf_dir)).select("doc_id", _in_units("style").alias("style"))


def rhetorical_vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, rhetoric): eight role shares, the confidence, four indicators and three zeros, L2-normalised."""
    return directed(rhetorical(docs), ["doc_id"])


def directed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rhetoric vectors of rhetorical profiles."""
    flags = [F.when(F.col("role") == r, F.lit(1.0)).otherwise(F.lit(0.0)) for r in ("definition", "comparison", "procedure", "mathematical_formulation")]
    v = rows.select(*keys, F.array(*map(F.col, ROLES), F.col("confidence"), *flags, F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("norm", norm).select(*keys, F.transform("v", lambda x: T.rounded(x / F.col("norm"), 5)).alias("rhetoric"))


RHETORIC_VECTOR_SQL = (
    f"{RHETORIC_SQL}, rv AS (SELECT doc_id, [{', '.join(ROLES)}, confidence, " + ", ".join(f"CASE WHEN role = '{r}' THEN 1.0::DOUBLE ELSE 0 END" for r in ("definition", "comparison", "procedure", "mathematical_formulation")) + ", 0, 0, 0] AS v FROM rhetoric),"
    " rhetoric_v AS MATERIALIZED (SELECT doc_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 5)) AS rhetoric FROM rv)"
)


@query(f"WITH {RHETORIC_VECTOR_SQL} SELECT doc_id, array_to_string(list_transform(rhetoric, lambda x: round(100000 * x)::BIGINT::VARCHAR), ' ') AS rhetoric FROM rhetoric_v")
def rhetorical_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rhetorical_vectors(documents(spark, sf_dir)).select("doc_id", _in_units("rhetoric").alias("rhetoric"))


@query(
    f"WITH {LEXICAL_SQL}, {SYNTAX_SQL}, {DISCOURSE_SQL}, {RHETORIC_SQL} SELECT role, count(*) AS n, round(avg(ttr), 4) AS avg_ttr, round(avg(mean_sentence), 2) AS avg_sentence, round(avg(symbols), 4) AS avg_symbols, round(avg(density), 4) AS avg_connectives"
    " FROM lexical JOIN syntax USING (doc_id) JOIN discourse USING (doc_id) JOIN rhetoric USING (doc_id) GROUP BY role"
)
def linguistics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the profiles for each rhetorical role."""
    docs = documents(spark, sf_dir)
    rows = lexical(docs).select("doc_id", "ttr").join(syntactic(docs).select("doc_id", "mean_sentence", "symbols"), "doc_id").join(discourse(docs).select("doc_id", "density"), "doc_id").join(rhetorical(docs).select("doc_id", "role"), "doc_id")
    mean = lambda c, d: T.rounded(F.avg(c), d)
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), mean("ttr", 4).alias("avg_ttr"), mean("mean_sentence", 2).alias("avg_sentence"), mean("symbols", 4).alias("avg_symbols"), mean("density", 4).alias("avg_connectives"))


#: Marker words of each language, our own; ties go to the first.
HINTS = {"en": ["the", "and", "of", "that"], "fr": ["les", "des", "une", "est"], "de": ["der", "und", "die", "nicht"], "es": ["los", "las", "por", "que"]}


@query(
    "WITH s AS (SELECT doc_id, ' ' || regexp_replace(lower(substr(text, 1, 500)), '\\s+', ' ', 'g') || ' ' AS t FROM documents), c AS (SELECT doc_id, "
    + ", ".join("(" + " + ".join(f"contains(t, ' {w} ')::INT" for w in ws) + f") AS {lang}" for lang, ws in HINTS.items())
    + f" FROM s) SELECT doc_id, {_first_best_sql(list(HINTS), 'unknown')} AS hint, greatest({', '.join(HINTS)})::INT AS markers FROM c"
)
def language_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language most of whose marker words stand in the first 500 characters, which is the sample that the hint is defined on."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.substring("text", 1, 500)), r"\s+", " "), F.lit(" "))
    found = documents(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", *[sum((F.contains("t", F.lit(f" {w} ")).cast("int") for w in ws), F.lit(0)).alias(lang) for lang, ws in HINTS.items()])
    return found.select("doc_id", _first_best(list(HINTS), "unknown").alias("hint"), F.greatest(*HINTS).alias("markers"))
