"""Scalar text functions as column expressions, each with its DuckDB form where queries need one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, the patterns of this block. A lexical token: a run of letters and digits of any script, in lower case.
TOKEN = r"[\p{L}\p{N}]+"
LONG_TOKEN = r"[\p{L}\p{N}]{3,}"
#: A token of the lexical profile: Latin letters, digits and underscores.
PROFILE_TOKEN = r"[a-zA-ZÀ-ÖØ-öø-ÿ0-9_]+"
#: Sentence ends: a mark and blanks, or line ends.
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
#: Sentence ends of the syntactic profile: only two or more line ends part sentences.
SYNTAX_END = r"(?<=[.!?])\s+|\n\n+"
MATH = r"[=+*/<>^%|]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def each(rows: DataFrame, keys: list[str], values: Column, name: str) -> DataFrame:
    """(keys..., name): a row for every value of an array that holds no null. An inner explode would make the array twice, the first time for a filter on its size."""
    return rows.select(*keys, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def content_tokens(text: Column) -> Column:
    """Tokens of more than two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(LONG_TOKEN), F.lit(0))


def query_terms(text: Column) -> Column:
    """The content tokens of a query, or all its tokens where it has none."""
    content = content_tokens(text)
    return F.when(F.size(content) > 0, content).otherwise(tokens(text))


def profile_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PROFILE_TOKEN), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _sentences(text: Column, end: str) -> Column:
    return F.filter(F.transform(F.split(text, end), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def sentences(text: Column) -> Column:
    return _sentences(text, SENTENCE_END)


def syntax_sentences(text: Column) -> Column:
    return _sentences(text, SYNTAX_END)


def count_of(text: Column, marks: str) -> Column:
    """How many characters of text are among marks."""
    return sum(((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(m), F.lit("")))) / len(m.encode()) for m in marks), F.lit(0)).cast("int")


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("bigint")


def bounded(x: Column) -> Column:
    """x / (1 + x) of what is not negative; a null or negative value is 0."""
    y = F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
    return y / (1 + y)


def rounded(x: Column, digits: int) -> Column:
    """x in units of its last digit, rounded half away from zero there, as DuckDB does it; F.round takes the shortest decimal form of x, which differs at ties such as 41 / 640."""
    unit = float(10**digits)
    return F.round(x * unit) / unit


def chunk_id(canonical: Column) -> Column:
    return F.concat(F.lit("chk_"), F.substring(F.sha2(canonical, 256), 1, 32))


def document_id(text: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(text, 256), 1, 24))


def hashed_bucket(token: Column, width: int) -> Column:
    """The bucket of a token: the first four bytes of its SHA-256 as a little-endian number, modulo width."""
    h = F.sha2(token, 256)
    if 256 % width == 0:  # the first byte tells it
        digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring(h, k, 1)) - 1
        return ((digit(1) * 16 + digit(2)) % width).cast("int")
    swapped = F.concat(*[F.substring(h, 1 + 2 * k, 2) for k in (3, 2, 1, 0)])
    return (F.conv(swapped, 16, 10).cast("bigint") % width).cast("int")


def truncated_quote(text: Column, limit: int = 900) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def summary(text: Column, words: int = 60) -> Column:
    parts = F.split(squeeze(text), " ")
    return F.when(F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("…"))).otherwise(F.array_join(parts, " "))


def markers(text: Column) -> Column:
    """Citation markers such as [e3], in their canonical form [E3], each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)), F.upper))


#: The form of a citation marker, and of the literal facts that a claim may not change.
MARKER = r"\[[eE][0-9]+\]"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
DATE = r"[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}"
UNIT = r"(?:[%°ºµ]|\p{L}{1,12})"


def literals(text: Column) -> Column:
    """The facts that a claim must share with its evidence, as prefixed strings: dates, percentages, measures, numbers; whole words alone."""
    plain = F.lower(F.regexp_replace(text, r"\s+", " "))

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(plain, F.lit(_BEFORE + pattern + _AFTER), F.lit(0))

    parts = [
        F.transform(found(DATE), lambda m: F.concat(F.lit("date:"), m)),
        F.transform(found(NUMBER + r"\s*%"), lambda m: F.concat(F.lit("percent:"), F.replace(m, F.lit(" "), F.lit("")))),
        F.transform(found(NUMBER + r"\s*" + UNIT), lambda m: F.concat(F.lit("measure:"), F.regexp_replace(m, "^(" + NUMBER + r")\s*", "$1:"))),
        F.transform(found(NUMBER), lambda m: F.concat(F.lit("number:"), m)),
    ]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))
