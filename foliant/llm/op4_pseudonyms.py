"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

E-mail addresses, phone numbers, social security numbers, payment card numbers, IBANs, IP addresses, dates and secrets are
found and validated: cards by their check digit, IBANs by their remainder, social security numbers by their areas, groups and
serials, addresses by their octets, dates by the calendar; phone numbers by their lengths alone. What does not hold stays as it
is. Each value is permuted within its own format under a key, so a valid number stays valid, a date stays a date of its century, and equal values
stay equal in every document and spelling (blanks, hyphens, the case of addresses, the order of a date). Each round adds a keyed hash
of one half to the other half, modulo the half's own range, so every step can be undone with the key.
DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read

#: The session's setting that names the key, and the published key of the registered query and the tests, which guards nothing.
KEY_SETTING, DEMONSTRATION_KEY = "spark.foliant.pseudonym.key", "foliant"
ROUNDS = 8
#: How the numbers of known card issuers begin.
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[4-689]|6)"

_L, _R = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
#: The forms that are looked for, the first that matches at a place wins. Repeats are bounded or keep what they take, so the search is linear in long texts.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "token": _L + r"(?:A[KS]IA[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,}+)" + _R,
    "secret": _L + r"[0-9A-Fa-f]{32,}+" + _R,
    "iban": _L + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _R,
    "date": _L + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{4}[.][0-9]{2}[.][0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})" + _R,
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:.])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + _R,
    "ssn": _L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R,
    "phone": r"(?:(?<![0-9A-Za-z])\+?[0-9]{1,3}[ .-]?)?(?<![0-9A-Za-z])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}" + _R
    + r"|(?:(?<![0-9A-Za-z])\+?[0-9]{1,3}[ .-])?(?<![0-9A-Za-z])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}" + _R
    + r"|(?<![0-9A-Za-z])\+[0-9](?:[ .-]?[0-9]){7,13}" + _R,
    # groups of four, however many follow each other: the ones that hold are sought inside the run
    "card": _L + r"(?:[0-9]{4}(?:[ -][0-9]{4}" + _R + r"){3,}+|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5}|[0-9]{13,19})" + _R,
}
PATTERN = "|".join(FORMS.values())
#: What any text with a match of PATTERN fulfils, found by a faster search.
POSSIBLE = "(text rlike '[0-9@:_]|[A-Fa-f]{32}' OR " + " OR ".join(f"contains(text, '{x}')" for x in ("xox", "sk-", "AKIA", "ASIA", "AIza")) + ")"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(key: str, tag: str, turn: str, half: str, digits: int = 15) -> str:
    """A keyed 60-bit number from a round and a half."""
    return f"cast(conv(substr(sha2(concat({_quoted(key)}, '|{tag}|', {turn}, '|', {half}), 256), 1, {digits}), 16, 10) AS bigint)"


def _digits(key: str, tag: str, s: str) -> str:
    """A permutation of the digit strings of one length (2 to 36)."""
    ten = "cast(pow(10, length(st.a)) AS bigint)"
    moved = f"lpad(cast((cast(st.a AS bigint) + {_hash(key, tag, 'i', 'st.b')} % {ten}) % {ten} AS string), length(st.a), '0')"
    half = f"(length({s}) div 2)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', left({s}, {half}), 'b', substr({s}, {half} + 1)), (st, i) -> named_struct('a', st.b, 'b', {moved}), st -> concat(st.a, st.b))"


def _shift(c: str, k: str, lower: str, upper: str) -> str:
    out = c
    for letters in (upper, lower, "0123456789"):
        out = f"if(instr('{letters}', {c}) > 0, substr('{letters}', (instr('{letters}', {c}) - 1 + {k}) % {len(letters)} + 1, 1), {out})"
    return out


def _letters(key: str, tag: str, s: str, lower: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """A permutation of the strings with the same classes of characters: digits, small and capital letters each among themselves."""
    upper = lower.upper()
    stream = f"sha2(concat({_quoted(key)}, '|{tag}|', i, '|', length(st.a), '|', st.b), 256)"
    k = "cast(conv(substr(h, 1 + 2 * (j % 32), 2), 16, 10) AS int)"
    # the characters as an array, and the keyed hash once a round, so that long values take time in proportion
    moved = _bound("h", stream, f"array_join(transform(filter(split(st.a, ''), c -> c <> ''), (c, j) -> {_shift('c', k, lower, upper)}), '')")
    half = f"((length({s}) + 1) div 2)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', left({s}, {half}), 'b', substr({s}, {half} + 1)), (st, i) -> named_struct('a', st.b, 'b', {moved}), st -> concat(st.a, st.b))"


def _numbers(key: str, tag: str, a: str, b: str, p: str, q: str, result: str) -> str:
    """A permutation of the pairs (a, b) with a below p and b below q; result reads st.a and st.b."""
    first = f"if(i % 2 = 1, (st.a + {_hash(key, tag, 'i', 'st.b')} % {p}) % {p}, st.a)"
    second = f"if(i % 2 = 0, (st.b + {_hash(key, tag, 'i', 'st.a')} % {q}) % {q}, st.b)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} AS bigint), 'b', cast({b} AS bigint)), (st, i) -> named_struct('a', {first}, 'b', {second}), st -> {result})"


def _refill(m: str, digits: str) -> str:
    """The text m with its digits replaced in order by those of digits."""
    one = f"substr({m}, j, 1)"
    step = f"if(instr('0123456789', {one}) > 0, named_struct('o', concat(r.o, substr(r.d, 1, 1)), 'd', substr(r.d, 2)), named_struct('o', concat(r.o, {one}), 'd', r.d))"
    return f"aggregate(sequence(1, length({m})), named_struct('o', '', 'd', {digits}), (r, j) -> {step}, r -> r.o)"


def _luhn(body: str) -> str:
    """The check digit of a digit string."""
    d = f"cast(substr({body}, length({body}) - j, 1) AS int)"
    add = f"if(j % 2 = 0, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d})"
    return f"((10 - aggregate(sequence(0, length({body}) - 1), 0, (t, j) -> t + {add}) % 10) % 10)"


def _mod97(text: str) -> str:
    """The remainder by 97 of a text whose letters count as 10 to 35."""
    c = f"substr({text}, j, 1)"
    n = f"(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', {c}) - 1)"
    return f"aggregate(sequence(1, length({text})), 0, (t, j) -> (t * if({n} > 9, 100, 10) + {n}) % 97)"


def _bound(name: str, value: str, body: str) -> str:
    """body with name standing for value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _date(key: str) -> str:
    """A date of a century stays in it: centuries have 36525 = 75 * 487 or 36524 = 92 * 397 days. 5/3/2024 is read month first, 31/12/2024 day first."""
    year_first = "m rlike '^[0-9]{4}'"
    read = f"CASE WHEN {year_first} THEN try_to_timestamp(m, concat('yyyy', substr(m, 5, 1), 'MM', substr(m, 5, 1), 'dd')) WHEN m LIKE '%/%' THEN coalesce(try_to_timestamp(m, 'M/d/yyyy'), try_to_timestamp(m, 'd/M/yyyy')) ELSE try_to_timestamp(m, 'd.M.yyyy') END"
    month_first = "(m LIKE '%/%' AND try_to_timestamp(m, 'M/d/yyyy') IS NOT NULL)"
    one, two = (f"repeat(if({month_first}, '{x}', '{y}'), if(m rlike '{wide}', 2, 1))" for x, y, wide in (("M", "d", "^[0-9]{2}[./]"), ("d", "M", "[./][0-9]{2}[./]")))
    exact = f"if({year_first}, concat('yyyy', substr(m, 5, 1), 'MM', substr(m, 5, 1), 'dd'), concat({one}, if(m LIKE '%/%', '/', '.'), {two}, if(m LIKE '%/%', '/', '.'), 'yyyy'))"
    start = "make_date((year(day) div 100) * 100, 1, 1)"
    leap = "((year(day) div 100) % 4 = 0)"
    q = f"if({leap}, 487, 397)"
    n = f"datediff(day, {start})"
    moved = _numbers(key, "date", f"{n} div {q}", f"{n} % {q}", f"if({leap}, 75, 92)", q, f"st.a * {q} + st.b")
    body = f"if(day IS NULL OR year(day) < 100, m, date_format(date_add({start}, cast({moved} AS int)), {exact}))"
    return _bound("day", f"cast({read} AS date)", body)


def _card(key: str, d: str) -> str:
    """The digits of a valid card number: the body is permuted, its check digit made anew."""
    return _bound("body", _digits(key, "card", f"left({d}, length({d}) - 1)"), f"concat(body, cast({_luhn('body')} AS string))")


def _valid_card(d: str) -> str:
    return f"(cast(right({d}, 1) AS int) = {_luhn(f'left({d}, length({d}) - 1)')})"


def _cards(key: str) -> str:
    """A run of groups of four: a card is four of them that hold, the leftmost of those with the beginning of a known issuer before others; all other groups stay.

    By chance one in ten of any four groups holds. So four that hold give way to four that hold and begin like a card within their own groups.
    """
    here = "regexp_replace(concat_ws('', slice(g, k + 1, 4)), '[^0-9]', '')"
    kind = f"if(length(d) = 16 AND {_valid_card('d')}, if(d rlike '{ISSUERS}', 2, 1), 0)"
    flags = f"transform(sequence(0, size(g) - 1), k -> {_bound('d', here, kind)})"
    later = "coalesce(greatest(get(f, k + 1), get(f, k + 2), get(f, k + 3)), 0)"
    spaced = _bound("x", _card(key, here), "concat(left(x, 4), s[k], substr(x, 5, 4), s[k + 1], substr(x, 9, 4), s[k + 2], right(x, 4))")
    found = f"if(f[k] = 2 OR f[k] = 1 AND {later} < 2, {spaced}, NULL)"
    taken = "named_struct('o', concat(r.o, if(k > 0, s[k - 1], ''), coalesce(c, g[k])), 'next', k + if(c IS NULL, 1, 4))"
    fold = f"aggregate(sequence(0, size(g) - 1), named_struct('o', '', 'next', 0), (r, k) -> if(k < r.next, r, {_bound('c', found, taken)}), r -> r.o)"
    marks = "filter(split(regexp_replace(m, '[0-9]', ''), ''), c -> c <> '')"
    return _bound("g", "split(m, '[ -]')", _bound("s", marks, _bound("f", flags, fold)))


def _iban(key: str) -> str:
    """The longest run of groups whose remainder holds, permuted and spaced as it was; what follows it stays."""
    whole = "concat_ws('', slice(split(m, ' '), 1, k))"
    valid = f"filter(sequence(size(split(m, ' ')), 1, -1), k -> length({whole}) BETWEEN 15 AND 34 AND {_mod97(f'concat(substr({whole}, 5), left({whole}, 4))')} = 1)"
    body = _letters(key, "iban", "substr(w, 5)")
    made = _bound("body", body, f"concat(left(w, 2), lpad(cast(98 - {_mod97('concat(body, left(w, 2), ' + _quoted('00') + ')')} AS string), 2, '0'), body)")
    spaced = f"if(instr(m, ' ') > 0, regexp_replace({made}, '(.{{4}})(?=.)', '$1 '), {made})"
    rest = "concat_ws('', transform(slice(split(m, ' '), n + 1, 99), x -> concat(' ', x)))"
    changed = _bound("w", "concat_ws('', slice(split(m, ' '), 1, n))", f"concat({spaced}, {rest})")
    return _bound("n", f"try_element_at({valid}, 1)", f"if(n IS NULL, m, {changed})")


def _ssn(key: str) -> str:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999, each permuted among those alone."""
    area, group, serial = "cast(left(m, 3) AS int)", "cast(substr(m, 5, 2) AS int)", "cast(right(m, 4) AS int)"
    result = "concat(lpad(cast(st.a + 1 + if(st.a >= 665, 1, 0) AS string), 3, '0'), '-', lpad(cast(st.b div 9999 + 1 AS string), 2, '0'), '-', lpad(cast(st.b % 9999 + 1 AS string), 4, '0'))"
    moved = _numbers(key, "ssn", f"{area} - 1 - if({area} > 666, 1, 0)", f"({group} - 1) * 9999 + {serial} - 1", "898", "989901", result)
    return f"if({area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0, {moved}, m)"


def _pseudonym(key: str) -> str:
    """The SQL of one match m: its pseudonym, or m itself where it is not valid."""
    d = "regexp_replace(m, '[^0-9]', '')"
    dot = "(length(m) - instr(reverse(m), '.'))"
    phone = f"concat(left(d, greatest(length(d) - 10, 0)), {_digits(key, 'phone', 'right(d, 10)')})"
    octet = lambda k: f"cast(split(m, '[.]')[{k}] AS int)"
    ip = _numbers(key, "ip", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536", "concat_ws('.', st.a div 256, st.a % 256, st.b div 256, st.b % 256)")
    whole = lambda name: _quoted(f"^(?:{FORMS[name]})$")
    return f"""CASE
      WHEN instr(m, '@') > 0 THEN concat({_letters(key, 'email', f'lower(left(m, {dot}))')}, lower(substr(m, {dot} + 1)))
      WHEN m rlike {whole('token')} THEN concat(left(m, 4), {_letters(key, 'token', 'substr(m, 5)')})
      WHEN m rlike {whole('secret')} THEN {_letters(key, 'secret', 'm', 'abcdef')}
      WHEN m rlike {whole('iban')} THEN {_iban(key)}
      WHEN m rlike {whole('date')} THEN {_date(key)}
      WHEN m rlike {whole('ipv6')} THEN {_letters(key, 'ipv6', 'lower(m)', 'abcdef')}
      WHEN m rlike {whole('ip')} THEN if({' AND '.join(f'{octet(k)} < 256' for k in range(4))}, {ip}, m)
      WHEN m rlike {whole('ssn')} THEN {_ssn(key)}
      WHEN m rlike {whole('phone')} THEN {_bound('d', d, _refill('m', phone))}
      WHEN m rlike '^[0-9]{{4}}([ -][0-9]{{4}})+$' THEN {_cards(key)}
      ELSE {_bound('d', d, f"if({_valid_card('d')}, {_refill('m', _card(key, 'd'))}, m)")} END"""


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEMONSTRATION_KEY)


def pseudonymised(docs: DataFrame, key: str, count: str = "n_pii") -> DataFrame:
    """docs with text pseudonymised, and the number of values replaced in the column count (which takes the place of one of that name).

    Other columns and the rows stay as they are. A null text stays null with a count of 0. What a value becomes does not depend on
    the text around it. Values and texts of any length are taken whole. Repeated rows and an empty table stay what they are.
    """
    p, old, new = _quoted(PATTERN), fresh(docs, "pii_found"), fresh(docs, "pii_new")
    none = F.expr("cast(array() AS array<string>)")
    found = F.coalesce(F.expr(f"if({POSSIBLE}, regexp_extract_all(text, {p}, 0), array())"), none)
    put = F.when(F.size(old) > 0, F.expr(f"transform({old}, m -> {_pseudonym(key)})")).otherwise(none)
    filled = F.expr(f"if(size({old}) > 0, array_join(zip_with(split(text, {p}, -1), {new}, (t, v) -> concat(t, coalesce(v, ''))), ''), text)")
    changed = F.expr(f"cast(size(filter(zip_with({old}, {new}, (x, y) -> x <> y), z -> z)) AS bigint)")
    names = [c for c in docs.columns if c.lower() != count.lower()]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], found.alias(old)).withColumn(new, put)
    return rows.select(*[filled.alias("text") if c == "text" else F.col(f"`{c}`") for c in names], changed.alias(count))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pseudonymised() of all documents: one row per row, repeated ones alike; a null text stays null, an empty table stays empty, texts are searched whole."""
    return pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
