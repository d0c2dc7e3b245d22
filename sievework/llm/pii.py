"""Pseudonyms for personal data, with native operations only.

Candidates are found by one pattern, validated (check digits, calendar, octets,
number plans) and replaced by a keyed permutation of their own format: a Feistel
network whose halves are shifted in turn by a keyed hash of the other.  A
permutation keeps different values different and equal values equal, so they
stay linked across documents without a table of what stands for what.

Letters stay letters (with their case), digits digits; separators, country codes
and mail domains stay; check digits are made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Steps of a walk over numbers that mean no date, a fifth of all: more than any takes.
WALK = 40

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: kind -> Java pattern, in the order in which they are tried at a place.  The value of
#: a secret is the first numbered group; the separators of others are named ones.
_VALUE = r"[^\s\"'<>]"
#: What a secret's value may end with: no mark of the sentence around it.
_LAST = r"[^\s\"'<>,;.:!?()\[\]{}]"
_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key)"
_SIGN = r"[\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"']?"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    # The short look-behind spares most places the long one.
    "secret": rf"(?:(?<=[=:][ \t]{{0,2}}[\"']?)(?<={_NAME}{_SIGN})(?:(?<==[ \t]{{0,2}}[\"']?)|(?<=[\"'])|(?={_VALUE}{{8}}|{_VALUE}*[^\s\"'<>A-Za-z,;.:!?()\[\]{{}}]))"
              rf"|(?<=(?i:bearer)[ \t]{{1,2}})(?=[A-Za-z0-9._~+/=-]{{8}})|(?<![A-Za-z0-9_-])(?=sk-[A-Za-z0-9_-]{{12}}|gh[pousr]_[A-Za-z0-9]{{20}}|xox[abp]-[A-Za-z0-9-]{{10}}))({_VALUE}*{_LAST})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?<!(?:[Vv]ersion|[Vv]er|[Rr]elease|[Bb]uild)[ .:=]{{0,2}})(?<!(?:[Ss]ection|[Ss]ec\.|[Cc]hapter|[Ff]igure|[Ff]ig\.|[Tt]able|[Cc]lause|§) {{0,2}})(?!\d(?:\.\d){{3}}(?!\d))(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\w)",
    "date": r"(?<![\w.-])(?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])(?<dot>[./])(?:0[1-9]|[12]\d|3[01])\k<dot>(?:19|20)\d\d)(?![\w-])",
    "card": r"(?<![\w-])(?:\d{4}(?<four>[ -]?)\d{4}\k<four>\d{4}\k<four>\d{1,7}|3[47]\d\d(?<six>[ -]?)\d{6}\k<six>\d{5})(?![\w-])",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])",
    "phone": r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])[2-9]\d\d(?<gap>[-. ])[2-9]\d\d\k<gap>\d{4}(?![\w-])",
}
#: No text without these holds any of them.
_MAY_HOLD = r"[0-9@=:]|A[KS]IA|[Bb][Ee][Aa][Rr][Ee][Rr][ \t]|sk-|gh[pousr]_|xox[abp]-"
#: Letters beyond ASCII that move within their class; others stay.
_ALPHABETS = [
    "".join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7),
    "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2), "".join(chr(c) for c in range(0x391, 0x3AA) if c != 0x3A2),
    "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))),
]


#: What is laid anew into a format, and what stays of it.
_LETTER, _MARK = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


class Held(str):
    """The name of a column that holds a key, so that the key itself is in no plan."""


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _whole(value: str, kind: str) -> str:
    """Whether value is of the kind, as seen without its surroundings."""
    pattern = PATTERNS[kind]
    return f"({value} RLIKE {_q('^(?:' + pattern + ')$')})"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _hash(key: str, turn: str, other: str, kind: str) -> str:
    return f"sha2(concat_ws('|', {key if isinstance(key, Held) else _q(key)}, {_q(kind)}, {turn}, {other}), 256)"


def _number_of(hash_sql: str) -> str:
    return f"CAST(conv(substr({hash_sql}, 1, 15), 16, 10) AS BIGINT)"


def permuted_text(value: str, key: str, kind: str) -> str:
    """SQL: letters and digits of value, each within its class."""
    beyond = " ".join(f"WHEN locate(c.x, {_q(a)}) > 0 THEN substr({_q(a)}, (locate(c.x, {_q(a)}) - 1 + c.k) % {len(a)} + 1, 1)" for a in _ALPHABETS)
    shift = (
        "CASE WHEN c.x BETWEEN '0' AND '9' THEN chr(48 + (ascii(c.x) - 48 + c.k) % 10) WHEN c.x BETWEEN 'a' AND 'z' THEN chr(97 + (ascii(c.x) - 97 + c.k) % 26) "
        "WHEN c.x BETWEEN 'A' AND 'Z' THEN chr(65 + (ascii(c.x) - 65 + c.k) % 26) "
        f"WHEN c.x < chr(128) THEN c.x {beyond} ELSE c.x END")
    moved = (f"array_join(transform(transform(sequence(1, greatest(1, length(s.a))), j -> named_struct('x', substr(s.a, j, 1), 'k', "
             f"CAST(conv(substr({_hash(key, 'i', 's.b', kind)}, 4 * ((j - 1) % 16) + 1, 4), 16, 10) AS INT))), c -> {shift}), '')")
    half = f"length({value}) div 2"
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('a', substr({value}, 1, {half}), 'b', substr({value}, {half} + 1)), "
            f"(s, i) -> named_struct('a', s.b, 'b', {moved}), s -> concat(s.a, s.b))")


def permuted_number(value: str, a: int, b: int, key: str, kind: str) -> str:
    """SQL: a permutation of the integers below a * b."""
    left = f"(s.l + {_number_of(_hash(key, 'i', 's.r', kind))}) % {a}L"
    right = f"(s.r + {_number_of(_hash(key, 'i', 's.l', kind))}) % {b}L"
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('l', ({value}) div {b}L, 'r', ({value}) % {b}L), "
            f"(s, i) -> IF(i % 2 = 0, named_struct('l', {left}, 'r', s.r), named_struct('l', s.l, 'r', {right})), s -> s.l * {b}L + s.r)")


def _laid(template: str, new: str) -> str:
    """SQL: the letters and digits of template replaced, in order, by the characters of new."""
    return (f"array_join(transform(sequence(1, length({template})), p -> IF(substr({template}, p, 1) RLIKE {_q(_LETTER)}, "
            f"substr({new}, length(regexp_replace(substr({template}, 1, p), {_q(_MARK)}, '')), 1), substr({template}, p, 1))), '')")


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name standing for value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _luhn_sum(digits: str, from_right: int) -> str:
    """Luhn sum; from_right 0 counts the last digit as the check digit."""
    return (f"aggregate(sequence(1, length({digits})), 0, (t, q) -> t + IF((length({digits}) - q + {from_right}) % 2 = 0, CAST(substr({digits}, q, 1) AS INT), "
            f"2 * CAST(substr({digits}, q, 1) AS INT) - IF(substr({digits}, q, 1) > '4', 9, 0)))")


def _mod97(text: str) -> str:
    return (f"aggregate(sequence(1, length({text})), 0, (t, q) -> IF(substr({text}, q, 1) BETWEEN '0' AND '9', (t * 10 + ascii(substr({text}, q, 1)) - 48) % 97, "
            f"(t * 100 + ascii(substr({text}, q, 1)) - 55) % 97))")


def _replacements(key: str) -> dict[str, str]:
    """kind -> SQL of m's pseudonym; null: m is not valid, so it stays."""
    email = f"concat({_let(_q('') + ' || split(m, ' + _q('@') + ')[0]', 'u', _laid('u', _let('regexp_replace(u, ' + _q(_MARK) + ', ' + _q('') + ')', 'w', permuted_text('w', key, 'email'))))}, '@', split(m, '@')[1])"
    card = _let(_digits("m"), "d", f"CASE WHEN length(d) BETWEEN 13 AND 19 AND {_luhn_sum('d', 0)} % 10 = 0 THEN " + _let(
        f"concat(substr(d, 1, 1), {_let('substr(d, 2, length(d) - 2)', 'w', permuted_text('w', key, 'card'))})", "n",
        _let(f"concat(n, CAST((10 - {_luhn_sum('n', 1)} % 10) % 10 AS STRING))", "z", _laid("m", "z"))) + " END")
    iban = _let("regexp_replace(m, ' ', '')", "d", f"CASE WHEN {_mod97('concat(substr(d, 5), substr(d, 1, 4))')} = 1 THEN " + _let(
        _let("substr(d, 5)", "w", permuted_text("w", key, "iban")), "n", _let(
            f"concat(substr(d, 1, 2), lpad(CAST(98 - {_mod97('concat(n, substr(d, 1, 2), ' + _q('00') + ')')} AS STRING), 2, '0'), n)", "z", _laid("m", "z"))) + " END")
    octets = "aggregate(split(m, '[.]'), 0L, (t, o) -> t * 256L + CAST(o AS BIGINT))"
    ip = _let(permuted_number(octets, 65536, 65536, key, "ip"), "n", "concat_ws('.', n div 16777216L, n div 65536L % 256L, n div 256L % 256L, n % 256L)")
    # Days of 1900 to 2099: 17 * 4297.  With strokes, a day above 12 tells day-first
    # from month-first; both are one set of values, so that no two get one pseudonym:
    # number 2 * day + (day-first), and numbers that mean no value are walked over.
    number = lambda d: f"CAST(datediff({d}, DATE'1900-01-01') AS BIGINT)"
    since = lambda n: f"date_add(DATE'1900-01-01', CAST({n} AS INT))"
    plain = lambda pattern: _let(f"try_to_date(m, '{pattern}')", "d", f"CASE WHEN d IS NOT NULL THEN date_format({since(permuted_number(number('d'), 17, 4297, key, 'date'))}, '{pattern}') END")
    first = "substr(m, 1, 2) > '12'"
    means = f"(x % 2L = 0L OR day({since('x div 2L')}) > 12)"
    walked = f"aggregate(sequence(1, {WALK}), 2L * {number('d')} + IF({first}, 1L, 0L), (x, turn) -> IF(turn > 1 AND {means}, x, {permuted_number('x', 34, 4297, key, 'date')}))"
    strokes = _let(f"IF({first}, try_to_date(m, 'dd/MM/yyyy'), try_to_date(m, 'MM/dd/yyyy'))", "d", "CASE WHEN d IS NOT NULL THEN " + _let(
        walked, "n", f"IF(n % 2L = 0L, date_format({since('n div 2L')}, 'MM/dd/yyyy'), date_format({since('n div 2L')}, 'dd/MM/yyyy'))") + " END")
    date = f"CASE WHEN substr(m, 5, 1) = '-' THEN {plain('yyyy-MM-dd')} WHEN substr(m, 3, 1) = '.' THEN {plain('dd.MM.yyyy')} ELSE {strokes} END"
    # Area 001-665 and 667-899 without 666: 898 areas; 99 groups; 9999 numbers.
    ssn_index = "(CAST(substr(m, 1, 3) AS BIGINT) - IF(substr(m, 1, 3) > '666', 2, 1)) * 989901L + (CAST(substr(m, 5, 2) AS BIGINT) - 1) * 9999L + CAST(substr(m, 8) AS BIGINT) - 1"
    ssn = _let(permuted_number(ssn_index, 898 * 99, 9999, key, "ssn"), "n",
               "concat(lpad(CAST(n div 989901L + IF(n div 989901L >= 665, 2, 1) AS STRING), 3, '0'), '-', lpad(CAST(n div 9999L % 99 + 1 AS STRING), 2, '0'), '-', lpad(CAST(n % 9999L + 1 AS STRING), 4, '0'))")
    # Ten digits of the North American plan, areas and exchanges from 2: 8000 * 800000.
    plan = "right(d, 10)"
    index = (f"((CAST(substr({plan}, 1, 1) AS BIGINT) - 2) * 1000 + CAST(concat(substr({plan}, 2, 2), substr({plan}, 5, 1)) AS BIGINT)) * 800000L "
             f"+ (CAST(substr({plan}, 4, 1) AS BIGINT) - 2) * 100000L + CAST(substr({plan}, 6) AS BIGINT)")
    american = _let(permuted_number(index, 8000, 800000, key, "phone"), "n", _let(
        "concat(CAST(n div 800000000L + 2 AS STRING), lpad(CAST(n div 800000L % 1000 AS STRING), 3, '0'), CAST(n % 800000L div 100000L + 2 AS STRING), lpad(CAST(n % 100000L AS STRING), 5, '0'))", "y",
        _let("concat(substr(d, 1, length(d) - 10), substr(y, 1, 3), substr(y, 5, 1), substr(y, 4, 1), substr(y, 6))", "z", _laid("m", "z"))))
    head = "IF(startswith(m, '+'), length(regexp_extract(m, '^[+]([0-9]{1,3})', 1)), 0)"
    other = _let(f"concat(substr(d, 1, {head}), {_let(f'substr(d, {head} + 1)', 'w', permuted_text('w', key, 'phone'))})", "z", _laid("m", "z"))
    phone = _let(_digits("m"), "d", f"CASE WHEN length(d) NOT BETWEEN 7 AND 15 THEN NULL WHEN (length(d) = 10 AND NOT startswith(m, '+') OR length(d) = 11 AND startswith(m, '+1')) "
                 f"AND substr({plan}, 1, 1) > '1' AND substr({plan}, 4, 1) > '1' THEN {american} ELSE {other} END")
    return {"email": email, "key": f"concat(substr(m, 1, 4), {_let('substr(m, 5)', 'w', permuted_text('w', key, 'key'))})", "iban": iban, "ip": ip, "date": date, "card": card, "ssn": ssn,
            "phone": phone, "secret": permuted_text("m", key, "secret")}


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All rows of docs in `_row`, and _masked (the text with pseudonyms), n_found
    and pseudonyms array<struct<kind, value>>.

    Null stays null, with none found; a text without personal data stays as it
    is.  What fails validation (check digits, calendar) stays too, but what stands
    behind a secret's name (in any case, also as the end of a longer name or in
    quotes), after "bearer" or with a token's prefix is masked whatever it looks like,
    to its end; behind a colon, words of less than eight plain letters are prose and
    stay.  Four single digits are a section, no address.  Letters of Latin, Greek and
    Cyrillic move, those of other scripts stay.  Repeated rows are masked alike; an
    empty table gives no rows; very long texts take time in proportion to their
    length; columns of any name come back in `_row`.  Keep key secret: it links and
    would unlock.  It reaches the tasks as the value of a subquery, so plans, the UI
    and event logs don't show it.
    """
    if not key:
        raise ValueError("a key is needed")
    every = "|".join(f"(?:{p})" for p in PATTERNS.values())
    held = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    new = _replacements(Held("_key"))
    kind = "CASE WHEN named <> '' THEN 'secret' " + " ".join(f"WHEN {_whole('m', k)} THEN {_q(k)}" for k in ["email", "key", "iban", "ip", "date", "card", "ssn", "phone"]) + " ELSE 'secret' END"
    value = "CASE k " + " ".join(f"WHEN {_q(k)} THEN {sql}" for k, sql in new.items()) + " END"
    row = docs.select(F.struct("*").alias("_row")).withColumn("_t", F.col(f"_row.`{text}`").cast("string")).withColumn("_key", held)
    found = row.withColumn("_found", F.expr(f"CASE WHEN _t RLIKE {_q(_MAY_HOLD)} THEN regexp_extract_all(_t, {_q(every)}, 0) END"))
    named = found.withColumn("_new", F.expr(
        f"transform(zip_with(_found, regexp_extract_all(_t, {_q(every)}, 1), (m, named) -> named_struct('m', m, 'k', {kind})), e -> named_struct('m', e.m, 'k', e.k, 'v', {_let('e.m', 'm', _let('e.k', 'k', value))}))"))
    whole = F.expr(f"CASE WHEN size(_found) > 0 THEN array_join(zip_with(split(_t, {_q(every)}, -1), transform(_new, e -> coalesce(e.v, e.m)), (x, y) -> concat(x, coalesce(y, ''))), '') ELSE _t END")
    valid = F.expr("transform(filter(_new, e -> e.v IS NOT NULL), e -> named_struct('kind', e.k, 'value', e.v))")
    return named.select("_row", whole.alias("_masked"), F.coalesce(F.expr("CAST(size(filter(_new, e -> e.v IS NOT NULL)) AS BIGINT)"), F.lit(0)).cast("long").alias("n_found"),
                        F.coalesce(valid, F.expr("CAST(array() AS array<struct<kind:string,value:string>>)")).alias("pseudonyms"))
