"""Personal data: format-preserving pseudonyms by a keyed Feistel network, in SQL expressions alone.

What is found and validated: e-mail addresses, telephone numbers with a country code or of ten grouped
digits (then of code 1), IPv4 addresses (octets to 255), US social security numbers in groups (issuable areas, groups,
serials), payment card numbers (13 to 19 digits, Luhn), IBANs (check digits, capitals or small letters) and dates of the years 1100 to 2899
(yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy, and dd/mm/yyyy if the day is over 12; in the calendar). What fails its
validation is left as it is, and so are nine digits without a separator, which may be any number.

Each validated number or date is a point of a domain a * b; an alternating Feistel network with round
functions from keyed SHA-256 permutes that domain, so equal values get equal pseudonyms in all
documents and formats, different values get different ones, and the holder of the key can go back. The result keeps
the format: digits go where digits were, a card keeps a right Luhn digit, an IBAN right check digits, a
date is a date of the same 200 years (from 1900, 2100 ...). Days up to 12 and over 12 are permuted apart, so that a date
means the same in every format; the second domain walks on until the day is in its month. Of a telephone number
the country code stays, by the table of codes, and a trunk "(0)"; the national number is permuted. An e-mail's
local part has no such domain and becomes ``u`` and 16 hex digits of a keyed hash; its domain stays.

The key must be given. key_of() takes it from the session's setting spark.pairloom.pii.key; where that is unset, it
makes a random one and keeps it there: values stay linked within the application, and nobody can go back after it.

The text is cut at the matches, each is mapped once, and all is joined again; a text without a digit or an @
isn't searched. All of it is evaluated in the JVM, per row, without a shuffle.

Nulls: a null text stays null, an empty one empty. A null doc_id is kept. Rows, repeated rows and other columns
are kept as they are; equal texts get equal results; a very long text is worked on whole; an empty table stays empty.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import parsed_apart, quoted

SETTING = "spark.pairloom.pii.key"
ROUNDS = 8
#: Dates: months of an era, the years from which eras are counted, and domains a * b of days up to 12 and over 12.
ERA, FIRST_YEAR, EARLY, LATE, WALK = 2400, 1100, (160, 180), (200, 228), 40

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DAY, _MONTH = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])"
_YEAR = "(?:1[1-9]|2[0-8])[0-9]{2}"
#: Country calling codes (fixed values): one digit, two digits, and all others of three.
CODES = "(?:1|7|2[07]|3[0123469]|4[013456789]|5[12345678]|6[0123456]|8[1246]|9[0123458]|[2-9][0-9]{2})"
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "date": rf"(?<![0-9/.-])(?:{_YEAR}-{_MONTH}-{_DAY}|{_YEAR}/{_MONTH}/{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|(?:{_MONTH}/{_DAY}|{_DAY}/{_MONTH})/{_YEAR})(?![0-9/-]|\.[0-9])",
    "ipv4": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4})(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])",
    "phone": rf"(?<![0-9+])(?:\+1[ .-]?\(?[0-9]{{3}}\)?[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}|\+{CODES}(?:[ .-]?\(0\))?(?:[ .-]?\([0-9]{{1,5}}\))?(?:[ ./-]?[0-9]){{5,12}}"
    r"|(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?:[a-z0-9]{11,30}|(?: [a-z]{4})?(?: [0-9]{4}){2,7}(?: [0-9]{1,3})?))(?![A-Za-z0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(value: str, a: str, b: str, tweak: str, key: str, back: bool = False) -> str:
    """SQL for the permutation of the long ``value`` in 0 .. a*b-1; ``back`` undoes it.

    The value is l + a * r with l < a and r < b. Even rounds add a keyed function of r to l modulo a, odd
    rounds one of l to r modulo b.
    """
    pick = lambda half: f"cast(conv(substr(sha2(concat({_sql(key)}, '|', {tweak}, '|', cast(i as string), '|', cast(s.{half} as string)), 256), 1, 15), 16, 10) as bigint)"
    sign = "-" if back else "+"
    step = (
        f"if(i % 2 = 0, named_struct('l', pmod(s.l {sign} pmod({pick('r')}, {a}), {a}), 'r', s.r), "
        f"named_struct('l', s.l, 'r', pmod(s.r {sign} pmod({pick('l')}, {b}), {b})))"
    )
    rounds = f"sequence({ROUNDS - 1}, 0, -1)" if back else f"sequence(0, {ROUNDS - 1})"
    start = f"named_struct('l', pmod({value}, {a}), 'r', ({value}) div {a})"
    return f"aggregate({rounds}, {start}, (s, i) -> {step}, s -> s.l + {a} * s.r)"


def digits(text: str, tweak: str, key: str, back: bool = False) -> str:
    """SQL for a string of 2 to 36 digits with its digits permuted: two halves, each below 10 ** 18."""
    half = f"(length({text}) div 2)"
    low, high = f"cast(substr({text}, {half} + 1) as bigint)", f"cast(substr({text}, 1, {half}) as bigint)"
    a, b = f"cast(pow(10, length({text}) - {half}) as bigint)", f"cast(pow(10, {half}) as bigint)"
    pick = lambda x: f"cast(conv(substr(sha2(concat({_sql(key)}, '|', {tweak}, '|', cast(length({text}) as string), '|', cast(i as string), '|', cast(s.{x} as string)), 256), 1, 15), 16, 10) as bigint)"
    sign = "-" if back else "+"
    step = (
        f"if(i % 2 = 0, named_struct('l', pmod(s.l {sign} pmod({pick('r')}, {a}), {a}), 'r', s.r), "
        f"named_struct('l', s.l, 'r', pmod(s.r {sign} pmod({pick('l')}, {b}), {b})))"
    )
    rounds = f"sequence({ROUNDS - 1}, 0, -1)" if back else f"sequence(0, {ROUNDS - 1})"
    done = f"concat(lpad(cast(s.r as string), {half}, '0'), lpad(cast(s.l as string), length({text}) - {half}, '0'))"
    return f"aggregate({rounds}, named_struct('l', {low}, 'r', {high}), (s, i) -> {step}, s -> {done})"


def _refill(shape: str, new: str) -> str:
    """SQL: ``shape`` with its digits replaced, in order, by those of ``new``."""
    step = "if(c rlike '[0-9]', named_struct('o', concat(z.o, substr(z.d, 1, 1)), 'd', substr(z.d, 2)), named_struct('o', concat(z.o, c), 'd', z.d))"
    return f"aggregate(split({shape}, ''), named_struct('o', '', 'd', {new}), (z, c) -> {step}, z -> z.o)"


def _luhn(text: str) -> str:
    """SQL: the Luhn digit that belongs after a string of digits."""
    n = f"length({text})"
    d = f"(cast(substr({text}, k, 1) as int) * (1 + ({n} - k + 1) % 2))"
    return f"pmod(-aggregate(sequence(1, {n}), 0L, (t, k) -> t + {d} div 10 + {d} % 10), 10)"


def _mod97(text: str) -> str:
    """SQL: a string of digits and capitals (A is 10) modulo 97."""
    step = "if(c rlike '[0-9]', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(split({text}, ''), 0, (t, c) -> {step})"


def _let(name: str, value: str, then: str) -> str:
    """SQL: ``then`` with name standing for value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _date(key: str, back: bool) -> str:
    """SQL: the date ``m`` in its format, moved within its 200 years."""
    form = "case when m rlike '^[0-9]{4}' then 'y' when m like '%.%' or cast(substr(m, 1, 2) as int) > 12 then 'd' else 'm' end"
    iso = "case f when 'y' then replace(m, '/', '-') when 'd' then concat(substr(m, 7), '-', substr(m, 4, 2), '-', substr(m, 1, 2)) else concat(substr(m, 7), '-', substr(m, 1, 2), '-', substr(m, 4, 2)) end"
    months = f"(cast(year(d) as bigint) - {FIRST_YEAR}) * 12 + month(d) - 1"
    early = _let("e", feistel("(n % {0}) * 12 + day(d) - 1".format(ERA), str(EARLY[0]), str(EARLY[1]), _sql("date"), key, back), f"struct(n - n % {ERA} + e div 12 as n, cast(e % 12 + 1 as int) as day)")
    step = lambda x: feistel(x, str(LATE[0]), str(LATE[1]), _sql("late"), key, back)
    whole = lambda x: f"make_date(cast((n - n % {ERA} + {x} div 19) div 12 + {FIRST_YEAR} as int), cast((n - n % {ERA} + {x} div 19) % 12 + 1 as int), 1)"
    walked = f"aggregate(sequence(1, {WALK}), {step('(n % {0}) * 19 + day(d) - 13'.format(ERA))}, (w, j) -> if(w % 19 + 13 <= day(last_day({whole('w')})), w, {step('w')}))"
    late = _let("e", walked, f"struct(n - n % {ERA} + e div 19 as n, cast(e % 19 + 13 as int) as day)")
    year, month, day = f"lpad(cast(r.n div 12 + {FIRST_YEAR} as string), 4, '0')", "lpad(cast(r.n % 12 + 1 as string), 2, '0')", "lpad(cast(r.day as string), 2, '0')"
    out = f"if(f = 'y', concat({year}, substr(m, 5, 1), {month}, substr(m, 8, 1), {day}), if(f = 'd', concat({day}, substr(m, 3, 1), {month}, substr(m, 6, 1), {year}), concat({month}, substr(m, 3, 1), {day}, substr(m, 6, 1), {year})))"
    moved = _let("n", months, _let("r", f"if(day(d) <= 12, {early}, {late})", out))
    return _let("f", form, _let("d", f"try_cast({iso} as date)", f"if(d is null, m, {moved})"))


def _mapping(key: str, back: bool = False) -> str:
    """SQL: the pseudonym of the match ``m`` (or the value of a pseudonym, with back)."""
    flat = "regexp_replace(m, '[^0-9]', '')"
    is_ = lambda k: f"m rlike {_sql('^(?:' + PATTERNS[k] + ')$')}"
    email = f"concat('u', substr(sha2(concat({_sql(key)}, '|email|', lower(m)), 256), 1, 16), substr(m, instr(m, '@')))"
    if back:
        email = "m"
    date = _date(key, back)

    part = lambda k: f"cast(split(m, '[.]')[{k}] as bigint)"
    number = feistel(" + ".join(f"{part(k)} * {256 ** (3 - k)}" for k in range(4)), "65536", "65536", _sql("ipv4"), key, back)
    ipv4 = _let("v", number, f"concat_ws('.', {', '.join(f'cast(v div {256 ** (3 - k)} % 256 as string)' for k in range(4))})")

    area, pair, serial = (f"cast(substr({flat}, {i}, {n}) as bigint)" for i, n in ((1, 3), (4, 2), (6, 4)))
    valid = f"{area} between 1 and 899 and {area} <> 666 and {pair} > 0 and {serial} > 0"
    number = feistel(f"({area} - if({area} > 666, 2, 1)) * 989901 + ({pair} - 1) * 9999 + {serial} - 1", "9999", "88902", _sql("ssn"), key, back)
    out = "lpad(cast(v div 989901 + if(v div 989901 >= 665, 2, 1) as string), 3, '0'), lpad(cast(v % 989901 div 9999 + 1 as string), 2, '0'), lpad(cast(v % 9999 + 1 as string), 4, '0')"
    ssn = f"if({valid}, {_let('v', number, _refill('m', f'concat({out})'))}, m)"

    body = f"substr({flat}, 1, length({flat}) - 1)"
    new = _let("h", body, _let("w", digits("h", _sql("card"), key, back), f"concat(w, cast({_luhn('w')} as string))"))
    card = f"if({_luhn(body)} = cast(right({flat}, 1) as int), {_refill('m', new)}, m)"

    head = f"regexp_extract(m, {_sql(f'^(?:[+]{CODES}(?:[ .-]?[(]0[)])?|1[ .-])?')}, 0)"
    code = f"coalesce(nullif(regexp_extract(m, {_sql(f'^[+]({CODES})')}, 1), ''), '1')"
    phone = _let("b", head, _let("t", "substr(m, length(b) + 1)", _let("h", "regexp_replace(t, '[^0-9]', '')", f"concat(b, {_refill('t', digits('h', f'concat({_sql("phone")}, {code})', key, back))})")))

    bban, numerals = "substr(g, 5)", "regexp_replace(substr(g, 5), '[^0-9]', '')"
    kept = _refill(bban, f"if(length({numerals}) < 2, {numerals}, {_let('h', numerals, digits('h', 'substr(g, 1, 2)', key, back))})")
    check = f"lpad(cast(98 - {_mod97('concat(x, substr(g, 1, 2), ' + _sql('00') + ')')} as string), 2, '0')"
    whole = _let("x", kept, f"concat({check}, regexp_replace(x, '[^0-9]', ''))")
    right = f"{_mod97('concat(substr(g, 5), substr(g, 1, 4))')} = 1 and substr(g, 3, 2) between '02' and '98'"
    iban = _let("g", "upper(replace(m, ' ', ''))", f"if({right}, {_refill('m', whole)}, m)")

    cases = " ".join(f"when {is_(k)} then {v}" for k, v in (("email", email), ("date", date), ("ipv4", ipv4), ("ssn", ssn), ("card", card), ("phone", phone), ("iban", iban)))
    return f"case {cases} else m end"


def _searched(text: str, key: str, back: bool, then: str) -> str:
    """SQL: ``then`` of p (what stands between the matches of a text), o (the matches) and n (what each becomes)."""
    return _let("p", f"split({text}, {_sql(ANY)}, -1)", _let("o", f"regexp_extract_all({text}, {_sql(ANY)}, 0)", _let("n", f"transform(o, m -> {_mapping(key, back)})", then)))


_JOINED = "array_join(zip_with(p, n, (l, r) -> concat(l, coalesce(r, ''))), '')"
_COUNTED = "cast(size(filter(zip_with(o, n, (l, r) -> l <> r), x -> x)) as bigint)"


def key_of(spark: SparkSession) -> str:
    """The key that the session names, or a random one for the rest of the application."""
    key = spark.conf.get(SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(SETTING, key)
    return key


def pseudonymised(text: str, key: str, back: bool = False) -> Column:
    """The column ``text`` (SQL) with its personal data replaced."""
    if not key:
        raise ValueError("a key is needed")
    return F.expr(f"case when {text} rlike '[0-9@]' then {_searched(text, key, back, _JOINED)} else {text} end")


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The rows of docs with ``column`` pseudonymised."""
    with parsed_apart(docs.sparkSession):
        return docs.withColumn(column, pseudonymised(f"cast({quoted(column)} as string)", key))


def findings(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_found, text): each document's pseudonymised text and how many places differ."""
    if not key:
        raise ValueError("a key is needed")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = f"case when text rlike '[0-9@]' then {_searched('text', key, False, f'struct({_COUNTED} as n, {_JOINED} as t)')} else struct(0L as n, text as t) end"
    with parsed_apart(docs.sparkSession):
        rows = rows.select("doc_id", F.expr(both).alias("r"))
    return rows.select("doc_id", F.col("r.n").alias("n_found"), F.col("r.t").alias("text"))
