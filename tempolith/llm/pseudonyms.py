"""Format-preserving pseudonyms for personal data. Built-in functions only.

Values are found by pattern and validated (check digits, calendar, octets, number ranges). A valid value
becomes a sequence of symbols, each from an alphabet of its own size, and a keyed Feistel network permutes
the sequences of its format: in each round one half is shifted, symbol by symbol, by amounts drawn from a
keyed hash of the other half. So a pseudonym has the same format and validity, equal values have equal
pseudonyms in all documents, different values have different ones, and the key's owner can invert them.

=========== =============================================== ==========================================================
kind        found as                                        symbols
=========== =============================================== ==========================================================
card        13 to 19 digits, grouped or not, Luhn-valid     digits but the first and the check digit
phone       + country code, one to five national groups     national digits
ssn         ddd-dd-dddd in the issued ranges                area, group, serial
ip          four octets                                     octets
date        y-m-d, d.m.y, m/d/y or d/m/y, calendar-valid    day number in its block of 73,000 days, or day, month, year
email       local part and domain                           letters and digits of the local part
iban        country, check digits, account; mod 97 valid    account digits; check digits follow
secret      access key ids, quoted tokens, passwords        letters and digits, or hex digits
=========== =============================================== ==========================================================

Letters in an IBAN's account stay. Its blanks may stand among letters only in the countries whose accounts have
letters; there the country's length tells where it ends, so words in capitals after it don't count. A secret's
label is found in any case, and copies of one secret in capitals and in small letters have the same pseudonym but
for the case; where a permuted symbol sequence would fall into another format it is permuted again.

Invalid look-alikes stay as they are. Null texts stay null, with no values; whole texts are treated; repeated
rows get equal results; an empty table gives an empty one; other columns pass through, one named ``pii`` as ``pii_input``.
The key is part of the plan, as any literal is: who reads plans or event logs can invert the pseudonyms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

ROUNDS = 6  # even, so that the halves end where they began
#: Days of a block, as 250 x 292 symbols; the first block begins on 1900-01-01.
DATE_MODULI, DATE_DAYS, DATE_ORIGIN = (250, 292), 73_000, "1900-01-01"
#: 0001-01-01 and 9999-12-31, counted from there. The first and last block lie half outside, so a date there is
#: outside after so many turns once in 2 to the power of 60; of days over 12, three in a hundred are in no month.
FIRST_DAY, LAST_DAY, DATE_TURNS, DAY_FIRST_TURNS = -693_595, 2_958_463, 64, 16
#: The key of the registered query, which is public; callers pass one of their own.
QUERY_KEY = "tempolith"
#: Set around values while a text is cut; a text that has it is gone through twice instead.
CUT = "\ue0f7"

#: Countries whose accounts may have letters, by the length of their IBAN.
LETTERED = {
    18: "FK NL", 19: "MK", 20: "KZ LU", 21: "CH LI LV", 22: "BG BH GB GE IE", 23: "GI IQ OM", 24: "AD MD PK RO SA VG", 26: "TR", 27: "FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HN LB NI SV", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _lettered(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


IBANS = [*(_lettered(*x) for x in LETTERED.items()), r"[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){2,7}(?: ?[0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"]
#: A digit of a phone number after the one before; written out as often as it occurs, for look-behind must have a bound.
NEXT = r"[ .\-()]{0,3}[0-9]"
#: What follows the plus sign: ten digits after a 1, else up to five groups that end with the 15th digit at the latest and
#: not inside a date, an address or another number of several parts.
NUMBERS = [
    r"1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}",
    r"[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?[0-9]{1,12}|[0-9]{1,14})(?:[ .\-][0-9]{1,12}){0,4}"
    rf"(?<=[0-9]{NEXT * 7})(?<![0-9]{NEXT * 15})(?!/[0-9]{{1,2}}/[0-9])(?![.\-][0-9]+[.\-][0-9])",
    r"[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}",
]
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"\b(?i:AKIA[0-9A-Z]{16}\b|password=[0-9A-Z]{6,128}|token = \"[0-9A-Z]{8,256}\")",
    "iban": rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(IBANS)})\b",
    "phone": rf"(?<![0-9])\+(?:{'|'.join(NUMBERS)})(?![0-9])",
    "date": r"(?<![0-9.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9\-/]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is(value: str, kind: str) -> str:
    return f"({value}) rlike {_quoted('^(?:' + PATTERNS[kind].replace('(?<![0-9])', '') + ')$')}"


class Network:
    """SQL text of the keyed permutation; ``inverse`` undoes it."""

    def __init__(self, key: str, inverse: bool = False):
        self.key, self.inverse = key, inverse

    def permuted(self, symbols: str, moduli: str, tweak: str) -> str:
        """``symbols`` and ``moduli`` are SQL arrays of integers of one length; so is the result."""
        half = f"cast(size({symbols}) / 2 as int)"
        rounds = range(ROUNDS, 0, -1) if self.inverse else range(1, ROUNDS + 1)
        sign = "-" if self.inverse else "+"
        # forward: (a, b) -> (b, a + f(b)); backward: (a, b) -> (b - f(a), a)
        fixed, moved, of_fixed, of_moved = ("a", "b", "ma", "mb") if self.inverse else ("b", "a", "mb", "ma")
        digest = f"sha2(concat({_quoted(self.key)}, '|', {tweak}, '|', r, '|', array_join(s.{fixed}, ',')), 256)"
        shift = "cast(conv(substr(h, 1 + 7 * (i % 9), 7), 16, 10) as bigint)"
        new = f"transform(s.{moved}, (x, i) -> cast(pmod(x {sign} {shift}, s.{of_moved}[i]) as int))"
        new = f"element_at(transform(array({digest}), h -> {new}), 1)"
        step = f"named_struct('a', {new}, 'b', s.a, 'ma', s.mb, 'mb', s.ma)" if self.inverse else f"named_struct('a', s.b, 'b', {new}, 'ma', s.mb, 'mb', s.ma)"
        start = (
            f"named_struct('a', slice({symbols}, 1, {half}), 'b', slice({symbols}, {half} + 1, size({symbols})), "
            f"'ma', slice({moduli}, 1, {half}), 'mb', slice({moduli}, {half} + 1, size({moduli})))"
        )
        return f"aggregate(array({', '.join(map(str, rounds))}), {start}, (s, r) -> {step}, s -> concat(s.a, s.b))"

    def bound(self, name: str, value: str, body: str) -> str:
        """``body`` with ``name`` standing for ``value``, worked out once."""
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def characters(self, text: str, tweak: str, hexadecimal: bool | str = False, digits_only: bool = False) -> str:
        """The permutation of the letters and digits of ``text``; every other character keeps its place. Hex digits
        are small, or with ``hexadecimal="upper"`` capital letters."""
        letters = "lower" if not digits_only else ""
        size = "if(c rlike '[0-9]', 10, 26)" if not hexadecimal else "16"
        value = "if(c rlike '[0-9]', ascii(c) - 48, ascii(lower(c)) - 97)" if not hexadecimal else "cast(conv(c, 16, 10) as int)"
        wanted = "c rlike '[0-9]'" if digits_only else "c rlike '[0-9A-Za-z]'" if letters else ""
        put = "if(w.c rlike '[0-9]', chr(48 + w.v), if(w.c rlike '[A-Z]', chr(65 + w.v), chr(97 + w.v)))" if not hexadecimal else f"{'upper' if hexadecimal == 'upper' else 'lower'}(conv(w.v, 10, 16))"
        body = self.bound("k", f"filter(cs, c -> {wanted})", self.bound(
            "p", self.permuted(f"transform(k, c -> {value})", f"transform(k, c -> {size})", f"concat({tweak}, '|', array_join(transform(k, c -> {size}), ','))"),
            # the n-th letter or digit of the text takes the n-th permuted symbol
            "array_join(aggregate(cs, named_struct('n', 0, 'out', cast(array() as array<string>)), (s, c) -> "
            f"if({wanted}, named_struct('n', s.n + 1, 'out', concat(s.out, array(element_at(transform(array(named_struct('c', c, 'v', p[s.n])), w -> {put}), 1)))), "
            "named_struct('n', s.n, 'out', concat(s.out, array(c)))), s -> s.out), '')",
        ))
        return self.bound("cs", f"split({text}, '')", body)


def luhn_sum(digits: str, parity: str) -> str:
    """Sum over an array of digits, each ``parity``-th from the right doubled (0: the last one too)."""
    return f"aggregate(transform(reverse({digits}), (d, i) -> if((i + {parity}) % 2 = 0, if(d > 4, d * 2 - 9, d * 2), d)), 0, (s, d) -> s + d)"


def _digits(value: str) -> str:
    return f"transform(split(regexp_replace({value}, '[^0-9]', ''), ''), c -> cast(c as int))"


def _fill(template: str, digits: str) -> str:
    """``template`` with its digits replaced in order by those of the string ``digits``."""
    return (
        f"array_join(aggregate(split({template}, ''), named_struct('n', 1, 'out', cast(array() as array<string>)), (s, c) -> "
        f"if(c rlike '[0-9]', named_struct('n', s.n + 1, 'out', concat(s.out, array(substr({digits}, s.n, 1)))), "
        "named_struct('n', s.n, 'out', concat(s.out, array(c)))), s -> s.out), '')"
    )


def _card(net: Network) -> tuple[str, str]:
    valid = f"{luhn_sum(_digits('v'), '1')} % 10 = 0 and regexp_replace(v, '[^0-9]', '') not rlike '^0+$'"
    inner = "slice(d, 2, size(d) - 2)"
    body = net.bound("d", _digits("v"), net.bound(
        "m", f"concat(slice(d, 1, 1), {net.permuted(inner, f'transform({inner}, x -> 10)', chr(39) + 'card' + chr(39))})",
        _fill("v", f"concat(array_join(m, ''), cast((10 - {luhn_sum('m', '0')} % 10) % 10 as string))"),
    ))
    return valid, body


def _phone(net: Network) -> tuple[str, str]:
    country = r"regexp_extract(v, '^\\+[0-9]{1,3}(?=[ .(\\-])|^\\+[0-9]', 0)"
    return "length(regexp_replace(v, '[^0-9]', '')) between 8 and 15", f"concat({country}, {net.characters(f'substr(v, length({country}) + 1)', f'concat(chr(112), {country})', digits_only=True)})"


def _ssn(net: Network) -> tuple[str, str]:
    valid = "substr(v, 1, 3) not in ('000', '666') and substr(v, 1, 1) <> '9' and substr(v, 5, 2) <> '00' and substr(v, 8, 4) <> '0000'"
    area = "cast(substr(v, 1, 3) as int) - if(substr(v, 1, 3) > '666', 2, 1)"
    symbols = f"array({area}, cast(substr(v, 5, 2) as int) - 1, cast(substr(v, 8, 4) as int) - 1)"
    body = net.bound("p", net.permuted(symbols, "array(898, 99, 9999)", "'ssn'"), "format_string('%03d-%02d-%04d', p[0] + if(p[0] >= 665, 2, 1), p[1] + 1, p[2] + 1)")
    return valid, body


def _ip(net: Network) -> tuple[str, str]:
    octets = "transform(split(v, '[.]'), x -> cast(x as int))"
    valid = f"forall({octets}, x -> x <= 255) and forall(split(v, '[.]'), x -> x = cast(cast(x as int) as string))"
    return valid, f"array_join({net.permuted(octets, 'array(256, 256, 256, 256)', chr(39) + 'ip' + chr(39))}, '.')"


def _date(net: Network) -> tuple[str, str]:
    """Slashes mean month first where that is a date. Day first has a day over 12: those move among such days of their century.
    What falls outside the calendar is permuted again, until it is a date of the years 1 to 9999."""
    formats = "case when v like '%-%' then 'yyyy-MM-dd' when v like '%.%' then 'dd.MM.yyyy' when try_to_timestamp(v, 'MM/dd/yyyy') is not null then 'MM/dd/yyyy' else 'dd/MM/yyyy' end"
    day = "date_diff(cast(try_to_timestamp(v, f) as date), date'" + DATE_ORIGIN + "')"
    valid = net.bound("f", formats, f"{day} between {FIRST_DAY} and {LAST_DAY}")
    symbols = f"array(cast(y div {DATE_MODULI[1]} as int), cast(y % {DATE_MODULI[1]} as int))"
    moved = net.bound("p", net.permuted(symbols, f"array({DATE_MODULI[0]}, {DATE_MODULI[1]})", "concat('date', f)"), f"p[0] * {DATE_MODULI[1]} + p[1]")
    inside = f"turn > 1 and b + y between {FIRST_DAY} and {LAST_DAY}"
    numbered = net.bound("n", day, net.bound("b", f"cast(floor(n / {DATE_DAYS}) as int) * {DATE_DAYS}", (
        f"date_format(date_add(date'{DATE_ORIGIN}', b + aggregate(sequence(1, {DATE_TURNS}), n - b, (y, turn) -> if({inside}, y, {moved}))), f)"
    )))
    symbols = "array(cast(substr(y, 1, 2) as int) - 13, cast(substr(y, 4, 2) as int) - 1, cast(substr(y, 9, 2) as int))"
    moved = net.bound("p", net.permuted(symbols, "array(19, 12, 100)", "concat('day', substr(v, 7, 2))"), "format_string('%02d/%02d/%s%02d', p[0] + 13, p[1] + 1, substr(v, 7, 2), p[2])")
    inside = "turn > 1 and year(try_to_timestamp(y, 'dd/MM/yyyy')) > 0"
    day_first = f"aggregate(sequence(1, {DAY_FIRST_TURNS}), v, (y, turn) -> if({inside}, y, {moved}))"
    return valid, net.bound("f", formats, f"if(f = 'dd/MM/yyyy', {day_first}, {numbered})")


def _email(net: Network) -> tuple[str, str]:
    local, domain = "substring_index(v, '@', 1)", "lower(substring_index(v, '@', -1))"
    return f"{local} rlike '[0-9A-Za-z]'", f"concat({net.characters(local, f'concat(chr(64), {domain})')}, '@', substring_index(v, '@', -1))"


def _mod97(text: str) -> str:
    return f"aggregate(split({text}, ''), 0, (s, c) -> (s * if(c rlike '[0-9]', 10, 100) + if(c rlike '[0-9]', ascii(c) - 48, ascii(c) - 55)) % 97)"


def _iban(net: Network) -> tuple[str, str]:
    bare = "replace(v, ' ', '')"
    valid = net.bound("z", bare, f"{_mod97('concat(substr(z, 5), substr(z, 1, 4))')} = 1 and length(z) between 15 and 34")
    body = net.bound("z", bare, net.bound("q", net.characters("substr(z, 5)", "concat('iban', substr(z, 1, 2))", digits_only=True), net.bound(
        "t", f"concat(lpad(cast(98 - {_mod97(f'concat(q, substr(z, 1, 2), {chr(39)}00{chr(39)})')} as string), 2, '0'), q)", _fill("v", "regexp_replace(t, '[^0-9]', '')"))))
    return valid, body


def _secret(net: Network) -> tuple[str, str]:
    head = r"regexp_extract(v, '(?i)^AKIA|^password=|^token = \"', 0)"
    rest = f"substr(v, length({head}) + 1)"
    label = f"if({head} ilike 'akia', 'AKIA', lower({head}))"
    lower, upper = ("{0} rlike '^[0-9a-f]+\"?$'", "{0} rlike '^[0-9A-F]*[A-F][0-9A-F]*\"?$'")
    by_hex = net.characters(rest, f"concat('hex', {label})", hexadecimal=True)
    # only the formats' own values: capital hex keeps a letter, and others don't become hex
    again = lambda form, once: f"aggregate(sequence(1, 32), {rest}, (y, turn) -> if(turn > 1 and {form.format('y')}, y, {once}))"
    by_upper = again(upper, net.characters("y", f"concat('hex', {label})", hexadecimal="upper"))
    by_class = again(f"not ({lower} or {upper})", net.characters("y", f"concat('key', {label})"))
    by_id = net.characters(rest, f"concat('key', {label})")
    return "true", f"concat({head}, case when {head} ilike 'akia' then {by_id} when {lower.format(rest)} then {by_hex} when {upper.format(rest)} then {by_upper} else {by_class} end)"


_KINDS = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card}


#: What a value of a kind has at least, told without its pattern.
_SIGNS = {
    "email": "instr(v, '@') > 0", "secret": "ascii(v) > 64", "iban": "ascii(v) between 65 and 90", "phone": "ascii(v) = 43",
    "date": "length(v) = 10", "ssn": "length(v) = 11", "ip": "instr(v, '.') > 0", "card": "length(v) > 12",
}


def pseudonym(value: str, key: str, inverse: bool = False) -> str:
    """SQL: (kind, value) of a match, with a null kind and the value as it was if it isn't valid."""
    net = Network(key, inverse)
    cases = []
    for kind, make in _KINDS.items():
        valid, body = make(net)
        cases.append(f"when {_SIGNS[kind]} and {_is('v', kind)} and ({valid}) then named_struct('kind', '{kind}', 'value', {body})")
    chosen = f"case {' '.join(cases)} else named_struct('kind', cast(null as string), 'value', v) end"
    return net.bound("v", value, chosen)


def cut_at_values(text: Column) -> Column:
    """The text in parts, every second of which is a match of ``ANY``."""
    once = F.split(F.regexp_replace(text, f"(?:{ANY})", f"{CUT}$0{CUT}"), CUT, -1)
    gaps, values = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    twice = F.slice(F.flatten(F.zip_with(gaps, values, lambda gap, value: F.array(gap, value))), 1, 2 * F.size(values) + 1)
    return F.when(F.contains(text, F.lit(CUT)), twice).otherwise(once)


def pseudonymised(df: DataFrame, *, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """``df`` with ``text`` rewritten and ``pii``: (kind, pseudonym) of each valid value, in order."""
    found = df.select(store.whole_row(df, ["pii"]).alias("row"), store.column(text).alias("text")).withColumn("parts", cut_at_values(F.col("text")))
    plain = "named_struct('kind', cast(null as string), 'value', part)"
    found = found.withColumn("new", F.expr(f"transform(parts, (part, i) -> if(i % 2 = 0, {plain}, {pseudonym('part', key, inverse)}))"))
    joined = F.when(F.size("parts") > 1, F.array_join(F.transform("new", lambda x: x["value"]), "")).otherwise(F.col("text"))
    pii = F.filter(F.coalesce("new", F.array()), lambda x: x["kind"].isNotNull())
    return found.select(*[joined.alias(c) if c == text else F.col(f"row.{_tick(n)}") for c, n in zip(df.columns, _fields(df), strict=True)], pii.alias("pii"))


def _fields(df: DataFrame) -> list[str]:
    return df.select(store.whole_row(df, ["pii"]).alias("row")).schema["row"].dataType.fieldNames()


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op5_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pseudonymised(store.read_table(spark, sf_dir, "documents").select("doc_id", "text"), key=QUERY_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"]))), ",")
    return rows.select("doc_id", F.size("pii").cast("long").alias("n_values"), kinds.alias("kinds"), F.transform("pii", lambda x: x["value"]).alias("pseudonyms"), "text")


QUERIES = {"op5_feistel": op5_feistel}
SQL: dict[str, str] = {}
