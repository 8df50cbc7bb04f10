"""Format-preserving pseudonyms for personal numbers, dates and addresses, with DataFrame expressions only.

Values are found by pattern, validated, and permuted within their format by a keyed Feistel network, so that equal
values get equal pseudonyms in every document, different values different ones, and no table of them is kept:

* card    13 to 19 digits with a right Luhn digit: the other digits are permuted and the Luhn digit is set anew
* phone   10 national digits of the North American plan, with or without +1: area code, and exchange with line, are
          permuted, and each of the two keeps whether its first digit is 2 or more, as valid ones have it; or + and an
          assigned country code with 8 to 15 digits in all: the digits after the code are permuted; a "(0)" stays
* ssn     ddd-dd-dddd in the valid range: permuted within that range
* ip      four numbers to 255: permuted as 32 bits; where one is written with leading zeros, all get three digits
* date    yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy that exists, from 1800 to 2199: permuted among all days of these years
* email   the local part: letters and digits are permuted, each keeps its kind; one alone never stays as it is; the domain,
          two labels or more of any length, stays

The same value in another notation (spaces, hyphens, date order) has the same pseudonym in that notation. Numbers that
fail validation are left alone.

The key is a literal of the query plan. Sites that keep plans or event logs should set
``spark.sql.redaction.string.regex`` so that it matches the key.

Edge cases: null text stays null; repeated rows get equal pseudonyms; values are found wherever they stand in a text, whatever its length; digits inside
words and longer numbers are no values; extra columns are kept, but those named like the added counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "ip", "date", "ssn", "phone", "card")
#: In the order in which they are tried at a place of a text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*+",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![A-SU-Za-z0-9_-]|T(?!\d))",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,12}(?:[ .-]\d{2,8}){0,4})(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
FIRST_DAY, DAYS = "1800-01-01", (27, 5411)  # 146,097 days, a whole Gregorian cycle
SSN_PARTS = (898 * 99, 9999)
#: Assigned country codes of one and two digits; all others have three (ITU-T E.164).
SHORT_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55",
    "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)


def _number(key: str, label: str, i: Column, other: Column) -> Column:
    """Round function: 60 bits of a keyed digest."""
    digest = F.md5(F.concat_ws("|", F.lit(key), F.lit(label), i.cast("string"), other.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def permuted_pair(x: Column, y: Column, sizes: tuple, key: str, label: str) -> Column:
    """Keyed permutation of pairs (x, y) with x below sizes[0] and y below sizes[1] (numbers or columns), as struct(x, y)."""
    a, b = ((s if isinstance(s, Column) else F.lit(s)).cast("bigint") for s in sizes)

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["x"] + _number(key, label, i, s["y"]), a).alias("x"), s["y"].alias("y"))
        right = F.struct(s["x"].alias("x"), F.pmod(s["y"] + _number(key, label, i, s["x"]), b).alias("y"))
        return F.when(i % 2 == 0, left).otherwise(right)

    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _turned(c: Column, by: Column) -> Column:
    """A letter or digit moved on within its kind; other characters stay."""
    code, step = F.ascii(c), by.cast("int")
    moved = lambda first, n: F.chr(F.lit(first) + F.pmod(code - first + step, F.lit(n)))
    return (
        F.when(c.rlike("^[0-9]$"), moved(48, 10)).when(c.rlike("^[a-z]$"), moved(97, 26)).when(c.rlike("^[A-Z]$"), moved(65, 26)).otherwise(c)
    )


def permuted_text(s: Column, key: str, label: str) -> Column:
    """Keyed permutation of strings that keeps every character's kind and place."""

    def half(text: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), i.cast("string"), other), 512)
        byte = lambda k: F.conv(F.substring(stream, F.pmod(k, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10)
        return F.array_join(F.transform(F.split(text, ""), lambda c, k: _turned(c, byte(k))), "")

    def turn(acc: Column, i: Column) -> Column:
        left = F.struct(half(acc["x"], acc["y"], i).alias("x"), acc["y"].alias("y"))
        right = F.struct(acc["x"].alias("x"), half(acc["y"], acc["x"], i).alias("y"))
        return F.when(i % 2 == 0, left).otherwise(right)

    cut = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), cut).alias("x"), F.substring(s, cut + 1, F.length(s)).alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["x"], acc["y"]))


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum from the last digit; ``doubled_first`` starts by doubling it."""
    odd = 0 if doubled_first else 1
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, k: F.when(k % 2 == odd, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda acc, v: acc + v)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _refilled(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced by ``digits``, one by one."""

    def put(acc: Column, c: Column) -> Column:
        isd = c.rlike("^[0-9]$")
        at = F.when(isd, acc["i"] + 1).otherwise(acc["i"])
        return F.struct(at.alias("i"), F.concat(acc["s"], F.when(isd, F.substring(digits, at, F.lit(1))).otherwise(c)).alias("s"))

    return F.aggregate(F.split(m, ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("s")), put, lambda acc: acc["s"])


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = permuted_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    check = F.pmod(F.lit(10) - luhn_sum(body, True) % 10, F.lit(10))
    return _refilled(m, F.concat(body, check.cast("string")))


def _abroad(m: Column) -> Column:
    """Whether a phone number has a country code other than 1."""
    return m.startswith("+") & ~_digits(m).startswith("1")


def _code_length(d: Column) -> Column:
    return F.when(F.substring(d, 1, 1).isin("1", "7"), 1).when(F.substring(d, 1, 2).isin(*SHORT_CODES), 2).otherwise(3)


def _trunk(m: Column) -> Column:
    """1 if a trunk zero stands in parentheses behind the country code: no part of the number abroad."""
    return F.when(m.rlike(r"^\+\d{1,3}[ .-]?\(0\)"), 1).otherwise(0)


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    code = F.when(_abroad(m), _code_length(d) + _trunk(m)).otherwise(F.length(d) - 10)
    own = F.substring(d, code + 1, F.length(d) - code)
    number = lambda first, n: F.substring(own, first, n).cast("bigint")
    low = lambda v: F.when(v < 200, 0).otherwise(200)
    size = lambda v: F.when(v < 200, 200).otherwise(800)
    area, exchange = number(1, 3), number(4, 3)
    sizes = size(area), size(exchange) * 10_000
    home = permuted_pair(area - low(area), (exchange - low(exchange)) * 10_000 + number(7, 4), sizes, key, "phone")

    def write(s: Column) -> Column:
        return F.concat(F.lpad((s["x"] + low(area)).cast("string"), 3, "0"), F.lpad((s["y"] + low(exchange) * 10_000).cast("string"), 7, "0"))

    fresh = F.when(_abroad(m), permuted_text(own, key, "phone")).otherwise(F.transform(F.array(home), write)[0])
    return _refilled(m, F.concat(F.substring(d, F.lit(1), code), fresh))


def _ip(m: Column, key: str) -> Column:
    p = F.split(m, r"\.")
    part = lambda k: p[k].cast("int")
    out = permuted_pair(part(0) * 256 + part(1), part(2) * 256 + part(3), (65536, 65536), key, "ip")
    padded = m.rlike(r"(?:^|\.)0\d")
    octet = lambda v: F.when(padded, F.lpad(v.cast("string"), 3, "0")).otherwise(v.cast("string"))
    text = lambda v: F.concat_ws(".", octet(F.floor(v / 256)), octet(v % 256))
    return F.transform(F.array(out), lambda s: F.concat_ws(".", text(s["x"]), text(s["y"])))[0]


def _day(m: Column) -> Column:
    """The date as written, or null."""
    iso = F.when(m.rlike(r"^\d{4}-"), m)
    dotted = F.regexp_replace(m, r"^(\d\d)\.(\d\d)\.(\d{4})$", "$3-$2-$1")
    slashed = F.regexp_replace(m, r"^(\d\d)/(\d\d)/(\d{4})$", "$3-$1-$2")
    return F.try_to_timestamp(F.coalesce(iso, F.when(m.contains("."), dotted).otherwise(slashed)), F.lit("yyyy-MM-dd")).cast("date")


def _date(m: Column, key: str) -> Column:
    n = F.datediff(_day(m), F.lit(FIRST_DAY).cast("date"))
    out = permuted_pair(F.floor(n / DAYS[1]), n % DAYS[1], DAYS, key, "date")

    def write(s: Column) -> Column:
        day = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["x"] * DAYS[1] + s["y"]).cast("int"))
        form = lambda f: F.date_format(day, f)
        return F.when(m.contains("-"), form("yyyy-MM-dd")).when(m.contains("."), form("dd.MM.yyyy")).otherwise(form("MM/dd/yyyy"))

    return F.transform(F.array(out), write)[0]


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    out = permuted_pair(index * 99 + group - 1, serial - 1, SSN_PARTS, key, "ssn")

    def write(s: Column) -> Column:
        a = F.floor(s["x"] / 99) + 1
        a = F.when(a >= 666, a + 1).otherwise(a)
        pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return F.concat_ws("-", pad(a, 3), pad(s["x"] % 99 + 1, 2), pad(s["y"] + 1, 4))

    return F.transform(F.array(out), write)[0]


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    kinds = F.when(local.rlike("^[0-9]$"), 10).otherwise(26)
    alone = _turned(local, 1 + F.pmod(_number(key, "email", F.lit(0), F.lit("")), kinds - 1))
    return F.concat(F.when(F.length(local) == 1, alone).otherwise(permuted_text(local, key, "email")), F.lit("@"), F.substring_index(m, "@", -1))


def kind_of(m: Column) -> Column:
    """Kind of a matched string, or null if it is not valid."""
    ip = F.forall(F.split(m, r"\."), lambda p: p.cast("int") <= 255)
    day, area = _day(m), F.substring(m, 1, 3).cast("int")
    in_range = day.isNotNull() & F.year(day).between(1800, 2199)
    ssn = area.between(1, 899) & (area != 666) & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    d = _digits(m)
    card = F.length(d).between(13, 19) & (luhn_sum(d, False) % 10 == 0)
    phone = ~_abroad(m) & (F.length(d) - F.when(d.startswith("1"), 1).otherwise(0) >= 10) & (F.length(d) <= 11)
    phone = phone | (_abroad(m) & (F.length(d) - _trunk(m)).between(8, 15) & ~d.startswith("0"))
    shape = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    return (
        F.when(m.contains("@"), "email")
        .when(shape("ip"), F.when(ip, "ip"))
        .when(shape("date"), F.when(in_range, "date"))
        .when(shape("ssn"), F.when(ssn, "ssn"))
        .when(shape("phone"), F.when(phone, "phone"))
        .when(card, "card")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    out = m
    for k, f in zip(KINDS, (_email, _ip, _date, _ssn, _phone, _card), strict=True):
        out = F.when(kind == k, f(m, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and a count n_<kind> of the values of each kind.

    One pass over the rows; texts without a digit or @ skip the patterns.
    """
    added = [f"n_{k}" for k in KINDS]
    kept = [c for c in docs.columns if c not in added]
    none = F.array().cast("array<string>")
    found = F.when(F.col(text).rlike("[@0-9]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)
    rows = docs.select(*kept, F.coalesce(found, none).alias("__m"))
    rows = rows.select(*kept, F.transform("__m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("k"))).alias("__m"))
    fresh = F.transform("__m", lambda v: pseudonym(v["m"], v["k"], key))
    joined = F.array_join(
        F.zip_with(F.split(text, ANY, -1), fresh, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), ""
    )
    counts = [F.size(F.filter("__m", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    changed = F.when(F.exists("__m", lambda v: v["k"].isNotNull()), joined).otherwise(F.col(text)).alias(text)
    return rows.select(*[changed if c == text else F.col(c) for c in kept], *counts)


def _is(kind: str):
    return lambda v: v["k"] == kind
