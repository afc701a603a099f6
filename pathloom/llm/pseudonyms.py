"""Operator 8, PII: format-preserving Feistel pseudonyms.

Found values are replaced by a keyed permutation within their own format, so that equal values get equal
pseudonyms in all documents, different values of a format different ones, and nothing else of a text changes:

    email    letters and digits of the local part are permuted within their classes; the domain stays
    ip       dotted IPv4 with octets up to 255, permuted as four octets
    phone    10 digits with separators, or + and 8 to 15 digits with or without separators; the country code
             stays, the other digits are permuted (whatever the separators)
    card     13 to 19 digits (single spaces or hyphens between) with a right Luhn digit; the payload is
             permuted and the Luhn digit computed anew
    ssn      3-2-4 digits in the ranges that are given out, permuted within them
    iban     a right mod-97 account number; country stays, the rest is permuted, check digits computed anew
    date     yyyy-MM-dd, yyyy/MM/dd, dd.MM.yyyy, dd-MM-yyyy, MM/dd/yyyy: every real date of the years 0000 to
             9999; the 400 years 1700 to 2099 (146,097 days) are permuted among themselves, and so are the others
    secret   16 or more letters or digits after token, secret, password or api key and = or :

Values that fail their check are left alone. A value is an array of symbols, each with its own radix; the
array is split in two halves, and eight rounds add to one half, modulo the radices, symbols drawn from
SHA-512 of key, kind, round and the other half. A value may by chance be its own pseudonym, as in any permutation (one
in as many as its format has values). Repeated passes walk along the permutation's cycles and have no short way back.

The key is the caller's to choose; queries take it from ``spark.pathloom.pii.key`` of the session.

Only DataFrame and SQL functions are used, without joins or shuffles: every row is computed where it is read.
Defined results: null text stays null with no finds, empty text stays empty; a very long text is treated whole;
repeated rows are treated alike; an empty table gives an empty result; the other columns, whatever their names or
nulls, pass through ``pseudonymise`` unchanged.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KEY, KEY_SETTING, ROUNDS = "pathloom-demo-key", "spark.pathloom.pii.key", 8
_O = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
KINDS = {
    "email": r"(?<![\p{L}\d._%+-])[\p{L}\d._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": rf"(?<![\w.])(?:{_O}\.){{3}}{_O}(?!\w|\.\d)",
    "phone": r"(?<![\w+.-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[.-]\d{4}|\+[1-9](?:[ .-]?\(?\d\)?){7,14})(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:-\d{4}){3}|\d{4}(?: \d{4}){3}|\d{4}-\d{6}-\d{5}|\d{4} \d{6} \d{5})(?![\w-])",
    "ssn": r"(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)",
    "secret": r"(?<![A-Za-z])(?i:token|secret|password|api[_ -]?key)[ ]{0,2}[=:][ ]{0,2}[\x22']?[A-Za-z0-9_-]{16,}",
}
_NUMERIC = ("ip", "phone", "card", "ssn", "date")
ANY = "|".join([KINDS["email"], rf"(?=[\d+(])(?:{'|'.join(KINDS[k] for k in _NUMERIC)})", KINDS["iban"], KINDS["secret"]])
#: No kind is without one of these; most texts are.
HINT = "[0-9@=:]"
# How the country codes of telephone numbers end (all others have three digits).
COUNTRY_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _sym(v: Column, m: Column | int) -> Column:
    return F.struct(v.cast("int").alias("v"), (F.lit(m) if isinstance(m, int) else m).cast("int").alias("m"))


def feistel(symbols: Column, key: Column | str, kind: str, undo: bool = False) -> Column:
    """A keyed permutation of an array of struct<v, m>, 0 <= v < m, that keeps every m in its place; or its inverse."""
    k = F.lit(key) if isinstance(key, str) else key
    half = F.floor(F.size(symbols) / 2).cast("int")

    def step(acc: Column, i: Column) -> Column:
        fixed, other = (acc["l"], acc["r"]) if undo else (acc["r"], acc["l"])
        digest = F.sha2(F.concat_ws("|", k, F.lit(kind), i.cast("string"), F.array_join(F.transform(fixed, lambda s: s["v"].cast("string")), ",")), 512)

        def draw(s: Column, j: Column) -> Column:
            drawn = F.conv(F.substring(digest, F.pmod(j, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.struct(F.pmod(s["v"] - drawn if undo else s["v"] + drawn, s["m"]).cast("int").alias("v"), s["m"].alias("m"))

        moved = F.transform(other, draw)
        return F.struct(moved.alias("l"), fixed.alias("r")) if undo else F.struct(fixed.alias("l"), moved.alias("r"))

    start = F.struct(F.slice(symbols, F.lit(1), half).alias("l"), F.slice(symbols, half + 1, F.size(symbols)).alias("r"))
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def permuted(s: Column, key: Column | str, kind: str, radix_of_letters: Column | int = 26) -> Column:
    """``s`` with its ASCII letters and digits permuted within their classes; other characters stay."""
    n = F.lit(radix_of_letters) if isinstance(radix_of_letters, int) else radix_of_letters

    def symbol(c: Column) -> Column:
        at = F.instr(F.lit("".join(_ALPHABETS)), c)
        return _sym(F.when(at > 36, at - 37).when(at > 10, at - 11).otherwise(F.greatest(at - 1, F.lit(0))), F.when(at > 10, n).when(at > 0, 10).otherwise(1))

    def back(c: Column, x: Column) -> Column:
        alphabet = F.when(F.instr(F.lit(_ALPHABETS[0]), c) > 0, _ALPHABETS[0]).when(F.instr(F.lit(_ALPHABETS[1]), c) > 0, _ALPHABETS[1]).when(F.instr(F.lit(_ALPHABETS[2]), c) > 0, _ALPHABETS[2])
        return F.coalesce(F.substring(alphabet, x["v"] + 1, F.lit(1)), c)

    return _let(_chars(s), lambda chars: F.array_join(F.zip_with(chars, feistel(F.transform(chars, symbol), key, kind), back), ""))


def luhn_digit(payload: Column) -> Column:
    """The check digit of a string of digits."""
    total = F.aggregate(
        F.transform(F.reverse(_chars(payload)), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        _chars(shape), start,
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substring(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
        lambda acc: acc["out"],
    )


def _mod97(s: Column) -> Column:
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    return F.aggregate(_chars(moved), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


# Where year, month and day stand in each shape of a date, and how it is put together.
_SHAPES = {r"^\d{4}-": ((1, 6, 9), "%s-%s-%s"), r"^\d{4}/": ((1, 6, 9), "%s/%s/%s"), r"^\d{2}\.": ((7, 4, 1), "%3$s.%2$s.%1$s"), r"^\d{2}-": ((7, 4, 1), "%3$s-%2$s-%1$s"), r"^\d{2}/": ((7, 1, 4), "%2$s/%3$s/%1$s")}
#: Days of 400 years; first days (since 1970) of the year 0000 and of the 400 years that are permuted on their own.
_CYCLE, _ORIGIN, _RECENT = 146_097, -719_528, -98_615


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once and written once in the plan."""
    return F.get(F.transform(F.array(value), then), 0)


def _by_shape(m: Column, value: Callable[[tuple[int, ...], str], Column]) -> Column:
    out = None
    for shape, how in _SHAPES.items():
        out = F.when(m.rlike(shape), value(*how)) if out is None else out.when(m.rlike(shape), value(*how))
    return out


def _day(m: Column) -> Column:
    """Days since 1970 of a date text; null if there is no such date."""

    def day(at: tuple[int, ...], _: str) -> Column:
        y, mo, d = (F.substring(m, i, n).cast("int") for i, n in zip(at, (4, 2, 2), strict=True))
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        days = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
        # the year counted from March, so that a leap day is its last
        a = y - F.when(mo <= 2, 1).otherwise(0)
        n = a * 365 + F.floor(a / 4) - F.floor(a / 100) + F.floor(a / 400) + F.floor((153 * F.pmod(mo + 9, F.lit(12)) + 2) / 5) + d - 1
        return F.when(mo.between(1, 12) & d.between(1, days), (n + (_ORIGIN + 60)).cast("int"))

    return _by_shape(m, day)


def _date(m: Column, key: Column | str) -> Column:
    def moved(day: Column) -> Column:
        recent = day.between(_RECENT, _RECENT + _CYCLE - 1)
        # 189 x 773 days of the recent years, 4536 x 773 of all others, whose numbers close ranks
        at = F.when(recent, day - _RECENT).when(day < _RECENT, day - _ORIGIN).otherwise(day - _ORIGIN - _CYCLE)
        radix = F.when(recent, 189).otherwise(4536)
        new = feistel(F.array(_sym(F.floor(at / 773), radix), _sym(at % 773, 773)), key, "date")
        number = _let(new, lambda x: F.get(x, 0)["v"] * 773 + F.get(x, 1)["v"])
        back = _let(number, lambda n: F.when(recent, n + _RECENT).otherwise(F.when(n + _ORIGIN < _RECENT, n + _ORIGIN).otherwise(n + _ORIGIN + _CYCLE)))
        part = lambda x, n: F.lpad(x.cast("string"), n, "0")
        text = _let(back, lambda n: _let(F.date_from_unix_date(n), lambda d: _by_shape(m, lambda _, how: F.format_string(how, part(F.year(d), 4), part(F.month(d), 2), part(F.day(d), 2)))))
        return F.when(day.isNotNull(), text)

    return _let(_day(m), moved)


def _pseudonym(kind: str, m: Column, key: str) -> Column:
    """The pseudonym of a found value, null if it fails its check."""
    if kind == "email":
        local, at = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
        return F.concat(permuted(local, key, kind), at)
    if kind == "ip":
        new = feistel(F.transform(F.split(m, r"\."), lambda o: _sym(o.cast("int"), 256)), key, kind)
        return F.array_join(F.transform(new, lambda s: s["v"].cast("string")), ".")
    digits = F.regexp_replace(m, r"\D", "")
    if kind == "phone":
        code = F.when(m.startswith("+"), F.regexp_extract(digits, COUNTRY_CODE, 0)).otherwise(F.lit(""))
        return _refill(m, _let(code, lambda c: F.concat(c, permuted(F.substring(digits, F.length(c) + 1, F.length(digits)), key, kind))))
    if kind == "card":
        payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
        new = _let(permuted(payload, key, kind), lambda p: _refill(m, F.concat(p, luhn_digit(p))))
        return F.when(luhn_digit(payload) == F.right(digits, F.lit(1)), new)
    if kind == "ssn":
        area = F.substring(digits, 1, 3).cast("int")
        s = feistel(F.array(_sym(F.when(area > 666, area - 2).otherwise(area - 1), 898), _sym(F.substring(digits, 4, 2).cast("int") - 1, 99), _sym(F.substring(digits, 6, 4).cast("int") - 1, 9999)), key, kind)

        def number(x: Column) -> Column:
            area, group, serial = (F.get(x, i)["v"] for i in range(3))
            return F.concat_ws("-", F.lpad((area + F.when(area >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((group + 1).cast("string"), 2, "0"), F.lpad((serial + 1).cast("string"), 4, "0"))

        return _let(s, number)
    if kind == "date":
        return _date(m, key)
    if kind == "iban":
        land = F.substring(m, 1, 2)
        new = _let(permuted(F.substring(m, F.lit(5), F.length(m)), key, kind), lambda rest: F.concat(land, F.lpad((98 - _mod97(F.concat(land, F.lit("00"), rest))).cast("string"), 2, "0"), rest))
        return F.when(_mod97(m) == 1, new)
    value = F.regexp_extract(m, "[A-Za-z0-9_-]+$", 0)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), permuted(value, key, kind, F.when(value.rlike("^[0-9a-fA-F]+$"), 6).otherwise(26)))


def pseudonym(m: Column, key: str) -> Column:
    """What stands for a value that ANY matched: its pseudonym, or itself if no kind's check holds."""
    out = None
    for kind, pattern in KINDS.items():
        # the kind is told from the value alone; what stands around it was seen by ANY
        bare = pattern.split(")", 1)[1] if kind in ("email", "secret") else pattern
        here = m.rlike(f"^(?:{bare})$")
        value = _pseudonym(kind, m, key)
        out = F.when(here, value) if out is None else out.when(here, value)
    return F.coalesce(out, m)


def replaced(text: Column, key: str) -> Column:
    """struct<text, n>: ``text`` with its values pseudonymised, and how many of them there are."""
    found, gaps = F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.split(text, ANY)

    def filled(made: Column) -> Column:
        whole = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(made, i)["p"], F.lit("")))), "")
        return F.struct(whole.alias("text"), F.size(F.filter(made, lambda x: x["p"] != x["m"])).cast("long").alias("n"))

    pairs = F.transform(found, lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p")))
    return F.when(text.rlike(HINT) & text.rlike(ANY), _let(pairs, filled)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every text pseudonymised, the other columns as they are."""
    return docs.withColumn("text", replaced(F.col("text"), key)["text"])


def session_key(spark: SparkSession) -> str:
    """The key set in the session; without one, a key that everybody can read here, good for tests only."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a public key", stacklevel=2)
    return key or KEY


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = docs.withColumn("new", replaced(F.col("text"), session_key(spark)))
    return out.select("doc_id", F.col("new.text").alias("text"), F.col("new.n").alias("n_found"), (F.col("new.n") > 0).alias("changed"))
