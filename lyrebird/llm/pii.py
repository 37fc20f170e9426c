"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in Spark expressions.

Found values are validated, then permuted within their format, so a value gets the same pseudonym in every document
and two values never share one. Characters are permuted within their class (a-z, 0-9), numbers modulo two factors of
their domain's size: card numbers keep a right check digit, addresses their octets' range, dates a real day. A date with
slashes is read day first where it can be, else month first; these two kinds are permuted each within its own, so a
pseudonym is read as its value was.

Plans hold no key, but a digest of it for each kind of value, which is what the rounds take: whoever sees a plan or an
event log can undo its pseudonyms, though not learn the key. Keep these as you keep the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: 400 Gregorian years have 146,097 = 189 * 773 days; 898 areas, 99 groups and 9999 serials make an SSN.
DAY_0, DAYS = "1800-01-01", (189, 773)
#: Of these days, 88,497 = 9 * 9833 are after the twelfth of their month; a month has 18.436875 of them.
LATE, LATE_DAYS, LATE_A_MONTH = 12, (9, 9833), 18.436875
SSN = (898, 99 * 9999)

_L, _R = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,7}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _R,
    "card": _L + r"(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _R,
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z/-])",
}
_SHAPES = {k: p.split(")", 1)[1] for k, p in PATTERNS.items()}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def subkey(key: str, kind: str) -> str:
    """What stands for the key in the rounds of one kind of value."""
    return hashlib.sha256(f"{len(key)}|{key}|{kind}".encode()).hexdigest()


def _digest(key: str, kind: str, r: Column, x: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(subkey(key, kind)), r.cast("string"), x.cast("string")), 256)


def _number(hexed: Column, start: Column | int, n: int) -> Column:
    at = start if isinstance(start, Column) else F.lit(start)
    return F.conv(F.substring(hexed, at, F.lit(n)), 16, 10).cast("long")


def _let(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _characters(x: Column, key: str, kind: str) -> Column:
    """A Feistel network over the halves of x; a character moves within a-z or 0-9, and all others stay."""

    def moved(half: Column, by: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            d = _number(by, F.pmod(i, F.lit(32)) * 2 + 1, 2)
            letter = F.char((97 + F.pmod(F.ascii(c) - 97 + d, F.lit(26))).cast("long"))
            digit = F.char((48 + F.pmod(F.ascii(c) - 48 + d, F.lit(10))).cast("long"))
            return F.when(c.between("a", "z"), letter).when(c.between("0", "9"), digit).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    n = F.char_length(x)
    cut = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(x, F.lit(1), cut).alias("a"), F.substring(x, cut + 1, n).alias("b"))
    turn = lambda s, r: F.struct(s["b"].alias("a"), moved(s["a"], _digest(key, kind, r, s["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _integer(x: Column, key: str, kind: str, size: tuple[int, int]) -> Column:
    """A permutation of the numbers below size[0] * size[1]."""
    start = F.struct(F.floor(x / size[1]).cast("long").alias("a"), F.pmod(x, F.lit(size[1])).cast("long").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        m = F.when(r % 2 == 1, F.lit(size[0])).otherwise(F.lit(size[1])).cast("long")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + _number(_digest(key, kind, r, s["b"]), 1, 14), m).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["a"] * size[1] + s["b"])


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits; a valid number's is a multiple of 10."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))


def _filled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by these, in order."""
    place = lambda i: F.char_length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c.between("0", "9"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")


def _email(x: Column, key: str) -> Column:
    low = F.lower(x)
    end = F.substring_index(low, ".", -1)
    return F.concat(_let(F.substring(low, F.lit(1), F.char_length(low) - F.char_length(end)), lambda y: _characters(y, key, "email")), end)


def _phone(x: Column, key: str) -> Column:
    """All but the ten last digits stay."""
    d = F.regexp_replace(x, "[^0-9]", "")
    code = F.substring(d, F.lit(1), F.char_length(d) - 10)
    return _let(F.concat(code, _let(F.right(d, F.lit(10)), lambda y: _characters(y, key, "phone"))), lambda y: _filled(x, y))


def _card(x: Column, key: str) -> Column:
    """The first digit stays and the last is the new check digit; null where the number's own is wrong."""
    d = F.regexp_replace(x, "[^0-9]", "")
    inner = F.concat(F.left(d, F.lit(1)), _characters(F.substring(d, F.lit(2), F.char_length(d) - 2), key, "card"))
    whole = _let(inner, lambda y: F.concat(y, F.pmod(10 - _luhn(F.concat(y, F.lit("0"))), F.lit(10)).cast("string")))
    return F.when(_luhn(d) % 10 == 0, _let(whole, lambda y: _filled(x, y)))


def _ssn(x: Column, key: str) -> Column:
    """Null where area, group or serial are never issued."""
    area, group, serial = (F.substring(x, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    fine = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    at = (F.when(area > 666, area - 2).otherwise(area - 1)) * SSN[1] + (group - 1) * 9999 + serial - 1

    def shown(n: Column) -> Column:
        a = F.floor(n / SSN[1]).cast("long")
        rest = F.pmod(n, F.lit(SSN[1]))
        return F.concat_ws("-", *(F.lpad(c.cast("string"), w, "0") for c, w in ((F.when(a >= 665, a + 2).otherwise(a + 1), 3), (F.floor(rest / 9999).cast("long") + 1, 2), (F.pmod(rest, F.lit(9999)) + 1, 4))))

    return F.when(fine, _let(_integer(at, key, "ssn", SSN), shown))


def _ip(x: Column, key: str) -> Column:
    """Null where a part is over 255."""
    parts = F.transform(F.split(x, r"\."), lambda c: c.cast("long"))
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    shown = lambda y: F.concat_ws(".", *(F.pmod(F.floor(y / 256**k).cast("long"), F.lit(256)).cast("string") for k in (3, 2, 1, 0)))
    return F.when(F.forall(parts, lambda p: p < 256), _let(_integer(n, key, "ip", (65536, 65536)), shown))


def _late_place(day: Column) -> Column:
    """The number of a day after the twelfth among all such days."""
    months = (F.year(day) - 1800) * 12 + F.month(day) - 1
    return (F.datediff(day, F.lit(DAY_0).cast("date")) - LATE * (months + 1)).cast("long")


def _late_day(n: Column) -> Column:
    """The day with this number. Months differ by few days from their mean, so one of three is the right one."""
    about = F.floor(n / LATE_A_MONTH).cast("int")
    first = lambda m: F.add_months(F.lit(DAY_0).cast("date"), m)
    begins = lambda m: F.datediff(first(m), F.lit(DAY_0).cast("date")) - LATE * m
    month = F.when(begins(about + 1) <= n, about + 1).when(begins(about) <= n, about).otherwise(about - 1)
    return _let(month, lambda m: F.date_add(F.lit(DAY_0).cast("date"), (n + LATE * (m + 1)).cast("int")))


def _date(x: Column, key: str) -> Column:
    """In the shape that it has; null where it is no day of the years 1800 to 2199."""
    first, last = F.lit(DAY_0).cast("date"), F.lit("2199-12-31").cast("date")

    def moved(day: Column, f: str) -> Column:
        return _let(_integer(F.datediff(day, first).cast("long"), key, "date", DAYS), lambda n: F.date_format(F.date_add(first, n.cast("int")), f))

    def moved_late(day: Column, f: str) -> Column:
        return _let(_integer(_late_place(day), key, "late date", LATE_DAYS), lambda n: F.date_format(_late_day(n), f))

    out = F.lit(None).cast("string")
    forms = (("____-__-__", "yyyy-MM-dd", moved), ("__/__/____", "dd/MM/yyyy", moved), ("__/__/____", "MM/dd/yyyy", moved_late), ("__.__.____", "dd.MM.yyyy", moved))
    for shape, f, move in reversed(forms):
        day = F.try_to_timestamp(x, F.lit(f)).cast("date")
        out = F.when(x.like(shape) & day.between(first, last), move(day, f)).otherwise(out)
    return out


_NEW = {"email": _email, "phone": _phone, "card": _card, "ssn": _ssn, "ip": _ip, "date": _date}


def pseudonyms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the personal data in text replaced, and n_email, n_phone, n_card, n_ssn, n_ip and n_date (long).

    Values that aren't valid stay: wrong check digits, octets over 255, days that don't exist. A null text stays null,
    an empty one empty, and one without personal data as it is; its counts are 0. Texts are read to their ends, however
    long. Emails are compared and shown in lower case. Rows are worked on one by one, in one projection without a shuffle,
    so rows that repeat get equal results, and no rows give none. Nulls in other columns pass through; columns of docs
    that have the name of a count are replaced.
    """
    x = F.col(text)

    def replaced(hit: Column) -> Column:
        kind = F.lit(None).cast("string")
        for k, shape in reversed(_SHAPES.items()):
            kind = F.when(hit.rlike(f"^(?:{_bare(shape)})$"), k).otherwise(kind)

        def new(k: Column) -> Column:
            out = F.lit(None).cast("string")
            for name, f in _NEW.items():
                out = F.when(k == name, f(hit, key)).otherwise(out)
            return _let(out, lambda y: F.struct(F.coalesce(y, hit).alias("value"), F.when(y.isNotNull(), k).alias("kind")))

        return _let(kind, new)

    some = x.rlike("[0-9@]") & x.rlike(ANY)
    hits = F.when(some, F.transform(F.regexp_extract_all(x, F.lit(ANY), F.lit(0)), replaced))
    out = docs.withColumn("__hits", hits)
    parts = F.zip_with(F.split(x, ANY, -1), F.col("__hits"), lambda p, h: F.concat(p, F.coalesce(h["value"], F.lit(""))))
    of = lambda k: F.filter("__hits", lambda h: h["kind"] == k)
    counts = {f"n_{k}": F.when(F.col("__hits").isNull(), F.lit(0)).otherwise(F.size(of(k))).cast("long") for k in PATTERNS}
    return out.withColumns({text: F.when(F.col("__hits").isNull(), x).otherwise(F.array_join(parts, "")), **counts}).drop("__hits")


def _bare(shape: str) -> str:
    """A pattern without the look-ahead at its end."""
    return shape[: shape.rindex("(?!")]
