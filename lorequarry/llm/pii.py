"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in DataFrame functions only.

A text is cut at everything that looks like personal data, each find is validated, and a valid one is replaced by a
value of the same format that depends on the key and on the find alone, so equal values stay equal across documents
and different ones stay different:

  kind     validated by                                  permuted in
  email    shape                                         letters and digits of each class, the top-level domain stays
  IBAN     mod 97, length                                account part; country stays, check digits are made anew
  date     calendar, years 1900 to 2099                  the dates of these years in the same format; separators stay
  SSN      area, group and serial in use                 all numbers in use
  IPv4     four octets up to 255                         all addresses
  phone    +country code, or (ddd) ddd-dddd and the like digits after the country code
  card     Luhn, 13 to 19 digits                         inner digits; first digit stays, check digit is made anew

What does not validate is left as it is: a long number that fails Luhn, 999.1.1.1, 2023-02-30.

A number x below a * b is split into (x div b, x mod b); rounds add a keyed hash of one part to the other, modulo a
and b in turn, so any such range is permuted within itself.  Strings use the same rounds on their halves, each
character shifted inside its class.

Defined cases: null stays null; empty texts and texts without finds stay the same; of overlapping finds the leftmost
counts; rows that share a doc_id are treated each; an empty table gives no rows; other columns pass through, but one
called n_replaced is replaced.  Whoever knows the key can undo the pseudonyms, so it has no default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![0-9./\-])(?:[0-9]{4}([\-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([\-/.])[0-9]{2}\2[0-9]{4})(?![0-9]|[./\-][0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[\-.][0-9]{4}(?![0-9])|(?<![0-9.\-])[0-9]{3}([\-.])[0-9]{3}\3[0-9]{4}(?![0-9]|[.\-][0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3})(?![0-9])"
ANY = "|".join((EMAIL, IBAN, DATE, SSN, IPV4, PHONE, CARD))

FIRST_DAY, DAYS = "1900-01-01", 17 * 4297  # to 2099-12-31
LATE_DAYS = DAYS - 12 * 12 * 200  # those after the 12th of their month
ROUNDS = 10


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(key: str, *parts: Column) -> Column:
    """A non-negative 60-bit integer."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def permute(x: Column, a: Column | int, b: Column | int, key: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v for v in (a, b))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, F.pmod(s["l"] + F.pmod(_hash(key, i, s["r"]), a), a)).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(_hash(key, i, s["l"]), b), b))
        return F.struct(left.alias("l"), right.alias("r"))

    rest = F.pmod(x, b)
    start = F.struct(F.call_function("div", x - rest, b).alias("l"), rest.alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _shift(c: Column, by: Column) -> Column:
    """A character moved inside its class; others stay."""
    n = F.ascii(c).cast("long")
    out = c
    for low, size in ((48, 10), (65, 26), (97, 26)):
        out = F.when((n >= low) & (n < low + size), F.char((F.pmod(n - low + by, F.lit(size)) + low).cast("long"))).otherwise(out)
    return out


def permute_string(s: Column, key: str) -> Column:
    """A keyed permutation of the strings with the same classes of characters."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1).alias("r"))

    def moved(part: Column, i: Column, by: Column) -> Column:
        chars = F.filter(F.split(part, ""), lambda c: c != "")
        # four hexadecimal digits of a keyed hash for each character, 16 characters a hash
        blocks = F.sequence(F.lit(0), F.floor(F.length(part) / 16).cast("int"))
        stream = F.array_join(F.transform(blocks, lambda p: F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), p.cast("string"), by), 256)), "")
        return _let(stream, lambda h: F.array_join(F.transform(chars, lambda c, p: _let(F.conv(F.substr(h, p * 4 + 1, F.lit(4)), 16, 10).cast("long"), lambda by: _shift(c, by))), ""))

    def step(t: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, moved(t["l"], i, t["r"])).otherwise(t["l"]).alias("l"), F.when(even, t["r"]).otherwise(moved(t["r"], i, t["l"])).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda t: F.concat(t["l"], t["r"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def _permuted_digits(d: Column, key: str) -> Column:
    """A string of up to 18 digits -> another of the same length."""
    n = F.length(d)
    half = F.floor(n / 2)
    return F.lpad(permute(d.cast("long"), _power_of_ten(half), _power_of_ten(n - half), key).cast("string"), n, F.lit("0"))


def _into(form: Column, digits: Column) -> Column:
    """The digits of form replaced by these, in order; other characters stay."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        digit = (c >= "0") & (c <= "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(chars, start, step, lambda s: s["out"])


def luhn_digit(payload: Column) -> Column:
    """The digit that makes payload plus digit pass the Luhn test."""
    n = F.length(payload)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(payload, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _mod97(s: Column) -> Column:
    """Letters count as 10 to 35; the remainder of the decimal number that results."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n >= 65, (rest * 100 + n - 55) % 97).otherwise((rest * 10 + n - 48) % 97)

    return F.aggregate(chars, F.lit(0), step)


def email(m: Column, key: str) -> Column:
    dot = F.length(m) - F.length(F.substring_index(m, ".", -1))
    return F.concat(permute_string(F.substr(m, F.lit(1), dot), key + "email"), F.substring_index(m, ".", -1))


def iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1)
    account = permute_string(F.substr(plain, F.lit(5)), key + "iban")
    country = F.substr(plain, F.lit(1), F.lit(2))
    check = F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    made = F.concat(country, check, account)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    spaced = F.aggregate(
        F.filter(F.split(m, ""), lambda c: c != ""),
        start,
        lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substr(made, s["at"], F.lit(1)))).alias("out"), (s["at"] + (c != " ").cast("int")).alias("at")),
        lambda s: s["out"],
    )
    return F.when(valid, spaced).otherwise(m)


def _month_start(month: Column) -> Column:
    """The first day of a month, counted from that of FIRST_DAY."""
    return F.add_months(F.lit(FIRST_DAY).cast("date"), month.cast("int"))


def _late_index(day: Column) -> Column:
    """Days after the 12th are numbered from 0 on, without gaps."""
    months = (F.year(day) - F.year(F.lit(FIRST_DAY).cast("date"))) * 12 + F.month(day) - 1
    return (F.datediff(day, F.lit(FIRST_DAY).cast("date")) - 12 * (months + 1)).cast("long")


def _late_day(index: Column) -> Column:
    """The day of such a number: its month is the last one that starts at or before it, near the mean of 18.437 numbers a month."""
    start = lambda m: F.datediff(_month_start(m), F.lit(FIRST_DAY).cast("date")) - 12 * m

    def placed(i: Column) -> Column:
        months = _let(F.floor(i / 18.437).cast("int"), lambda guess: F.sequence(F.greatest(guess - 3, F.lit(0)), guess + 3))
        return _let(F.array_max(F.filter(months, lambda m: start(m) <= i)), lambda m: F.date_add(_month_start(m), (i - start(m) + 12).cast("int")))

    return _let(index, placed)


def permute_below(x: Column, n: int, a: int, b: int, key: str) -> Column:
    """A keyed permutation of 0 .. n - 1, n <= a * b: what falls outside is permuted again, which a * b - n + 1 steps suffice for."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), permute(x, a, b, key), lambda y, _: F.when(y >= n, permute(y, a, b, key)).otherwise(y))


def date(m: Column, key: str) -> Column:
    """ISO dates are permuted among all days of the years.

    The others may have the day or the month first.  Where both numbers are up to 12 they are permuted among all such
    strings; where one is a day after the 12th, the order is known, and they are permuted among all such days.
    """
    iso = m.rlike("^[0-9]{4}")
    sep = F.when(iso, F.substr(m, F.lit(5), F.lit(1))).otherwise(F.substr(m, F.lit(3), F.lit(1)))
    d = _digits(m)
    first = F.lit(FIRST_DAY).cast("date")
    low, high, year = (F.substr(d, F.lit(i), F.lit(n)) for i, n in ((1, 2), (3, 2), (5, 4)))
    days = F.datediff(F.try_to_date(d, "yyyyMMdd"), first).cast("long")
    moved = F.date_add(first, permute(days, 17, 4297, key + "date").cast("int"))
    iso_text = _let(moved, lambda x: F.concat_ws("", F.date_format(x, "yyyy"), sep, F.date_format(x, "MM"), sep, F.date_format(x, "dd")))
    a, b, y = low.cast("long"), high.cast("long"), year.cast("long")
    known = y.between(1900, 2099)
    early = known & a.between(1, 12) & b.between(1, 12)
    both = permute((y - 1900) * 144 + (a - 1) * 12 + b - 1, 160, 180, key + "date early")
    early_text = _let(both, lambda x: F.format_string("%02d%s%02d%s%04d", F.call_function("div", F.pmod(x, F.lit(144)), F.lit(12)) + 1, sep, F.pmod(x, F.lit(12)) + 1, sep, F.call_function("div", x, F.lit(144)) + 1900))

    def late(day: Column, form: tuple[str, str]) -> tuple[Column, Column]:
        new = _late_day(permute_below(_late_index(day), LATE_DAYS, 210, 211, key + "date late"))
        return day.isNotNull() & known & (F.dayofmonth(day) > 12), _let(new, lambda x: F.concat_ws("", F.date_format(x, form[0]), sep, F.date_format(x, form[1]), sep, F.date_format(x, "yyyy")))

    day_first, day_first_text = late(F.try_to_date(F.concat(year, high, low), "yyyyMMdd"), ("dd", "MM"))
    month_first, month_first_text = late(F.try_to_date(F.concat(year, low, high), "yyyyMMdd"), ("MM", "dd"))
    return (
        F.when(iso & (days >= 0) & (days < DAYS), iso_text)
        .when(iso, m)
        .when(early, early_text)
        .when(day_first, day_first_text)
        .when(month_first, month_first_text)
        .otherwise(m)
    )


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = ((F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1) * 9999 + serial - 1
    new = permute(index, 898 * 99, 9999, key + "ssn")
    upper = F.call_function("div", new, F.lit(9999))
    a = F.call_function("div", upper, F.lit(99)) + 1
    text = F.format_string("%03d-%02d-%04d", F.when(a >= 666, a + 1).otherwise(a), F.pmod(upper, F.lit(99)) + 1, F.pmod(new, F.lit(9999)) + 1)
    return F.when(valid, text).otherwise(m)


def ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    valid = F.forall(octets, lambda o: o < 256)
    number = F.aggregate(octets, F.expr("0L"), lambda t, o: t * 256 + o)
    new = permute(number, 65536, 65536, key + "ip")
    parts = [F.pmod(F.shiftright(new, 8 * i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)]
    return F.when(valid, F.concat_ws(".", *parts)).otherwise(m)


def phone(m: Column, key: str) -> Column:
    country = F.when(m.startswith("+"), F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .\-(])|^\+[0-9]", 0)).otherwise("")
    rest = F.substr(m, F.length(country) + 1)
    d = _digits(rest)
    return F.when(F.length(d).between(7, 14), F.concat(country, _into(rest, _permuted_digits(d, key + "phone")))).otherwise(m)


def card(m: Column, key: str) -> Column:
    d = _digits(m)
    inner = F.substr(d, F.lit(2), F.length(d) - 2)
    payload = F.concat(F.substr(d, F.lit(1), F.lit(1)), _permuted_digits(inner, key + "card"))
    return F.when(F.call_function("luhn_check", d), _into(m, F.concat(payload, luhn_digit(payload)))).otherwise(m)


KINDS: tuple[tuple[str, str, Callable[[Column, str], Column]], ...] = (
    ("email", EMAIL, email),
    ("iban", IBAN, iban),
    ("date", DATE, date),
    ("ssn", SSN, ssn),
    ("ip", IPV4, ipv4),
    ("phone", PHONE.replace(r"\3", r"\1"), phone),
    ("card", CARD, card),
)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a find; the find itself if it doesn't validate."""
    out = None
    for _, pattern, make in KINDS:
        fits = m.rlike(f"^(?:{pattern})$")
        out = F.when(fits, make(m, key)) if out is None else out.when(fits, make(m, key))
    return out.otherwise(m)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with the personal data of text replaced, and n_replaced, the number of finds that were."""
    text = F.col("text")
    worth = text.rlike("[@0-9]")
    found = docs.withColumn("__found", F.when(worth, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    found = found.withColumn("__new", F.when(F.size("__found") > 0, F.transform("__found", lambda m: pseudonym(m, key))))
    pieces = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(pieces, F.col("__new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("__found", "__new", lambda a, b: a != b), lambda x: x))
    return found.withColumns({"text": F.when(F.col("__new").isNotNull(), joined).otherwise(text), "n_replaced": F.when(F.col("__new").isNotNull(), changed).otherwise(0)}).drop("__found", "__new")
