"""Column functions on text: tokens, snippets, formats, coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never terms.
STOP_WORDS = (
    "a i am an as at be by do he hi if in is me my no of ok on or so to up us we "
    "the and for are but not you all can had her was one our out day get has him his how its may new now old see two who boy "
    "did she use way many sit set run ago off too any say try ask end why let put own tell very when much would there their "
    "what said each which will about could other after first never these think where being every great might shall still "
    "those while this that with have from they know want been good some time than them well were"
).split()


def terms(text: Column) -> Column:
    """Array of the terms of a text: runs of two or more letters or digits, lower-cased, without stop words."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}]{2,})"), F.lit(1)), F.lower)
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def terms_with_query(text: Column) -> Column:
    """The same with the whole trimmed text as a first term, which is not counted twice."""
    whole = F.lower(F.trim(text))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(whole), F.filter(terms(text), lambda w: w != whole)))


def truncated(text: Column, n: int) -> Column:
    """The first n - 1 characters and three dots, where the text is longer than n."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("..."))).otherwise(text)


def split_lines(content: Column) -> Column:
    """Lines with CRLF and CR taken as LF; one empty line at the end goes."""
    flat = F.regexp_replace(content, "\r\n?", "\n")
    return F.split(F.regexp_replace(flat, r"\n\z", ""), "\n", -1)


def line_at(text: Column, offset: Column | int) -> Column:
    """1-based number of the line that holds an offset."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.regexp_count(F.left(text, at), F.lit("\n")) + 1


def one_line(text: Column) -> Column:
    """CR dropped, LF to a blank."""
    return F.translate(text, "\n\r", " ")


def safe_name(name: Column) -> Column:
    """Characters outside [A-Za-z0-9._-] become _, and _ at the ends goes."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._\-]", "_"), "^_+|_+$", "")


def parse_gps(text: Column) -> Column:
    """struct(x, y, z) of x:y:z (three parts) or GPS:name:x:y:z... (five or more); null where it doesn't parse."""
    parts = F.split(F.trim(text), ":")
    long = (F.size(parts) >= 5) & (F.upper(F.get(parts, F.lit(0))) == "GPS")
    at = F.when(long, F.lit(2)).when(F.size(parts) == 3, F.lit(0))
    x, y, z = (F.trim(F.get(parts, at + i)).try_cast("double") for i in range(3))
    return F.when(x.isNotNull() & y.isNotNull() & z.isNotNull(), F.struct(x.alias("x"), y.alias("y"), z.alias("z")))


def two_decimals(x: Column) -> Column:
    """A double with two decimals, rounded by its exact binary value and halves to even, as C and SQL print it (format_string rounds its shortest decimal form up)."""
    x = x.cast("double")
    v = F.abs(x)
    whole = F.floor(v)

    def hundredths(scale: int) -> Column:  # the fraction is a whole number of 2**-scale parts, so all of this is exact in long
        part = ((v - whole) * float(1 << scale)).cast("long") * 100
        cents, rest = F.shiftright(part, scale), part.bitwiseAND(F.lit((1 << scale) - 1))
        half = F.lit(1 << (scale - 1))
        return whole * 100 + cents + F.when((rest > half) | ((rest == half) & (cents % 2 == 1)), 1).otherwise(0)

    n = F.when(v < 2.0**-4, hundredths(60)).otherwise(hundredths(56))
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(v < 2.0**45, text).when(v.isNotNull(), F.format_string("%.2f", x))


def distance_text(metres: Column) -> Column:
    """Metres below 1000, kilometres with two decimals at most from there on."""
    km = F.regexp_replace(two_decimals(metres / 1000), r"\.?0+$", "")
    return F.when(metres < 1000, F.concat(F.format_string("%.0f", F.rint(metres)), F.lit(" m"))).otherwise(F.concat(km, F.lit(" km")))


def compact_number(x: Column) -> Column:
    """1.5K, 2.25M: two decimals at most."""
    def short(v: Column, unit: str) -> Column:
        return F.concat(F.regexp_replace(two_decimals(v), r"\.?0+$", ""), F.lit(unit))

    return F.when(x >= 1e6, short(x / 1e6, "M")).when(x >= 1e3, short(x / 1e3, "K")).otherwise(short(x, ""))


def poisson_cdf(k: Column, rate: Column) -> Column:
    """P(X <= k) of a Poisson variable."""
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * rate / i
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), start, step, lambda s: s["total"])


def stub(text: Column, limit: int = 2000) -> Column:
    """A long tool result as a stub with its length, after its header line where it has one."""
    header = F.regexp_extract(text, r"^#[^\n]*", 0)
    n = F.length(text).cast("string")
    short = F.when(header != "", F.concat(header, F.lit(" ["), n, F.lit(" chars compacted]"))).otherwise(F.concat(F.lit("[Tool result compacted: "), n, F.lit(" chars]")))
    return F.when(F.length(text) > limit, short).otherwise(text)


def chat_template(role: Column, text: Column, style: str = "chatml") -> Column:
    """One message in a chat format."""
    # Marks of the chat formats.
    forms = {
        "chatml": ("<|im_start|>", "\n", "<|im_end|>\n"),
        "gemma": ("<start_of_turn>", "\n", "<end_of_turn>\n"),
        "glm": ("<|", "|>\n", ""),
        "llama3": ("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"),
    }
    a, b, c = forms[style]
    return F.concat(F.lit(a), role, F.lit(b), text, F.lit(c))


def relative_date(text: Column, now: Column) -> Column:
    """Timestamp of now, today, yesterday, 'N units ago' (month: 30 days, year: 365 days), else of an ISO date."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago$", 1)
    unit = F.regexp_extract(t, r"^(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago$", 2)
    seconds = F.when(unit == "second", 1).when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400).when(unit == "week", 604800).when(unit == "month", 2592000).when(unit == "year", 31536000)
    ago = now - F.make_dt_interval(secs=(n.try_cast("long") * seconds).cast("decimal(18,6)"))
    day = F.date_trunc("day", now)
    return F.when(t == "now", now).when(t == "today", day).when(t == "yesterday", day - F.expr("INTERVAL 1 DAY")).when(unit != "", ago).otherwise(text.try_cast("timestamp"))
