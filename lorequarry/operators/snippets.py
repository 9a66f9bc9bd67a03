"""Snippets of texts around query terms: windows found in turn of the terms, merged, and chosen for coverage.

Everything is column arithmetic on one row, so nothing is shuffled and each text is read once.  In each line every term has its next
occurrence once a round; the first ``most`` windows of a text in the order of lines, rounds and terms count.  Windows that touch are
merged, and regions are then taken by the number of terms that they show for the first time (ties by place), until
nothing new is shown or enough are taken.  Their ends move out to white space.

Only the first ``most`` occurrences of a term in a line, and the first ``most`` lines with any, can be among those windows; arrays stay that short.

Offsets count code points.  A null text, a text without hits and an empty list of terms give an empty array; empty terms are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.functions.text import terms_with_query

REGION = "struct<start:int,end:int,terms:array<int>>"
SOLID, BLANKS = r"(?U)^\S*", r"(?U)^\s+"  # Unicode white space


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pattern(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _occurrences(line: Column, term: str, most: int) -> Column:
    """Places of the first occurrences of a term, which do not overlap."""
    size = F.lit(len(term))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, piece: Column) -> Column:
        at = s["at"] + F.length(piece)
        return F.struct((at + size).alias("at"), F.concat(s["out"], F.array(at)).alias("out"))

    places = lambda pieces: F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step, lambda s: s["out"])
    pattern = "(?iu)" + _pattern(term)
    found = _let(F.split(line, pattern, most + 1), places)
    return F.when(line.rlike(pattern), found).otherwise(F.array().cast("array<int>"))  # most lines lack most terms


def windows(text: Column, asked: list[str], context: int, most: int) -> Column:
    """array<struct<start, end, term>>: the first windows in the order of lines, rounds and terms."""
    any_term = "(?iu)" + "|".join(map(_pattern, asked))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,line:string>>").alias("out"))

    def line_step(s: Column, line: Column) -> Column:
        more = F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), F.regexp_replace(line, r"\r\z", "").alias("line"))))
        hit = (F.size(s["out"]) < most) & line.rlike(any_term)
        return F.struct((s["at"] + F.length(line) + 1).alias("at"), F.when(hit, more).otherwise(s["out"]).alias("out"))

    lines = F.aggregate(F.when(text.rlike(any_term), F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>")), empty, line_step, lambda s: s["out"])

    def of_line(row: Column) -> Column:
        size = F.length(row["line"])

        def of_term(term: str, nth: int) -> Column:
            def window(at: Column, turn: Column) -> Column:
                lo, hi = F.greatest(F.lit(0), at - context), F.least(size, at + len(term) + context)
                return F.struct(turn.alias("turn"), F.lit(nth).alias("term"), (row["start"] + lo).alias("start"), (row["start"] + hi).alias("end"))

            return F.transform(_occurrences(row["line"], term, most), window)

        return F.slice(F.array_sort(F.concat(*[of_term(t, i) for i, t in enumerate(asked)])), 1, most)

    found = F.slice(F.flatten(F.transform(lines, of_line)), 1, most)
    return F.transform(found, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["term"].alias("term")))


def regions(found: Column) -> Column:
    """Windows that overlap or touch as one, with the terms of all."""

    def step(done: Column, w: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        own = F.struct(w["start"].alias("start"), w["end"].alias("end"), F.array(w["term"]).alias("terms")).cast(REGION)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], w["end"]).alias("end"), F.array_union(last["terms"], F.array(w["term"])).alias("terms")).cast(REGION)
        apart = F.size(done) == 0
        return F.when(apart | (w["start"] > last["end"]), F.concat(done, F.array(own))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both)))

    return F.aggregate(F.array_sort(found), F.array().cast(f"array<{REGION}>"), step)


def covering(merged: Column, budget: int) -> Column:
    """Regions in the order in which each shows the most terms not shown before; ties by place; none that shows nothing new."""
    start = F.struct(F.array().cast("array<int>").alias("shown"), F.array().cast(f"array<{REGION}>").alias("out"))

    def choose(all_: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            gains = F.transform(all_, lambda r: F.struct(F.size(F.array_except(r["terms"], s["shown"])).alias("gain"), (-r["start"]).alias("place"), r.alias("region")))

            def taken(best: Column) -> Column:
                more = F.struct(F.array_union(s["shown"], best["region"]["terms"]).alias("shown"), F.concat(s["out"], F.array(best["region"])).alias("out"))
                return F.when(F.coalesce(best["gain"] > 0, F.lit(False)), more).otherwise(s)

            return _let(F.array_max(gains), taken)

        return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(budget), F.greatest(F.size(all_), F.lit(1)))), start, step, lambda s: s["out"])

    return _let(merged, choose)


def snapped(text: Column, region: Column, base: Column) -> Column:
    """The region with its ends at white space: (start, end, snippet, terms); dots stand where the text goes on."""
    head = F.length(F.regexp_extract(F.reverse(F.left(text, region["start"] + 1)), SOLID, 0))  # solid characters up to the first one
    tail = F.length(F.regexp_extract(F.substr(text, region["end"] + 1), SOLID, 0))

    def cut(e: Column) -> Column:
        lo = F.when(e["head"] > region["start"], 0).otherwise(region["start"] - e["head"])
        span = F.substr(text, lo + 1, region["end"] + e["tail"] - lo)
        return _let(F.struct(lo.alias("lo"), F.length(span).alias("n"), F.regexp_replace(span, BLANKS, "").alias("left")), shown)

    def shown(c: Column) -> Column:
        own = F.reverse(F.regexp_replace(F.reverse(c["left"]), BLANKS, ""))
        return _let(F.struct((c["lo"] + c["n"] - F.length(c["left"])).alias("start"), own.alias("own")), final)

    def final(x: Column) -> Column:
        end = x["start"] + F.length(x["own"])
        full = F.concat(F.when(x["start"] > 0, "...").otherwise(""), x["own"], F.when(end < F.length(text), "...").otherwise(""))
        return F.struct((base + x["start"]).alias("start"), (base + end).alias("end"), full.alias("snippet"), F.size(region["terms"]).alias("terms"))

    return _let(F.struct(head.alias("head"), tail.alias("tail")), cut)


def snippets_of(text: Column, asked: list[str], base: Column | int = 0, context: int = 35, most: int = 10, desired: int = 4) -> Column:
    """array<struct<start, end, snippet, terms>> of a text for some terms; base: where the text begins in its document."""
    asked = [t for t in asked if t]
    none = F.array().cast("array<struct<start:int,end:int,snippet:string,terms:int>>")
    if not asked:
        return none
    base = (F.lit(base) if isinstance(base, int) else base).cast("int")
    chosen = covering(regions(windows(text, asked, context, most)), max(len(asked), desired))
    return F.coalesce(F.transform(chosen, lambda r: snapped(text, r, base)), none)


def snippets(texts: DataFrame, query: DataFrame, **how) -> DataFrame:
    """(id, text) and a one-row query table -> (id, nth, start, end, snippet, terms): what is shown of each text, from 1.

    Looked for are the whole trimmed query and its terms.
    """
    asked = query.select(F.array_distinct(terms_with_query(F.col("query"))).alias("t")).first()["t"]  # the terms of one query
    found = texts.select("id", snippets_of(F.col("text"), asked, **how).alias("s"))
    shown = found.select("id", F.posexplode_outer("s").alias("nth", "s")).where("nth is not null")  # a filter before the explosion would compute s again
    return shown.select("id", (F.col("nth") + 1).alias("nth"), "s.*")


def snippet_lines(shown: Column) -> Column:
    """One line for each snippet of a text: the snippet in quotes and its offsets."""
    return F.array_join(F.transform(shown, lambda s: F.concat(F.lit("      '"), s["snippet"], F.lit("':"), s["start"].cast("string"), F.lit(","), s["end"].cast("string"))), "\n")
