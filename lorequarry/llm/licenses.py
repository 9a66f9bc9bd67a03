"""License scans by diagonal voting.

1. Every task hashes the rolling word grams of its texts: those of two words for phrases, of four for notices.
2. Spark joins them to the template positions with the same hash (the templates are a fixed list, so they are broadcast), and sums the
   votes of each diagonal: the place in the text less the place in the template.
3. Neighbouring diagonals, which inserted or missing words part, are merged up to ``slack`` words apart; a phrase takes none.
4. The spans meet their text again, and the words of each voted stretch are compared with the template's; what agrees, as a share of the
   template, is the span's share.

Words are runs of a-z, 0-9 and of bytes beyond ASCII, after lower-casing A-Z.

Defined cases: a null text counts as empty and has no words; rows are looked at one by one and come back one by one, so repeated rows have
equal results; rows with a null doc_id are scanned too; an empty table gives no rows; other columns pass through, but columns called
n_words or spans are replaced.  doc_id must be a number or its text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequarry.llm.durable import durable, small_side
from lorequarry.llm.textbytes import LOWER, MARKS, mix, prefix_sums, slices, substring_hash, words

PHRASE_GRAM, NOTICE_GRAM = 2, 4
SPANS = "array<struct<template:int,label:string,phrase:boolean,votes:long,start:long,end:long,share:double>>"

# The phrases that always count, and the notices of well-known licenses, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
]


@dataclass(frozen=True)
class Template:
    """A text to look for; slack: how many words apart diagonals of one span may be."""

    text: str
    label: str
    gram: int
    slack: int

    @property
    def words(self) -> list[str]:
        return self.text.split()


TEMPLATES = [Template(t, x, PHRASE_GRAM, 0) for t, x in PHRASES] + [Template(t, x, NOTICE_GRAM, 3) for t, x in NOTICES]


def word_grams(data: np.ndarray, offsets: np.ndarray, k: int):
    """(text, first word, hash) of the rolling grams of k words, and the cuts of the texts' words; data is lower-case."""
    start, end, cut = words(data, offsets, MARKS)
    h = substring_hash(prefix_sums(data), start, end)
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    if len(h) < k:
        return owner[:0], owner[:0], h[:0]
    whole = np.flatnonzero(owner[: len(h) - k + 1] == owner[k - 1 :])
    with np.errstate(over="ignore"):
        weights = mix(np.arange(1, k + 1, dtype=np.uint64), k) | np.uint64(1)
        rolled = h[whole] * weights[0]
        for j in range(1, k):
            rolled = rolled + h[whole + j] * weights[j]
    return owner[whole], whole - cut[owner[whole]], mix(rolled, k)


def template_positions(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(gram, template, tpos, k): where each gram stands in the templates."""
    rows = []
    for i, t in enumerate(templates):
        if len(t.words) < t.gram:
            raise ValueError("a template is at least as long as its grams")
        data = np.frombuffer(t.text.encode(), np.uint8)
        _, place, h = word_grams(data, np.array([0, len(data)]), t.gram)
        rows += [(g, i, p, t.gram) for g, p in zip(h.view(np.int64).tolist(), place.tolist(), strict=True)]
    return spark.createDataFrame(rows, "gram long, template int, tpos int, k int")


def rolling_grams(rows: DataFrame, grams: list[int]) -> DataFrame:
    """(doc_id, tag, text) -> (doc_id, tag, pos, gram): the hashes of all word grams of these lengths."""

    def find(batches):
        for batch in batches:
            for first, data, offsets in slices(batch.column(2)):
                data = LOWER[data]
                for k in grams:
                    owner, place, h = word_grams(data, offsets, k)
                    at = pa.array(first + owner)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], names=["doc_id", "tag", "pos", "gram"])

    return rows.mapInArrow(find, "doc_id long, tag long, pos int, gram long")


def voted_spans(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """(doc_id, tag, text) -> (doc_id, tag, found): for each text the spans of its merged diagonals, each with its voted stretches."""
    spark = rows.sparkSession
    known = F.broadcast(template_positions(spark, templates))  # some hundred rows, whatever the corpus
    hits = rolling_grams(rows, sorted({t.gram for t in templates})).join(known, "gram")
    diagonal = (F.col("pos") - F.col("tpos")).alias("diagonal")
    key = ["doc_id", "tag", "template"]
    # equal rows vote alike, so minima and maxima are those of one of them
    votes = hits.groupBy(*key, diagonal).agg(F.min("tpos").alias("lo"), F.max(F.col("tpos") + F.col("k")).alias("hi"), F.count_distinct("tpos").alias("votes"))
    slack = F.get(F.array(*[F.lit(t.slack) for t in templates]), F.col("template"))
    along = Window.partitionBy(*key).orderBy("diagonal")  # the diagonals of one template in one text
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > slack).cast("int"), F.lit(1))
    marked = votes.withColumn("__new", new).withColumn("__span", F.sum("__new").over(along))
    spans = marked.groupBy(*key, "__span").agg(F.sum("votes").alias("votes"), F.sort_array(F.collect_list(F.struct("diagonal", "lo", "hi"))).alias("stretches"))
    return spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("template", "votes", "stretches")).alias("found"))


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """docs with n_words and spans: (template, label, phrase, votes, start, end, share) of what agrees with a template, in order; start and end in words."""
    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "spans")]
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), "text")
    found = durable(voted_spans(rows, templates), "spans").withColumnsRenamed({"doc_id": "__doc", "tag": "__tag", "found": "__found"})
    own = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (tag == F.col("__tag"))
    joined = own.join(small_side(found), same, "left").drop("__doc", "__tag")
    at_text = [f.name for f in kept].index("text")
    asked = [[w.encode() for w in t.words] for t in templates]

    def verify(batches):
        for batch in batches:
            n_words, spans = [], []
            candidates = batch.column(len(kept)).to_pylist()
            for first, data, offsets in slices(batch.column(at_text)):
                data = LOWER[data]
                start, end, cut = words(data, offsets, MARKS)
                n_words.append(np.diff(cut))
                for o in range(len(offsets) - 1):
                    begin = cut[o]
                    out = []
                    for item in candidates[first + o] or ():
                        template = asked[item["template"]]
                        agreed: dict[int, int] = {}  # place in the template -> place in the text
                        for s in item["stretches"]:
                            for j in range(s["lo"], s["hi"]):
                                i = begin + s["diagonal"] + j
                                if data[start[i] : end[i]].tobytes() == template[j]:
                                    agreed.setdefault(j, s["diagonal"] + j)
                        if agreed:
                            t = templates[item["template"]]
                            places = agreed.values()
                            out.append({"template": item["template"], "label": t.label, "phrase": t.gram == PHRASE_GRAM, "votes": item["votes"], "start": min(places), "end": max(places) + 1, "share": len(agreed) / len(template)})
                    spans.append(sorted(out, key=lambda s: (s["start"], s["template"])))
            names = [f.name for f in kept]
            counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(counts, pa.int64()), pa.array(spans, span_type)], names=[*names, "n_words", "spans"])

    span_type = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("phrase", pa.bool_()), ("votes", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("spans", T._parse_datatype_string(SPANS))])
    return joined.mapInArrow(verify, schema)


def places(spans: Column) -> Column:
    """The spans that hold a whole phrase."""
    return F.filter(spans, lambda s: s["phrase"] & (s["share"] == 1.0))


def label_list(spans: Column) -> Column:
    """The distinct labels of spans, sorted and joined by commas; empty where there are none."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def license_report(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """scan_licenses with n_base, first_word, last_word, base_labels, labels (those of phrases, and of notices of which at least
    that share agrees) and score, the largest share."""
    scanned = scan_licenses(docs)
    base = places(F.col("spans"))
    sure = F.filter("spans", lambda s: s["share"] >= F.when(s["phrase"], F.lit(1.0)).otherwise(F.lit(least)))
    starts = F.transform(base, lambda s: s["start"])
    return scanned.select(
        "*",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        label_list(base).alias("base_labels"),
        label_list(sure).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
