"""Markdown documents as node tables, references between them, and chunks with context and identity.

``parse`` turns (path, content) into nodes: path, node_id, parent_id, depth, type, level, start, end, text, language and
ancestors (array of node ids, the document first).  Offsets count code points.  Everything after the parser is
DataFrame work on that table; walks up the tree use the ancestors column, so nothing recurses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODES = "path string, node_id int, parent_id int, depth int, type string, level int, start int, end int, text string, language string, ancestors array<int>"
ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}[c.split()[1]]) for c in NODES.split(", ")])
SLICE_NODES, SLICE_CHARS = 2000, 1_000_000  # what a parser holds before it hands it on
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
BREAK = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
QUOTE = re.compile(r"^ {0,3}>( ?)(.*)$")
ITEM = re.compile(r"^( *)([-*+]|\d{1,9}[.)])[ \t]+(.*)$")
OPENING = frozenset("`~>-*_#+")  # what is not a plain line begins with one of these or a digit, after blanks


def _kind(line: str) -> str:
    """What a line opens."""
    first = line.lstrip(" ")[:1]
    if first and first not in OPENING and not first.isspace() and not first.isdecimal():
        return "text"
    for name, pattern in (("fence", FENCE), ("quote", QUOTE), ("break", BREAK), ("heading", HEADING)):
        if pattern.match(line):
            return name
    return "blank" if not line.strip() else "item" if ITEM.match(line) else "text"


def _indent(line: str) -> int:
    """Columns before the first other character; tabs go to the next multiple of four."""
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def blocks(content: str) -> Iterator[tuple[str, int, int, int, str, str | None]]:
    """(type, level, start, end, text, language) of the blocks of a document, in order; list items carry their list's type as language."""
    rows, at = [], 0
    for line in content.split("\n"):
        rows.append((at, line.rstrip("\r")))
        at += len(line) + 1
    i, n = 0, len(rows)
    end = lambda k: rows[k][0] + len(rows[k][1])
    while i < n:
        start, line = rows[i]
        kind, j = _kind(line), i + 1
        if kind == "fence":
            mark, info = FENCE.match(line).groups()
            closing = None
            while j < n and closing is None:
                m = FENCE.match(rows[j][1])
                closing = j if m and len(m[1]) >= len(mark) and not m[2].strip() else None
                j += 1
            yield "CodeBlock", 0, start, end(j - 1), "\n".join(r for _, r in rows[i + 1 : j - 1]), (info.split() or [None])[0]
        elif kind == "quote":
            while j < n and QUOTE.match(rows[j][1]):
                j += 1
            yield "Blockquote", 0, start, end(j - 1), "\n".join(QUOTE.match(r)[2] for _, r in rows[i:j]), None
        elif kind == "break":
            yield "ThematicBreak", 0, start, end(i), "", None
        elif kind == "heading":
            marks, text = HEADING.match(line).groups()
            yield "Heading", len(marks), start, end(i), re.sub(r"(?:^|[ \t]+)#+$", "", text or "").strip(), None
        elif kind == "item":
            lead, mark, text = ITEM.match(line).groups()
            width, own = len(lead) + len(mark) + 1, [text]
            while j < n and _kind(rows[j][1]) in ("text", "item") and _indent(rows[j][1]) >= width:
                own.append(rows[j][1].strip())
                j += 1
            yield "ListItem", 0, start, end(j - 1), "\n".join(own), "ordered" if mark[0].isdigit() else "bullet"
        elif kind == "text":
            while j < n and _kind(rows[j][1]) == "text":
                j += 1
            yield "Paragraph", 0, start, end(j - 1), "\n".join(r.strip() for _, r in rows[i:j]), None
        i = j


def _tree(path: str, content: str) -> list[list]:
    """Node rows of one document: headings nest by level, runs of items of one type form a list."""
    nodes = [[path, 0, None, 0, "Document", 0, 0, len(content), "", None, []]]

    def add(parent: list, kind: str, level: int, start: int, end: int, text: str, language: str | None) -> list:
        nodes.append([path, len(nodes), parent[1], parent[3] + 1, kind, level, start, end, text, language, [*parent[10], parent[1]]])
        return nodes[-1]

    stack, run = [nodes[0]], None
    for kind, level, start, end, text, language in blocks(content):
        if kind == "Heading":
            while stack[-1][5] >= level:
                stack.pop()
            stack.append(add(stack[-1], kind, level, start, end, text, None))
            run = None
        elif kind == "ListItem":
            if run is None or run[9] != language:
                run = add(stack[-1], "List", 0, start, end, "", language)
            add(run, kind, 0, start, end, text, None)
        else:
            run = None
            add(stack[-1], kind, level, start, end, text, language)
    last: dict[int, list] = {}
    for x in nodes[1:]:
        last[x[2]] = x
    for x in reversed(nodes):  # a parent ends where its last child ends
        if x[1] in last:
            x[7] = last[x[1]][7]
    return nodes


def node_batches(documents: Iterator[tuple[str, str | None]], most: int = SLICE_NODES) -> Iterator[pa.RecordBatch]:
    """Nodes of (path, content) in batches that are handed on at ``most`` nodes or SLICE_CHARS characters, and at the end of a document."""
    rows, size = [], 0
    for path, content in documents:
        rows += _tree(path, content or "")
        size += len(content or "")
        if len(rows) >= most or size >= SLICE_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def parse(files: DataFrame) -> DataFrame:
    """(path, content) -> nodes; a task holds the nodes of some documents at a time, whatever the number of rows in a batch."""

    def run(batches):
        yield from node_batches((p.as_py(), c.as_py()) for b in batches for p, c in zip(b.column(0), b.column(1), strict=True))

    return files.select("path", "content").mapInArrow(run, NODES)


def tags(nodes: DataFrame, tag: str) -> DataFrame:
    """(path, node_id, value) of [tag value] marks in node texts, each once."""
    found = F.regexp_extract_all(F.col("text"), F.lit(r"\[" + tag + r"\s+([^\]]*)(?:\]|$)"), F.lit(1))
    return nodes.select("path", "node_id", F.explode(F.array_distinct(F.transform(found, lambda x: F.trim(x)))).alias("value"))


def tag_errors(nodes: DataFrame) -> DataFrame:
    """(path, value, error): nodes with several definitions, and definitions that a document holds twice."""
    d = tags(nodes, "def")
    several = d.groupBy("path", "node_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value")).where("n > 1")
    twice = d.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return several.select("path", "value", F.lit("several definitions").alias("error")).unionByName(twice.select("path", "value", F.lit("defined twice").alias("error")))


def parse_reference(text: Column) -> Column:
    """struct(kind, path, definition, start, end) of a reference; null where the text is blank.

    What follows the last colon is offsets if it holds two 32-bit numbers; else what follows the last @ is a definition
    if something stands on both sides; else a slash at the end makes a directory, which keeps it, and a dot inside the last segment a file.
    """
    t = text
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("int")
    after = F.substring_index(t, ":", -1)
    comma = F.instr(after, ",")
    first, second = F.left(after, comma - 1).try_cast("int"), F.substr(after, comma + 1).try_cast("int")
    before = F.left(t, F.length(t) - F.length(after) - 1)
    name = F.substring_index(t, "@", -1)
    owner = F.left(t, F.length(t) - F.length(name) - 1)

    def made(kind: str, path: Column, definition: Column = none, start: Column = empty, end: Column = empty) -> Column:
        return F.struct(F.lit(kind).alias("kind"), path.alias("path"), definition.alias("definition"), start.alias("start"), end.alias("end"))

    return (
        F.when(t.isNull() | ~t.rlike(r"\S"), None)
        .when(F.contains(t, F.lit(":")) & (comma > 0) & first.isNotNull() & second.isNotNull(), made("Offsets", before, none, first, second))
        .when(F.contains(t, F.lit("@")) & (owner != "") & (name != ""), made("Definition", owner, name))
        .when(t.rlike(r"[/\\]\z"), made("Directory", t))
        .when(t.rlike(r"(?s)(?:\A|[/\\])[^/\\]+\.[^/\\.]+\z"), made("File", t))
        .otherwise(made("Directory", t))
    )


def reference_file(reference: Column) -> Column:
    """The document of a parsed reference; a directory has none and gives null."""
    return F.when(reference["kind"] != "Directory", reference["path"])


def reference_directory(reference: Column) -> Column:
    """The directory of a parsed reference, with its slash: itself, or the folder of its document (empty at the top)."""
    path = reference["path"]
    return F.when(reference["kind"] == "Directory", path).otherwise(F.regexp_extract(path, r"(?s)^(.*[/\\])", 1))


def unresolved_local(deps: DataFrame, definitions: DataFrame) -> DataFrame:
    """(path, ref) with refs of the form @name -> those whose document (path, value) does not define the name; other refs are left alone."""
    local = deps.where(F.col("ref").startswith("@")).withColumn("value", F.substr("ref", F.lit(2)))
    return local.join(definitions.select("path", "value"), ["path", "value"], "left_anti").select("path", "ref")


def broken_references(deps: DataFrame, files: DataFrame, definitions: DataFrame) -> DataFrame:
    """(path, ref) -> those whose target is missing.  files (path), definitions (path, value).

    A file or offset reference needs its document, a definition also the definition, a directory any document below it.
    """
    r = deps.select("path", "ref", parse_reference(F.col("ref")).alias("r")).select("path", "ref", F.col("r.kind").alias("kind"), F.lower("r.path").alias("to"), F.col("r.definition").alias("definition"))
    known = files.select(F.lower("path").alias("p"))
    folders = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("p", "/"))), lambda i: F.array_join(F.slice(F.split("p", "/"), 1, i), "/"))).alias("p")).distinct()
    by_file = r.where("kind IN ('File', 'Offsets')").join(known, F.col("to") == F.col("p"), "left_anti")
    by_name = r.where("kind = 'Definition'").join(definitions.select(F.lower("path").alias("p"), "value"), (F.col("to") == F.col("p")) & (F.col("definition") == F.col("value")), "left_anti")
    by_folder = r.where("kind = 'Directory'").join(folders, F.rtrim(F.col("to"), F.lit("/\\")) == F.col("p"), "left_anti")
    return by_file.unionByName(by_name).unionByName(by_folder).select("path", "ref")


def chunks(nodes: DataFrame, most: int = 1000) -> DataFrame:
    """(path, node_id, chunk, start, at, raw, chunk_text, hash) of paragraphs, code, items and quotes with text.

    The nodes are read several times; keep them (``session.kept``) where they are parsed on the way.

    A prefix names the document, the headings above, the offsets, the definitions and dependencies of the node and of
    those above it, the tree and the kind; it is left out where it takes half the room.  A text
    that fits stays whole; a longer one is split at newlines, what follows the last newline at sentence ends too (code
    at newlines only), and pieces that are still too long at the limit.  at: where a piece begins inside the node's text.
    """
    body = nodes.where(F.col("type").isin("Paragraph", "CodeBlock", "ListItem", "Blockquote") & (F.trim("text") != ""))
    above = body.select("path", "node_id", F.posexplode(F.concat(F.array("node_id"), F.reverse("ancestors"))).alias("up", "h"))  # the node first, the document last
    heads = nodes.where("type = 'Heading' AND trim(text) <> ''").select("path", F.col("node_id").alias("h"), F.col("text").alias("x"), "level")
    marks = tags(nodes, "def").select("path", F.col("node_id").alias("h"), F.lit("definitions").alias("kind"), F.col("value").alias("x"), F.lit(0).alias("level"))
    marks = marks.unionByName(tags(nodes, "dependsOn").select("path", F.col("node_id").alias("h"), F.lit("dependencies").alias("kind"), F.col("value").alias("x"), F.lit(0).alias("level")))
    near = above.join(heads.select("path", "h", F.lit("headings").alias("kind"), "x", "level").unionByName(marks), ["path", "h"])
    listed = lambda kind, order: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct((order * F.col("up")).alias("up"), "x", "level")))), lambda v: v)
    near = near.groupBy("path", "node_id").agg(listed("headings", -1).alias("headings"), listed("definitions", 1).alias("definitions"), listed("dependencies", 1).alias("dependencies"))
    own = body.join(near, ["path", "node_id"], "left")
    names = lambda c: F.array_distinct(F.transform(c, lambda v: v["x"]))
    tree = F.array_join(F.transform("headings", lambda v: v["x"]), " > ")

    def line(label: str, value: Column, when: Column) -> Column:
        return F.when(when, F.concat(F.lit(f"[{label}"), value, F.lit("]\n"))).otherwise("")

    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    language = F.when(F.coalesce("language", F.lit("")) == "", "code").otherwise(F.col("language"))
    prefix = F.concat(
        line("Document: ", F.col("path"), F.col("path") != ""),
        line("Headings: ", tree, some("headings")),
        line("Offsets: ", F.concat(F.col("start").cast("string"), F.lit(", "), F.col("end").cast("string")), F.lit(True)),
        line("Definitions: ", F.array_join(names("definitions"), ", "), some("definitions")),
        line("Dependencies: ", F.array_join(names("dependencies"), ", "), some("dependencies")),
        line("Document Tree: ", tree, some("headings")),
        line("Code Block (", F.concat(language, F.lit(")")), F.col("type") == "CodeBlock"),
        line("List Item", F.lit(""), F.col("type") == "ListItem"),
        line("Quote", F.lit(""), F.col("type") == "Blockquote"),
        F.lit("\n"),
    )
    own = own.withColumn("prefix", F.when(F.length(prefix) < most / 2, prefix).otherwise(""))
    room = F.greatest(F.lit(50), F.lit(most) - F.length("prefix"))
    line_cut = F.split("text", r"(?<=\n)", -1)
    tail = F.element_at(line_cut, -1)
    parts = F.when(F.length("text") <= room, F.array("text")).when(F.col("type") == "CodeBlock", line_cut).otherwise(F.concat(F.slice(line_cut, 1, F.size(line_cut) - 1), F.split(tail, r"(?<=[.!?] )", -1)))
    hard = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p) / room).cast("int") - 1, F.lit(0))), lambda i: F.substr(p, i * room + 1, room))))
    placed = F.transform("pieces", lambda p, i: F.struct(F.aggregate(F.slice("pieces", 1, i), F.lit(0), lambda n, q: n + F.length(q)).alias("at"), p.alias("raw")))
    # the path, the headings and code kinds from the document down, both places, and the text with its prefix
    shape = F.concat(F.array_join(F.transform(F.coalesce("headings", F.array().cast("array<struct<up:int,x:string,level:int>>")), lambda v: F.concat(F.lit("#"), v["level"].cast("string"), F.lit(" "), v["x"], F.lit("\n"))), ""), F.when(F.col("type") == "CodeBlock", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("```\n"))).otherwise(""))
    each = own.withColumn("pieces", hard).select("path", "node_id", "start", shape.alias("shape"), "prefix", F.posexplode(F.filter(placed, lambda p: F.trim(p["raw"]) != "")).alias("chunk", "piece"))
    each = each.select("path", "node_id", "start", "shape", "chunk", "piece.*", F.concat("prefix", "piece.raw").alias("chunk_text"))
    begin = F.col("start") + F.col("at")
    identity = F.concat("path", F.lit("\n"), "shape", F.col("at").cast("string"), F.lit(" \n"), begin.cast("string"), (begin + F.length("raw")).cast("string"), F.lit("\n"), "chunk_text")
    return each.select("path", "node_id", "chunk", "start", "at", "raw", "chunk_text", F.upper(F.sha2(identity, 256)).alias("hash"))


def sync(current: DataFrame, tracked: DataFrame) -> DataFrame:
    """(hash, action): chunks to add and to delete, by the difference of hashes."""
    both = current.select("hash", F.lit(1).alias("now")).distinct().join(tracked.select("hash", F.lit(1).alias("was")).distinct(), "hash", "full_outer")
    return both.where("now IS NULL OR was IS NULL").select("hash", F.when(F.col("was").isNull(), "add").otherwise("delete").alias("action"))


def fetch(files: DataFrame, nodes: DataFrame, refs: DataFrame, most: int = 8192) -> DataFrame:
    """(ref, text): content of file, offset and definition references, cut; a definition falls back to a heading of that text."""
    r = refs.select("ref", parse_reference(F.col("ref")).alias("r")).select("ref", "r.*")
    whole = r.where("kind IN ('File', 'Offsets')").join(files, "path")
    whole = whole.select("ref", F.when(F.col("kind") == "File", F.col("content")).otherwise(F.substr("content", F.col("start") + 1, F.col("end") - F.col("start"))).alias("text"))
    d = tags(nodes, "def").withColumnRenamed("value", "definition").withColumn("order", F.lit(0))
    h = nodes.where("type = 'Heading'").select("path", "node_id", F.trim("text").alias("definition"), F.lit(1).alias("order"))
    first = Window.partitionBy("ref").orderBy("order", "node_id")
    named = r.where("kind = 'Definition'").select("ref", "path", "definition").join(d.unionByName(h), ["path", "definition"]).withColumn("n", F.row_number().over(first)).where("n = 1")
    named = named.join(nodes.select("path", "node_id", F.col("start").alias("s"), F.col("end").alias("e")), ["path", "node_id"]).join(files, "path").select("ref", F.substr("content", F.col("s") + 1, F.col("e") - F.col("s")).alias("text"))
    return whole.unionByName(named).select("ref", F.left("text", F.lit(most)).alias("text"))
