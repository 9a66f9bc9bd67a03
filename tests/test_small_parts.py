"""Small parts that no registered query runs."""

import datetime as dt

from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.operators import markdown
from lorequarry.sources import readers
from lorequarry.streaming import events


def test_notification_limits(spark):
    rows = [("x", "t", "d", 0), ("x" * 2001, "t", "d", 0), ("x", "t" * 257, "d" * 4097, 0), ("x", "t", "d" * 4097, 0xFFFFFF), ("x", None, None, 0x1000000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, content string, title string, description string, colour int")
    got = [r.error for r in readers.notification_errors(df).orderBy("i").collect()]
    assert got == [None, "content longer than 2000", "title longer than 256", "description longer than 4096", "colour out of range"]


def test_tag_errors(spark):
    files = spark.createDataFrame([("a.md", "# A\n\n[def x] [def y]\n\ntext\n"), ("b.md", "# B\n\n[def z]\n\n[def z] again\n"), ("c.md", "[def ok]\n")], "path string, content string")
    got = {tuple(r) for r in markdown.tag_errors(markdown.parse(files)).collect()}
    assert got == {("a.md", "x", "several definitions"), ("b.md", "z", "defined twice")}


def test_one_line_and_chat_formats(spark):
    row = spark.createDataFrame([("a\r\nb\nc", "user")], "t string, role string")
    assert row.select(T.one_line(F.col("t"))).first()[0] == "a b c"
    forms = [row.select(T.chat_template(F.col("role"), F.lit("hi"), style)).first()[0] for style in ("chatml", "gemma", "glm", "llama3")]
    assert forms == ["<|im_start|>user\nhi<|im_end|>\n", "<start_of_turn>user\nhi<end_of_turn>\n", "<|user|>\nhi", "<|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>"]


def test_expired_sessions(spark):
    t = dt.datetime(2024, 1, 1)
    s = events.sessions(spark.createDataFrame([(1, t), (2, t + dt.timedelta(hours=5))], "key long, ts timestamp"), "1 hour")
    assert [r.key for r in events.expired(s, "2024-01-01 01:00:00").collect()] == [1]


def test_two_decimals_round_by_the_exact_value(spark):
    values = [1.125, 1.005, 2.675, 0.005, 0.015, 1.375, 0.625, 0.375, 0.0, 0.3, 0.004, 99.995, 999.999, 4.0200249, 1e12 + 0.125, -1.005, -0.125, 2.0**-9, 0.0049999]
    values += [k * 250 / 1e6 for k in range(4000, 6000)] + [k / 200 for k in range(1, 400)]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    assert [r for r in rows.select("v", T.two_decimals(F.col("v")).alias("t")).collect() if r.t != (None if r.v is None else f"{r.v:.2f}")] == []
    got = rows.limit(3).select(T.compact_number(F.col("v") * 1e6).alias("c"), T.distance_text(F.lit(2.5)).alias("d")).collect()
    assert [tuple(r) for r in got] == [("1.12M", "2 m"), (f"{1.005 * 1e6 / 1e6:.2f}".rstrip("0").rstrip(".") + "M", "2 m"), (f"{2.675 * 1e6 / 1e6:.2f}M", "2 m")]
