"""Tabular parts of the control plane: dependency order, typed arguments, attachments, exact arithmetic."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable
from decimal import Decimal, DivisionByZero, InvalidOperation, localcontext
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.session import cut


def loadable(plugins: DataFrame, edges: DataFrame) -> DataFrame:
    """(plugin): those whose hard dependencies are all loadable; edges (plugin, depends_on, kind hard or optional)."""
    hard = edges.where("kind = 'hard'").select("plugin", "depends_on")
    left, n = plugins.select("plugin"), -1
    while (m := left.count()) != n:
        missing = hard.join(left.select(F.col("plugin").alias("depends_on")), "depends_on", "left_anti").select("plugin")
        left, n = cut(left.join(missing, "plugin", "left_anti")), m
    return left


def dependency_levels(plugins: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """(plugin, level): every plugin comes after what it depends on; raises ValueError for a cycle.

    A level is a join over the edges, so the number of jobs is the depth of the graph, not its size.
    """
    known = loadable(plugins, edges)
    inside = edges.join(known, "plugin", "left_semi").join(known.select(F.col("plugin").alias("depends_on")), "depends_on", "left_semi").select("plugin", "depends_on")
    levels, seen = known.withColumn("level", F.lit(0)), None
    for _ in range(most):
        below = inside.join(levels.select(F.col("plugin").alias("depends_on"), "level"), "depends_on").groupBy("plugin").agg((F.max("level") + 1).alias("up"))
        levels = cut(levels.join(below, "plugin", "left").select("plugin", F.coalesce("up", F.lit(0)).alias("level")))
        total = levels.agg(F.sum("level")).first()[0]
        if total == seen:
            return levels
        seen = total
    raise ValueError("the dependencies form a cycle")


def coerced(value: Column, kind: str, choices: tuple[str, ...] = ()) -> Column:
    """A text argument as string, int, number, bool, enum or array (a JSON array of strings); null where it doesn't fit."""
    v = F.trim(value)
    if kind == "int":
        return v.try_cast("long")
    if kind == "number":
        return v.try_cast("double")
    if kind == "bool":
        return F.when(F.lower(v).isin("true", "false"), F.lower(v) == "true")
    if kind == "enum":
        return F.when(F.lower(v).isin(*[c.lower() for c in choices]), F.lower(v))
    if kind == "array":
        return F.when(v.startswith("["), F.from_json(v, "array<string>"))
    return value


def attachment_errors(name: Column, content: Column, most_name: int = 64, most_content: int = 65_536) -> Column:
    """Why an attachment is refused; null where it is taken."""
    return (
        F.when(name.isNull() | ~name.rlike(r"\A[A-Za-z0-9._\-]+\z"), "name")
        .when(F.length(name) > most_name, "name length")
        .when(F.coalesce(F.length(content), F.lit(0)) > most_content, "content length")
    )


def publishable(path: Column) -> Column:
    """Whether a relative path may be published: a Markdown file that stays inside the root."""
    steps = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    depth = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")),
        lambda s, x: F.struct(
            (s["at"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("at"),
            (s["ok"] & (s["at"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1) >= 0)).alias("ok"),
        ),
        lambda s: s["ok"],
    )
    return F.coalesce(F.lower(path).endswith(".md") & ~path.rlike(r"\A(?:[/\\]|[A-Za-z]:)") & depth, F.lit(False))


NUMBER = re.compile(r"(?<![\w.])(?:[0-9]+\.[0-9]*|0+|[1-9][0-9]*)(?![\w.])")  # plain ones; what else there is stays in the shape and is parsed with it
SHAPES = 1000  # parsed shapes that a worker keeps


@lru_cache(SHAPES)
def _shape(text: str, numbers: int) -> Callable[[list[Decimal]], Decimal] | None:
    """An expression whose plain numbers were replaced by n as a function of these numbers, in order; null where it is none or holds another count of them."""
    operators = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow}
    places: list[tuple[int, int]] = []

    def made(n: ast.AST) -> Callable[[list[Decimal]], Decimal]:
        if isinstance(n, ast.Expression):
            return made(n.body)
        if isinstance(n, ast.Name) and n.id == "n":
            places.append((n.lineno, n.col_offset))
            i = len(places) - 1
            return lambda v: v[i]
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            x = Decimal(ast.get_source_segment(text, n))
            return lambda v: x
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.UAdd | ast.USub):
            a = made(n.operand)
            return a if isinstance(n.op, ast.UAdd) else lambda v: -a(v)
        if isinstance(n, ast.BinOp) and type(n.op) in operators:
            a, b, f = made(n.left), made(n.right), operators[type(n.op)]
            return lambda v: f(a(v), b(v))
        raise ValueError

    try:
        out = made(ast.parse(text, mode="eval"))
    except (ValueError, SyntaxError, RecursionError, MemoryError, ArithmeticError):
        return None
    return out if len(places) == numbers and places == sorted(places) else None


def _exact(expression: str | None, digits: int) -> str | None:
    """The value of an expression of numbers, + - * / % ** and brackets; null where it is none, too long or undefined.

    Expressions that differ in their numbers only are parsed once.
    """
    if expression is None or len(expression) > 2000:
        return None
    text = expression.strip()
    numbers = NUMBER.findall(text) if text.isascii() and "n" not in text else []
    shape = _shape(NUMBER.sub("n", text), len(numbers)) if numbers else None
    if shape is None:  # a text of another kind, for example with a remark, is taken as it stands
        numbers = []
        shape = _shape(text, 0)
    if shape is None:
        return None
    try:
        with localcontext() as c:
            c.prec = digits
            out = shape([Decimal(x) for x in numbers])
            return format(out.normalize(), "f") if out.is_finite() and abs(out.adjusted()) < 1000 else None
    except (ValueError, RecursionError, MemoryError, DivisionByZero, InvalidOperation, ArithmeticError):
        return None


def evaluated(expression: Column, digits: int = 64) -> Column:
    """Exact decimal arithmetic on text, to so many digits; units and symbols are not covered and give null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda e: _exact(e, digits))

    return run(expression)
