"""Order statistics without one task that sees everything: values by rank, exact medians, numbers in order.

A value is found by its rank: approximate percentiles a and b around the rank, then exact counts below a, at a, between, and at b.  The
rank lies at a, at b, or in the open interval, which holds a few thousandths of the rows and is looked at again.  Ties
never stay together in it, as a and b themselves are counted, not kept.  The last ``most_rows`` or fewer are counted by value and summed in order.

Nulls don't count; NaN is greater than all numbers; without values there is no result row value (null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.session import cut


def value_at(rows: DataFrame, rank: int, most_rows: int = 1_000_000, near: float = 0.002) -> float | None:
    """The value of that rank (from 1) among the doubles of column v; null values are left out."""
    inside, below, low, high = rows.where("v is not null"), 0, None, None
    while True:
        own = inside if low is None else inside.where(F.col("v") > low)
        own = own if high is None else own.where(F.col("v") < high)
        m = own.count()
        if not 0 < rank - below <= m:
            return None
        if m <= most_rows:
            counts = own.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
            so_far = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # most_rows at most
            return counts.withColumn("upto", so_far).where(F.col("upto") >= rank - below).agg(F.min("v")).first()[0]
        share = (rank - below) / m
        width = near
        while True:
            a, b = own.agg(F.percentile_approx("v", [max(0.0, share - width), min(1.0, share + width)], 10_000)).first()[0]
            v = F.col("v")
            less, at_a, between, at_b = own.agg(*[F.count_if(c) for c in (v < a, v == a, (v > a) & (v < b), (v == b) & (v > a))]).first()
            left = rank - below - less
            if 0 < left <= at_a + between + at_b:
                break
            width *= 8  # the percentiles were farther off than they promise
        if left <= at_a:
            return a
        if left > at_a + between:
            return b
        below, low, high = below + less + at_a, a, b


def exact_median(rows: DataFrame, column: str | Column, most_rows: int = 1_000_000) -> float | None:
    """The median of a column as a double; of an even number of values the mean of the two in the middle."""
    v = cut(rows.select((F.col(column) if isinstance(column, str) else column).cast("double").alias("v")).where("v is not null"))
    n = v.count()
    if not n:
        return None
    first = value_at(v, (n + 1) // 2, most_rows)
    return first if n % 2 else (first + value_at(v, n // 2 + 1, most_rows)) / 2


def median_and_mad(rows: DataFrame, column: str, most_rows: int = 1_000_000) -> DataFrame:
    """One row: exact median, and median of the absolute distances to it."""
    middle = exact_median(rows, column, most_rows)
    spread = None if middle is None else exact_median(rows, F.abs(F.col(column).cast("double") - F.lit(middle)), most_rows)
    return rows.sparkSession.createDataFrame([(middle, spread)], "median double, mad double")


def numbered(rows: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """rows with their number (from 1) in an order that has no ties: cut by ranges, sorted and counted in each, and offset by the counts before."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__many"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select("__part", F.coalesce(F.sum("__many").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + inside + 1).drop("__part", "__at", "__before")
