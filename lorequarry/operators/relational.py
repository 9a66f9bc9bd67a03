"""Filtered aggregates, nearest and largest groups over a parent table (sites) and its measures (deposits).

sites: site_id, instance, x, y, z, mined.  deposits: site_id, kind, volume, estimated.
Every function is one plan: filter, group, having, distance, top-k; breakdowns are joined once for all result rows.
Ties go to the smaller site_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.operators.selection import numbered

def open_deposits(sites: DataFrame, deposits: DataFrame, instance: str | None = None, kind: str | None = None) -> DataFrame:
    """Measured (not estimated) deposits of sites that aren't mined yet, by lower-cased instance and kind."""
    s = sites.where(~F.col("mined"))
    d = deposits.where(~F.col("estimated"))
    if instance is not None:
        s = s.where(F.lower("instance") == instance.lower())
    if kind is not None:
        d = d.where(F.lower("kind") == kind.lower())
    return d.join(s, "site_id")


def squared_distance(x: float, y: float, z: float) -> Column:
    return (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + (F.col("z") - z) * (F.col("z") - z)


def within(sites: DataFrame, x: float, y: float, z: float, km: float) -> DataFrame:
    """Sites no farther than the radius; the border belongs to it."""
    return sites.where(squared_distance(x, y, z) <= F.lit((km * 1000.0) ** 2))


def totals_by_site(open_: DataFrame, minimum: float | None = None) -> DataFrame:
    """(site_id, x, y, z, total, largest); with a minimum only totals strictly above it."""
    t = open_.groupBy("site_id", "x", "y", "z").agg(F.sum("volume").alias("total"), F.max("volume").alias("largest"))
    return t if minimum is None else t.where(F.col("total") > minimum)


def summary(open_: DataFrame) -> DataFrame:
    """One row: number of deposits, largest single one (0.0 without any), richest site (null without any) and its sum."""
    whole = open_.agg(F.count(F.lit(1)).alias("deposits"), F.coalesce(F.max("volume"), F.lit(0.0)).alias("largest"))
    top = totals_by_site(open_).agg(F.max_by("site_id", F.struct("total", -F.col("site_id"))).alias("richest"), F.coalesce(F.max("total"), F.lit(0.0)).alias("richest_total"))
    return whole.crossJoin(top)  # one row each


def site_totals(open_: DataFrame, minimum: float) -> DataFrame:
    """One row: how many sites lie strictly above the minimum, their combined volume, the richest and its total."""
    t = totals_by_site(open_, minimum)
    return t.agg(F.count(F.lit(1)).alias("sites"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("combined"), F.max_by("site_id", F.struct("total", -F.col("site_id"))).alias("richest"), F.coalesce(F.max("total"), F.lit(0.0)).alias("richest_total"))


def nearest(open_: DataFrame, x: float, y: float, z: float, minimum: float, k: int = 5) -> DataFrame:
    """The k (1 to 25) closest sites whose total is strictly above the minimum."""
    t = totals_by_site(open_, minimum).withColumn("d2", squared_distance(x, y, z))
    return t.orderBy("d2", "site_id").limit(max(1, min(25, k))).withColumn("distance", F.sqrt("d2")).drop("d2")


def largest(open_: DataFrame, origin: tuple[float, float, float] | None = None, km: float | None = None, k: int = 1) -> DataFrame:
    """The k (1 to 25) sites of largest total, within a radius of the origin if both are given; k = 1 needs a total above 0."""
    if origin is not None and km is not None:
        open_ = within(open_, *origin, km)
    t = totals_by_site(open_, 0.0 if k == 1 else None)
    t = t.withColumn("distance", F.sqrt(squared_distance(*origin)) if origin is not None else F.lit(0.0))
    return t.orderBy(F.desc("total"), "site_id").limit(max(1, min(25, k)))


def breakdown(sites: DataFrame, deposits: DataFrame) -> DataFrame:
    """(site_id, kinds): volumes by kind, largest first, of all kinds but without estimates, as a nested list."""
    d = deposits.where(~F.col("estimated")).join(sites.select("site_id"), "site_id")
    by_kind = d.groupBy("site_id", "kind").agg(F.sum("volume").alias("volume"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("volume")).alias("minus"), F.col("kind").alias("kind"))))
    return by_kind.groupBy("site_id").agg(F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), (-s["minus"]).alias("volume"))).alias("kinds"))


def claim_best(sites: DataFrame, best: DataFrame) -> DataFrame:
    """The sites with those of ``best`` marked as mined: the next snapshot after a claim (one writer at a time)."""
    hit = best.select(F.col("site_id").alias("__hit"))
    return sites.join(hit, F.col("site_id") == F.col("__hit"), "left").withColumn("mined", F.col("mined") | F.col("__hit").isNotNull()).drop("__hit")


def pop_site(sites: DataFrame, deposits: DataFrame, instance: str, kind: str, x: float, y: float, z: float, minimum: float, mode: str = "sum") -> tuple[DataFrame, DataFrame]:
    """(the closest site above the minimum, the sites afterwards).  mode deposit measures the largest single deposit."""
    measure = "largest" if mode == "deposit" else "total"
    t = totals_by_site(open_deposits(sites, deposits, instance, kind)).where(F.col(measure) > minimum)
    best = t.withColumn("d2", squared_distance(x, y, z)).orderBy("d2", "site_id").limit(1)
    return best, claim_best(sites, best)


def ids_for(names: DataFrame, known: DataFrame) -> DataFrame:
    """known (id, name) plus new ids for names it lacks (get-or-create), after the largest id, in the order of names; a null name gets none."""
    new = names.select("name").where("name is not null").distinct().join(known.select("name"), "name", "left_anti")
    base = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))
    counted = numbered(new, "name").crossJoin(F.broadcast(base))  # base: one row
    return known.select("id", "name").unionByName(counted.select((F.col("base") + F.col("n")).alias("id"), "name"))
