"""Queries of the relational store over orders (sites) and lineitem (deposits), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorequarry.operators import relational as R
from lorequarry.session import table


def sites(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("site_id"), F.lower("o_orderpriority").alias("instance"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"), F.lit(0.0).alias("z"), (F.col("o_orderstatus") == "F").alias("mined"))


def deposits(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("site_id"), F.lower("l_returnflag").alias("kind"), F.col("l_quantity").alias("volume"), (F.col("l_tax") > 0.06).alias("estimated"))


SITES = "SELECT o_orderkey AS site_id, lower(o_orderpriority) AS instance, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y, 0.0e0 AS z, o_orderstatus = 'F' AS mined FROM orders"
DEPOSITS = "SELECT l_orderkey AS site_id, lower(l_returnflag) AS kind, l_quantity AS volume, l_tax > 0.06e0 AS estimated FROM lineitem"
BASE = f"""
WITH sites AS ({SITES}), deposits AS ({DEPOSITS}),
o AS (SELECT d.site_id, kind, volume, instance, x, y, z FROM deposits d JOIN sites s ON d.site_id = s.site_id
      WHERE NOT mined AND NOT estimated AND instance = '1-urgent' AND kind = 'n'),
t AS (SELECT site_id, x, y, z, sum(volume) AS total, max(volume) AS largest FROM o GROUP BY ALL)
"""
INSTANCE, KIND = "1-URGENT", "N"
AT = (100.0, 150000.0, 0.0)
D2 = "(x - 100.0e0) * (x - 100.0e0) + (y - 150000.0e0) * (y - 150000.0e0) + z * z"


def _open(spark, d):
    return R.open_deposits(sites(spark, d), deposits(spark, d), INSTANCE, KIND)


QUERIES = {
    "flt1_open_deposits": (lambda s, d: _open(s, d).select("site_id", "volume"), BASE + "SELECT site_id, volume FROM o"),
    "flt2_sites_with_kind": (
        lambda s, d: sites(s, d).join(deposits(s, d).where("kind = 'r' AND NOT estimated"), "site_id", "left_semi").select("site_id"),
        BASE + "SELECT site_id FROM sites s WHERE EXISTS (SELECT 1 FROM deposits d WHERE d.site_id = s.site_id AND kind = 'r' AND NOT estimated)",
    ),
    "flt3_strict_threshold": (lambda s, d: R.totals_by_site(_open(s, d), 100.0).select("site_id", "total"), BASE + "SELECT site_id, total FROM t WHERE total > 100"),
    "flt4_radius": (lambda s, d: R.within(sites(s, d), *AT, 20.0).select("site_id"), BASE + f"SELECT site_id FROM sites WHERE {D2} <= 20000.0e0 * 20000.0e0"),
    "prj1_site_records": (lambda s, d: sites(s, d).select("site_id", "instance", "x", "y", "z"), BASE + "SELECT site_id, instance, x, y, z FROM sites"),
    "jn1_site_sums": (lambda s, d: R.totals_by_site(R.open_deposits(sites(s, d), deposits(s, d))).select("site_id", "total"), BASE + "SELECT d.site_id, sum(volume) AS total FROM deposits d JOIN sites s ON d.site_id = s.site_id WHERE NOT mined AND NOT estimated GROUP BY 1"),
    "jn2_semi_join": (lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "ag1_summary": (
        lambda s, d: R.summary(_open(s, d)),
        BASE + "SELECT (SELECT count(*) FROM o) AS deposits, coalesce((SELECT max(volume) FROM o), 0.0e0) AS largest, (SELECT site_id FROM t ORDER BY total DESC, site_id LIMIT 1) AS richest, coalesce((SELECT max(total) FROM t), 0.0e0) AS richest_total",
    ),
    "ag2_sum_and_max": (lambda s, d: R.totals_by_site(_open(s, d)).select("site_id", "total", "largest"), BASE + "SELECT site_id, total, largest FROM t"),
    "ag3_breakdown": (
        lambda s, d: R.breakdown(sites(s, d), deposits(s, d)).select("site_id", F.explode("kinds").alias("k")).select("site_id", "k.kind", "k.volume"),
        BASE + "SELECT d.site_id, kind, sum(volume) AS volume FROM deposits d JOIN sites s ON d.site_id = s.site_id WHERE NOT estimated GROUP BY 1, 2",
    ),
    "ag4_site_totals": (
        lambda s, d: R.site_totals(_open(s, d), 60.0),
        BASE + "SELECT count(*) AS sites, coalesce(sum(total), 0.0e0) AS combined, (SELECT site_id FROM t WHERE total > 60 ORDER BY total DESC, site_id LIMIT 1) AS richest, coalesce(max(total), 0.0e0) AS richest_total FROM t WHERE total > 60",
    ),
    "tk3_nearest_one": (lambda s, d: R.nearest(_open(s, d), *AT, 30.0, 1).select("site_id", "total", F.round("distance", 6).alias("distance")), BASE + f"SELECT site_id, total, round(sqrt({D2}), 6) AS distance FROM t WHERE total > 30 ORDER BY {D2}, site_id LIMIT 1"),
    "tk4_nearest_k": (lambda s, d: R.nearest(_open(s, d), *AT, 30.0, 10).select("site_id", "total", F.round("distance", 6).alias("distance")), BASE + f"SELECT site_id, total, round(sqrt({D2}), 6) AS distance FROM t WHERE total > 30 ORDER BY {D2}, site_id LIMIT 10"),
    "tk5_largest_one": (lambda s, d: R.largest(_open(s, d)).select("site_id", "total"), BASE + "SELECT site_id, total FROM t WHERE total > 0 ORDER BY total DESC, site_id LIMIT 1"),
    "tk5_largest_k_within": (lambda s, d: R.largest(_open(s, d), AT, 50.0, 12).select("site_id", "total", F.round("distance", 6).alias("distance")), BASE + f"SELECT site_id, total, round(sqrt({D2}), 6) AS distance FROM t WHERE {D2} <= 50000.0e0 * 50000.0e0 ORDER BY total DESC, site_id LIMIT 12"),
    "tk6_richest": (lambda s, d: R.summary(_open(s, d)).select("richest"), BASE + "SELECT site_id AS richest FROM t ORDER BY total DESC, site_id LIMIT 1"),
    "st8_claim": (
        lambda s, d: R.pop_site(sites(s, d), deposits(s, d), INSTANCE, KIND, *AT, 30.0)[1].select("site_id", "mined"),
        BASE + f"SELECT site_id, mined OR site_id = (SELECT site_id FROM t WHERE total > 30 ORDER BY {D2}, site_id LIMIT 1) AS mined FROM sites",
    ),
    "st8_pop_deposit_mode": (
        lambda s, d: R.pop_site(sites(s, d), deposits(s, d), INSTANCE, KIND, *AT, 45.0, "deposit")[0].select("site_id", "largest"),
        BASE + f"SELECT site_id, largest FROM t WHERE largest > 45 ORDER BY {D2}, site_id LIMIT 1",
    ),
    "snk3_ids": (
        lambda s, d: R.ids_for(table(s, d, "part").select(F.col("p_type").alias("name")), table(s, d, "region").select((F.col("r_regionkey") + 1).alias("id"), F.col("r_name").alias("name"))),
        "SELECT r_regionkey + 1 AS id, r_name AS name FROM region UNION ALL SELECT CAST((SELECT max(r_regionkey) + 1 FROM region) + row_number() OVER (ORDER BY name) AS INTEGER), name FROM (SELECT DISTINCT p_type AS name FROM part WHERE p_type NOT IN (SELECT r_name FROM region))",
    ),
    "ag15_index_stats": (lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")), "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1"),
    "ag16_diff_stats": (lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("added"), F.sum("l_linenumber").alias("deleted"), F.count(F.lit(1)).alias("files")), "SELECT l_orderkey, sum(l_quantity) AS added, sum(l_linenumber)::BIGINT AS deleted, count(*) AS files FROM lineitem GROUP BY 1"),
}
