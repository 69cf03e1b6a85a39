"""Queries about which products are one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards, resolution
from ..sources import lineage as source
from ..sources.adapter import SITES
from ..sources.listings import listings
from .literal import rows, values
from .registry import query

# Made-up pairs, the rules that tell them apart, and whether they are equal in all respects that are read.
PAIRS = [
    ("Nutrin 1", "Nutrin 2", "series,atom", True), ("Nutrin Premium", "Nutrin 3", "series", False), ("Lorem krem 20 q", "Lorem məlhəm 20 q", "form", False),
    ("Lorem ampul", "Lorem məhlul", "", False), ("Sol (daxili məhlul)", "Sol (xarici məhlul)", "route", True), ("Nurax 45", "Nurax", "orphan_number", True),
    ("Altay malina", "Altay limon", "variant_token", False), ("Bez oglanlar N64", "Bez qız N64", "gender,variant_token", False), ("Lorem forte", "Lorem", "modifier,variant_word", False),
    ("Bio T Ag", "Bio T tip 1", "marker", False), ("Vitamin D3", "Vitamin D3 K2", "code", False), ("Plast 10x10 sm", "Plast 10x25 sm", "dimension", True),
    ("Kreo 25 000", "Kreo 10 000", "orphan_number,strength", True), ("Gel 1%", "Gel 2%", "atom,concentration", True), ("Sirop 15 ml", "Sirop 30 ml", "volume", False),
    ("Tab N10", "Tab N20", "pack_count", False), ("Lorem 500mg N20", "Lorem 500 mq №20", "", True), ("Ibu 200 mq", "Ibu 400 mq", "dose", False),
    ("Combi 50 mq", "Combi 40 mq/10 mq", "", False),
]


@query(f"SELECT * FROM {values(PAIRS, 'a, b, rules, ultra')}", prelude=False)
def pair_guards(spark, d):
    found = guards.judged(rows(spark, [p[:2] for p in PAIRS], "a string, b string"))
    said = F.array_join(F.array_compact(F.array(*(F.when(F.col(n), n) for n in guards.GUARDS))), ",")
    return found.select("a", "b", said.alias("rules"), "ultra")


@query()
def feature_struct(spark, d):
    return resolution.blocks(source.products(spark, d))


@query()
def token_set_pairs(spark, d):
    """Pairs of names; products are members of their names, so copies are not expanded."""
    return resolution.links_in(resolution.blocks(source.products(spark, d)), ("brand_word",), 60.0, ())


@query()
def er_clusters(spark, d):
    """Clusters of listings, by barcodes and names, without those that other listings speak against or whose names fit several."""
    p = listings(spark, d).select("product_id", "site", "name", F.col("maker").alias("brand"), "country_code", "barcode")
    return resolution.resolved(p, SITES)


CODED = "one AS (SELECT barcode, site, min(product_id) AS product_id FROM products WHERE barcode IS NOT NULL GROUP BY ALL), coded AS (SELECT product_id, min(product_id) OVER (PARTITION BY barcode) AS cluster, count(*) OVER (PARTITION BY barcode) AS n FROM one), members AS (SELECT product_id, cluster FROM coded WHERE n > 1)"
VIEWS = f"{source.PRODUCTS_SQL}, {CODED}"


def coded(spark, d):
    return resolution.by_barcode(source.products(spark, d))


@query("SELECT * FROM members", VIEWS)
def barcode_groups(spark, d):
    return coded(spark, d)


@query("SELECT site, count(*) AS products, count(cluster) AS matched FROM products LEFT JOIN members USING (product_id) GROUP BY site", VIEWS)
def match_coverage(spark, d):
    return resolution.coverage(source.products(spark, d), coded(spark, d))


@query("SELECT cluster, min(u) AS low, max(u) AS high FROM (SELECT cluster, CAST(price_cents AS DOUBLE) / pack AS u FROM members JOIN products USING (product_id)) GROUP BY cluster HAVING max(u) >= 5 * min(u)", VIEWS)
def price_strangers(spark, d):
    return resolution.suspects(coded(spark, d), source.products(spark, d))


@query("SELECT p.product_id, p.site, p.price_cents FROM products p WHERE product_id NOT IN (SELECT product_id FROM members) AND availability = 'in_stock'", VIEWS)
def unmatched_in_stock(spark, d):
    free = source.products(spark, d).where("availability = 'in_stock'").join(coded(spark, d), "product_id", "left_anti")
    return free.select("product_id", "site", "price_cents")


@query("SELECT p.product_id AS a, q.product_id AS b FROM products p JOIN products q ON p.match_id = q.match_id AND p.product_id < q.product_id WHERE NOT (p.product_id % 5 = 0 AND q.product_id % 2 = 0)", VIEWS)
def pairs_without_rejected(spark, d):
    p = source.products(spark, d).select("match_id", "product_id")
    pairs = p.select("match_id", F.col("product_id").alias("a")).join(p.select("match_id", F.col("product_id").alias("b")), "match_id").where("a < b").select("a", "b")
    # Rejections are stored in any order of their two products.
    rejected = pairs.where("a % 5 = 0 and b % 2 = 0").select(F.col("b").alias("product_a"), F.col("a").alias("product_b"), F.lit(True).alias("is_active"))
    return resolution.without_rejected(pairs, rejected)
