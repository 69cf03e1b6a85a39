"""Queries of what pages and workbooks hold, made of the test tables and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import flight, workbooks
from ..sources.adapter import table
from ..sources.lineage import PRODUCTS_SQL, products
from ..sources.shared import shared_folder
from .registry import query

A_PAGE = 20


def listing_pages(spark, d):
    """site, page, html: the parts as a shop's listing of twenty a page, whose stream comes in two chunks and keeps brands in rows of their own."""
    part = table(spark, d, "part").withColumn("page", (F.col("p_partkey") / A_PAGE).cast("int") + 1)
    last = part.agg(F.max("page")).scalar()
    price = F.round("p_retailprice", 2)
    item = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), price.alias("price"), F.when(F.col("p_size") % 3 == 0, F.round(price + 10, 2)).alias("old_price"), (F.col("p_size") % 4).alias("quantity"),
        F.concat(F.lit("$"), F.lower(F.hex(F.col("p_partkey") + 16))).alias("brand"), F.lpad(F.col("p_partkey").cast("string"), 13, "2").alias("gtin"),
    )
    brand = F.concat(F.lower(F.hex(F.col("p_partkey") + 16)), F.lit(":"), F.to_json(F.struct(F.col("p_brand").alias("name"))))
    page = part.groupBy("page").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items"), F.array_join(F.array_sort(F.collect_list(brand)), "\n").alias("brands"))
    text = F.concat(F.lit('0:["$","main",null,"$L1"]\n1:{"data":{"currentPage":'), F.col("page"), F.lit(',"lastPage":'), last, F.lit(',"list":'), F.col("items"), F.lit("}}\n"), F.col("brands"), F.lit("\n"))
    page = page.withColumn("text", text).withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    literal = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    push = lambda x: F.concat(F.lit("<script>self.__next_f.push([1,"), literal(x), F.lit("])</script>"))
    one, two = F.substring("text", F.lit(1), F.col("half")), F.substring("text", F.col("half") + 1, F.length("text"))
    return page.select(F.lit("shop").alias("site"), "page", F.concat(F.lit("<html><script>self.__next_f.push([0,null])</script>"), push(one), push(two), F.lit("</html>")).alias("html"))


FLIGHT = f"SELECT 'shop' AS site, p_partkey // {A_PAGE} + 1 AS page, CAST(p_partkey AS VARCHAR) AS external_id, p_name AS name, p_brand AS brand, CAST(round(p_retailprice * 100) AS BIGINT) + CASE WHEN p_size % 3 = 0 THEN 1000 ELSE 0 END AS price_cents, CASE WHEN p_size % 3 = 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS discount_cents, lpad(CAST(p_partkey AS VARCHAR), 13, '2') AS gtin, p_size % 4 > 0 AS in_stock, p_partkey // {A_PAGE} + 1 AS current_page, (SELECT max(p_partkey) FROM part) // {A_PAGE} + 1 AS last_page FROM part"


@query(FLIGHT, prelude=False)
def flight_products(spark, d):
    return flight.flight_products(listing_pages(spark, d))


@query(f"SELECT 'shop' AS site, count(DISTINCT page) AS pages, max(last_page) AS last_page, count(DISTINCT external_id) AS products, true AS complete FROM ({FLIGHT})", prelude=False)
def whole_listings(spark, d):
    return flight.whole_listings(flight.flight_products(listing_pages(spark, d)))


@query("SELECT product_id, site, name, price_cents, CASE WHEN product_id % 3 = 0 THEN '=1+' || product_id END AS note FROM products", PRODUCTS_SQL)
def workbook_round_trip(spark, d):
    """Products written as workbooks and read again; what looks like a formula is text with a stroke before it."""
    folder = f"{shared_folder(spark).removeprefix('file:')}/workbooks-{uuid.uuid4().hex}"
    made = products(spark, d).select("product_id", "site", "name", "price_cents", F.when(F.col("product_id") % 3 == 0, F.concat(F.lit("=1+"), F.col("product_id").cast("string"))).alias("note"))
    workbooks.write_workbooks({"products": made}, folder)
    back = workbooks.read_workbook(spark, f"{folder}/products/*.xlsx")
    return back.select(F.col("product_id").cast("long"), "site", "name", F.col("price_cents").cast("long"), F.regexp_replace("note", "^'", "").alias("note"))
