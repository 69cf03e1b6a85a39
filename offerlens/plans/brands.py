"""Queries about brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import brands
from ..sources import lineage as source
from .literal import rows, values
from .registry import query

CATALOGUE = [("Nova Lab", "Nova"), ("Nova", "Nova"), ("Dr. Melo", "Doktor Melo"), ("Doktor Melo", "Doktor Melo"), ("Aqua", "Aqua")]
NAMED = [
    (1, "Krem Nova Lab 20 q", "Nova", "known"), (2, "Doktor Melo Aqua sprey", "Doktor Melo", "known"), (3, "krem LOREM 5%", "LOREM", "capitals"), (4, "Ipsum tablet", "Ipsum", "first_word"),
    (5, "Krem 20 q", None, None), (6, "N20 test", None, None), (7, "aqua NOVA", "Aqua", "known"),
]


def catalogue(spark):
    return rows(spark, CATALOGUE, "alias string, brand string")


@query(f"SELECT * FROM {values(NAMED, 'product_id, name, brand, how')}", prelude=False)
def brands_of_names(spark, d):
    made = rows(spark, [r[:2] for r in NAMED], "product_id long, name string")
    return made.join(brands.resolved(made, catalogue(spark)), "product_id")


SLUGS = [(1, "https://x.az/p/krem-nova-lab-20-q", "Nova"), (2, "https://x.az/doktor_melo/?a=1", "Doktor Melo"), (3, "https://x.az/", None)]


@query(f"SELECT product_id, brand FROM {values(SLUGS, 'product_id, url, brand')} WHERE brand IS NOT NULL", prelude=False)
def brands_of_addresses(spark, d):
    return brands.of_address(rows(spark, [r[:2] for r in SLUGS], "product_id long, url string"), catalogue(spark))


PAIRS = [("Nova", "NOVA", False), ("Nova", "Nova Lab", False), ("Biolar", "Herbal Flora", True), ("Nova", "Melo Pharmaceuticals GmbH", False), (None, "Nova", False), ("Sefar", "Cefar", False)]


@query(f"SELECT * FROM {values(PAIRS, 'a, b, conflict')}", prelude=False)
def brand_conflicts(spark, d):
    made = rows(spark, [r[:2] for r in PAIRS], "a string, b string")
    return made.select("a", "b", brands.brands_conflict(F.col("a"), F.col("b")).alias("conflict"))


@query("SELECT product_id, CASE WHEN contains(name, 'red') THEN 'Red' ELSE 'Gear' END AS brand FROM products WHERE contains(name, 'red') OR contains(name, 'gear')", source.PRODUCTS_SQL)
def known_brands(spark, d):
    return brands.known(source.products(spark, d), rows(spark, [("red", "Red"), ("GEAR", "Gear")], "alias string, brand string"))


@query("SELECT string_split(name, ' ')[1] AS first_word, count(*) AS products FROM products GROUP BY 1 HAVING count(*) >= 25", source.PRODUCTS_SQL)
def crowded_first_words(spark, d):
    named = source.products(spark, d)
    return brands.crowded_words(named, 25).withColumn("first_word", F.when(F.col("first_word") == "kold", "cold").when(F.col("first_word") == "smal", "small").when(F.col("first_word") == "nev", "new").otherwise(F.col("first_word")))
