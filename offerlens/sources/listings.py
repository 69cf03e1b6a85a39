"""Products as shops list them: names with makers, forms, doses and packs, spelt by each site in its own way.

A name follows from the keys of the test tables by whole-number arithmetic, so that oracles can say the same: one site leaves
out makers, another forms, and some doses have two parts in either order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import _list, _nth, products

MAKERS = ("altai", "mirola", "medoil", "seide", "vitar", "bravin")
FORMS = (None, "krem", "gel", "tablet")
DOSES = ("100 mq", "200 mq", "400 mq")
ORDERS = ("5 mq/10 mq", "10 mq/5 mq")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of products, with name as listed, norm (its words alone), maker, form, dose and url."""
    df = products(spark, sf_dir).withColumnRenamed("name", "words")
    df = df.withColumn("maker", F.when(F.expr("not (site = 'rival_a' and match_id % 4 = 0)"), _nth(MAKERS, "(match_id div 64) % 6")))
    df = df.withColumn("form", F.when(F.expr("not (site = 'rival_b' and match_id % 7 = 0)"), _nth(FORMS, "(match_id div 3) % 4")))
    df = df.withColumn("dose", F.when(F.expr("match_id % 6 = 5"), _nth(ORDERS, "(match_id div 6 + length(site)) % 2")).otherwise(_nth(DOSES, "match_id % 3")))
    df = df.withColumn("norm", F.concat_ws(" ", "words", "maker"))
    df = df.withColumn("name", F.concat_ws(" ", "norm", "dose", "form", F.expr("concat('N', 10 + match_id % 2 * 10)")))
    return df.withColumn("url", F.expr("concat('https://', site, '.example/p/', match_id % 97, '-', product_id div 7)"))


#: The same listings in SQL, from the products of PRODUCTS_SQL.
LISTINGS_SQL = f"""
said AS (
    SELECT * EXCLUDE (name), name AS words, CASE WHEN NOT (site = 'rival_a' AND match_id % 4 = 0) THEN {_list(MAKERS)}[(match_id // 64) % 6 + 1] END AS maker,
           CASE WHEN NOT (site = 'rival_b' AND match_id % 7 = 0) THEN {_list(FORMS)}[(match_id // 3) % 4 + 1] END AS form,
           CASE WHEN match_id % 6 = 5 THEN {_list(ORDERS)}[(match_id // 6 + length(site)) % 2 + 1] ELSE {_list(DOSES)}[match_id % 3 + 1] END AS dose
    FROM products),
listings AS (
    SELECT *, concat_ws(' ', words, maker) AS norm, concat_ws(' ', words, maker, dose, form, 'N' || (10 + match_id % 2 * 10)) AS name,
           'https://' || site || '.example/p/' || match_id % 97 || '-' || product_id // 7 AS url
    FROM said)"""
