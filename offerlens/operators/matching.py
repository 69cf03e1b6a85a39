"""Groups of products of one name, and catalogue search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names

def same_key_groups(products: DataFrame) -> DataFrame:
    """Products of equal folded key, of which each site has exactly one, in two sites or more."""
    f = products.select("product_id", "site", names.fold(F.col("name")).alias("key"))
    g = f.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("site").alias("sites"), F.min("product_id").alias("cluster"))
    return g.where("n = sites and sites >= 2").select("key", "sites", "cluster")


def search(products: DataFrame, query: str) -> DataFrame:
    """Products of which every query word starts a word of the key; rank 0 if the key is the query, 1 if it
    starts with it, 2 if its first word does, else 3."""
    wanted = [w for w in query.lower().split() if w]
    key = F.concat(F.lit(" "), F.lower("name"))
    hit = F.lit(True)
    for w in wanted:
        hit = hit & F.contains(key, F.lit(" " + w))
    whole = " ".join(wanted)
    rank = F.when(F.lower("name") == whole, 0).when(F.startswith(F.lower("name"), F.lit(whole)), 1).when(F.startswith(F.lower("name"), F.lit(wanted[0])), 2).otherwise(3)
    return products.where(hit).select("product_id", "site", "name", rank.cast("long").alias("rank"))


def suggest(products: DataFrame, word: str, top: int = 10) -> DataFrame:
    """Words of the catalogue that start with the word but for a typing error or two; the commonest first."""
    n = len(word)
    most = 1 if n <= 5 else 2
    words = products.select(F.explode(F.split(F.lower("name"), " ")).alias("w"), "product_id").groupBy("w").agg(F.countDistinct("product_id").alias("products"))
    near = F.levenshtein(F.substring("w", 1, n), F.lit(word))
    return words.where(near <= most).select("w", "products", near.cast("long").alias("errors")).orderBy("errors", F.desc("products"), "w").limit(top)
