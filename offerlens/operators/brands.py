"""Brands of products: known ones found in names and addresses, and whether two products have different ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, text

# Words that are no brand, legal forms of makers, plain goods, and the likeness below which brands differ.
NO_BRAND = "vitamin krem gel sirop tablet kapsul damci sprey uzluk maska sampun dis usaq bez su cay yag derman test set no n"
COMPANIES = "mmc asc llc ltd gmbh inc sa srl spa ag co corp kft oao ooo zao zavod fabrik pharma pharmaceuticals laboratories laboratory lab farmasevtika ilac sanayi"
COMMODITIES = "pambiq bint spirt yod sprislar spris elcek maska plastir termometr qlukoza peroksid"
LEAST_LIKE = 72.0


def is_no_brand(word: Column) -> Column:
    """Whether a word cannot be a brand: a plain word, a mark of a pack, or hardly a word."""
    key = names.fold(word)
    return F.coalesce(key.isin(*NO_BRAND.split()) | key.rlike(r"^n?\d+") | (F.length(key) < 2), F.lit(True))


def is_company(brand: Column) -> Column:
    """Whether a brand is a maker's legal name rather than what customers know it by."""
    words = F.split(F.lower(names.strip_accents(brand)), "[^a-z0-9]+")
    return F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, COMPANIES.split()))), F.lit(False))


def consumer_brand(brand: Column) -> Column:
    """The folded brand, null for makers and for nothing."""
    key = names.fold(brand)
    return F.when(~is_company(brand) & (key != ""), key)


def is_commodity(name: Column) -> Column:
    """Whether a name is of plain goods, which brands alone tell apart."""
    words = F.split(F.lower(names.strip_accents(name)), "[^a-z0-9]+")
    return F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, COMMODITIES.split()))), F.lit(False))


def brands_conflict(a: Column, b: Column) -> Column:
    """Whether two brands that customers know are unlike: in letters, in sets of words, and as parts of each other."""
    x, y = consumer_brand(a), consumer_brand(b)
    within = F.when(F.contains(x, y) | F.contains(y, x), 100.0).otherwise(0.0)
    like = F.greatest(text.indel_similarity(x, y), text.token_set_ratio(text.tokens(x), text.tokens(y)), within)
    return F.when(x.isNotNull() & y.isNotNull(), like < LEAST_LIKE).otherwise(False)


def known(products: DataFrame, catalogue: DataFrame) -> DataFrame:
    """product_id, brand of products in whose name a known alias stands (catalogue: alias, brand): the earliest, of those the longest.

    Every run of words of a name, as long as the longest alias, meets the aliases in an equi-join."""
    aliases = catalogue.select(names.fold(F.col("alias")).alias("k"), F.col("brand").alias("known_brand")).where("k <> ''").distinct()
    words = F.filter(F.split(names.fold(F.col("name")), " "), lambda w: w != "")
    runs = F.flatten(F.transform("w", lambda x, i: F.transform(F.sequence(F.lit(1), F.least("longest", F.size("w") - i)), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("w", i + 1, n), " ").alias("k")))))
    longest = F.coalesce(aliases.agg(F.max(F.size(F.split("k", " ")))).scalar(), F.lit(1))
    each = products.select("product_id", words.alias("w"), longest.alias("longest")).where("size(w) > 0").select("product_id", F.explode(runs).alias("r")).select("product_id", "r.*")
    met = each.join(aliases, "k")
    return met.groupBy("product_id").agg(F.min_by("known_brand", F.struct("at", (-F.col("n")).alias("n"), "known_brand")).alias("brand"))


def resolved(products: DataFrame, catalogue: DataFrame) -> DataFrame:
    """product_id, brand, how: a known brand in the name, else a word in capitals, else the first word; none that cannot be one."""
    df = products.join(known(products, catalogue).withColumnRenamed("brand", "_known"), "product_id", "left")
    capitals = F.nullif(F.regexp_extract("name", r"(?U)\b(\p{Lu}{3,})\b", 1), F.lit(""))
    first = F.get(F.split(F.trim("name"), r"[\s,]+"), F.lit(0))
    good = lambda w: F.when(~is_no_brand(w), w)
    # Columns of their own, so that each is worked out once.
    df = df.withColumns({"_capitals": good(capitals), "_first": good(first)})
    brand = F.coalesce("_known", "_capitals", "_first")
    how = F.when(F.col("_known").isNotNull(), "known").when(F.col("_capitals").isNotNull(), "capitals").when(F.col("_first").isNotNull(), "first_word")
    return df.select("product_id", brand.alias("brand"), how.alias("how"))


def of_address(products: DataFrame, catalogue: DataFrame) -> DataFrame:
    """product_id, brand by the last part of an address (url), read like a name."""
    slug = F.regexp_replace(F.regexp_extract("url", r"([^/?#]*)/?(?:[?#].*)?$", 1), "[-_]+", " ")
    return known(products.select("product_id", slug.alias("name")), catalogue)


def crowded_words(products: DataFrame, least: int = 25) -> DataFrame:
    """first_word, products of names that so many begin with: there only equal words make a pair."""
    first = F.get(F.split(names.fold(names.normalized(F.col("name"))), " "), F.lit(0))
    return products.groupBy(first.alias("first_word")).agg(F.count("*").alias("products")).where(F.col("products") >= least)


def share(products: DataFrame, brands: DataFrame, top: int = 20) -> DataFrame:
    """brand, products, place: the brands with most products."""
    n = products.join(brands, "product_id").groupBy("brand").agg(F.count("*").alias("products")).orderBy(F.desc("products"), "brand").limit(top)
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("products"), "brand")))
