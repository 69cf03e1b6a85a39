"""Matching of electronics by model codes and series: equal keys, agreeing traits, and one candidate a site."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import strip_accents
from ..sources.shared import spread, stored

# Brands whose code ends in a market, colours, and how far prices of one product may lie apart.
REGION_TAILS = ("apple", "lenovo", "hp")
COLOURS = "black white blue red green gold silver gray grey pink purple titanium midnight starlight graphite"
MOST_RATIO = 1.6


def signature(name: Column) -> Column:
    """brand, code, tail, ram, storage, screen, colours, words of a name.

    A code has letters and digits, four characters or more, and is no size; what follows it after a stroke is its tail."""
    return _once(F.regexp_replace(F.lower(strip_accents(name)), r"(\d)\s+(gb|tb|mm|sm|cm|w|mah)\b", "$1$2"), _signature)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """What body makes of a value that is worked out once, however often body uses it, inside of functions of words too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _signature(x: Column) -> Column:
    memory = F.regexp_extract(x, r"\b(\d{1,2})\s*/\s*(\d{2,4})\s*(?:gb|tb)?\b", 1)
    sizes = F.regexp_extract_all(x, F.lit(r"\b(\d{1,4}\s*(?:gb|tb))\b"), F.lit(1))
    storage = F.coalesce(F.nullif(F.regexp_extract(x, r"\b\d{1,2}\s*/\s*(\d{2,4})\s*(?:gb|tb)?\b", 1), F.lit("")), F.regexp_replace(F.try_element_at(F.array_sort(F.filter(sizes, lambda s: (F.regexp_extract(s, r"\d+", 0).cast("int") >= 32) | s.rlike("tb"))), F.lit(-1)), r"\s*gb|\s+", ""))
    ram = F.coalesce(F.nullif(memory, F.lit("")), F.nullif(F.regexp_extract(x, r"\b(\d{1,2})\s*gb\s*ram\b", 1), F.lit("")))
    screen = F.nullif(F.regexp_extract(x, r"\b(\d{2}(?:\.\d)?)\s*(?:\"|''|inch|dyum)", 1), F.lit(""))

    def worded(parts: Column) -> Column:
        return _once(F.array_sort(F.array_intersect(parts, F.array(*map(F.lit, COLOURS.split())))), lambda colours: _once(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda rest: told(parts, colours, rest)))

    def told(parts: Column, colours: Column, rest: Column) -> Column:
        is_code = lambda w: (F.length(w) >= 4) & w.rlike("[a-z]") & w.rlike("[0-9]") & ~w.rlike(r"^\d+(?:gb|tb|mm|sm|cm|w|v|mah|hz|ml|l|kg|inch)$")
        coded = F.get(F.filter(rest, is_code), F.lit(0))
        plain = F.array_sort(F.array_distinct(F.filter(rest, lambda w: w.rlike("^[a-z]{3,}$") & ~F.array_contains(colours, w) & ~w.isin("ram", "inch", "dyum"))))
        numbers = F.array_sort(F.filter(rest, lambda w: w.rlike(r"^[a-z]?\d{1,3}[a-z]?$")))
        return F.struct(F.get(parts, F.lit(0)).alias("brand"), F.regexp_extract(coded, r"^([a-z0-9]+)", 1).alias("code"), F.nullif(F.regexp_extract(coded, r"^[a-z0-9]+[-/.](.+)$", 1), F.lit("")).alias("tail"), ram.alias("ram"), storage.alias("storage"), screen.alias("screen"), colours.alias("colours"), plain.alias("words"), numbers.alias("numbers"))

    return _once(F.filter(F.split(x, r"[\s,()]+"), lambda w: w != ""), worded)


def _agree(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def same_product(a: Column, b: Column) -> Column:
    """The strategy by which two signatures are one product: code or series; null if they are not."""
    tails = _agree(a["tail"], b["tail"]) | F.startswith(a["tail"], b["tail"]) | F.startswith(b["tail"], a["tail"]) | a["brand"].isin(*REGION_TAILS)
    one_sided = (F.size(F.array_except(a["words"], b["words"])) > 0) & (F.size(F.array_except(b["words"], a["words"])) > 0)
    by_code = (a["code"] == b["code"]) & _agree(a["ram"], b["ram"]) & _agree(a["storage"], b["storage"]) & _agree(a["screen"], b["screen"]) & tails & ~one_sided
    told = a["storage"].isNotNull() | (F.size(a["colours"]) > 0) | (F.size(a["numbers"]) > 0)
    series = told & (F.size(a["words"]) > 0) & (a["words"] == b["words"]) & (a["numbers"] == b["numbers"]) & a["storage"].eqNullSafe(b["storage"]) & a["ram"].eqNullSafe(b["ram"]) & (a["colours"] == b["colours"])
    coded = a["code"].isNotNull() & b["code"].isNotNull()
    return F.when(F.coalesce(a["brand"] == b["brand"], F.lit(False)), F.when(coded & by_code, "code").when(~coded & series, "series"))


def pairs(products: DataFrame) -> DataFrame:
    """a, b, strategy: products of two sites that are one, of prices not too far apart, each the other's only candidate there.

    Candidates share a brand and a code, or a brand and all words of a series: equi-joins, never all against all."""
    # Written once, so that no filter or key works the signatures out anew. A file of many products may be few bytes.
    s = stored(spread(products.where("name is not null"), "product_id").select("product_id", "site", "price_cents", signature(F.col("name")).alias("s")))
    # Without a code a name needs words and something beside them, or it is no one's like.
    told = F.col("s.storage").isNotNull() | (F.size("s.colours") > 0) | (F.size("s.numbers") > 0)
    s = s.where(F.col("s.code").isNotNull() | ((F.size("s.words") > 0) & told))
    keyed = s.withColumn("key", F.when(F.col("s.code").isNotNull(), F.concat_ws("|", F.lit("c"), "s.brand", "s.code")).otherwise(F.concat_ws("|", F.lit("s"), "s.brand", F.array_join("s.words", " "), F.array_join("s.numbers", " "))))
    a = keyed.select("key", *(F.col(c).alias(f"a_{c}") for c in ("product_id", "site", "price_cents", "s")))
    b = keyed.select("key", *(F.col(c).alias(f"b_{c}") for c in ("product_id", "site", "price_cents", "s")))
    near = F.greatest("a_price_cents", "b_price_cents") <= MOST_RATIO * F.least("a_price_cents", "b_price_cents")
    met = a.join(b, "key").where("a_site < b_site").withColumn("strategy", same_product(F.col("a_s"), F.col("b_s"))).where(F.col("strategy").isNotNull() & F.coalesce(near, F.lit(True)))
    only_b = F.count("*").over(Window.partitionBy("a_product_id", "b_site"))
    only_a = F.count("*").over(Window.partitionBy("b_product_id", "a_site"))
    return met.withColumns({"_b": only_b, "_a": only_a}).where("_a = 1 and _b = 1").select(F.col("a_product_id").alias("a"), F.col("b_product_id").alias("b"), "strategy")
