"""Names that differ in few words, the likest of them, names that fit several, and what a site's other names say of a pair.

Words are ordered by the number of names that hold them. Two names that differ in at most g words and share one have the
rarest shared word among the first g + 1 of each, so only these few words bring names together; no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, text

#: Names that meet in one word are compared in cells of about so many by so many, which together hold all their pairs.
CROWDED = 250
#: Least length of a word that can be a brand; products of a catalogue in hundredths and least number that make a word common.
BRAND_LETTERS, COMMON_SHARE, COMMON_LEAST = 3, 100, 50


def keyed(products: DataFrame, name: str = "name") -> DataFrame:
    """name and key, the sorted words of its spelling, of every different name that has one."""
    key = text.tokens(names.fold(F.col("name")))
    return products.select(F.col(name).alias("name")).where("name is not null").distinct().select("name", key.alias("key")).where("size(key) > 0")


def by_rarity(named: DataFrame) -> DataFrame:
    """name and words: those of its key, by how many names hold them, rarest first."""
    each = named.select("name", F.explode("key").alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    placed = F.array_sort(F.collect_list(F.struct("n", "word")))
    return each.join(counts, "word").groupBy("name").agg(F.transform(placed, lambda x: x["word"]).alias("words"))


def near_names(named: DataFrame, most: int = 2) -> DataFrame:
    """a, b (names, a before b) and gap: pairs that share a word and of whose words at most so many are only one name's."""
    prefix = lambda c: F.slice(c, 1, most + 1)
    each = by_rarity(named).select("name", "words", F.explode(prefix("words")).alias("word"))
    cells = each.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word", F.ceil(F.col("n") / CROWDED).cast("int").alias("cells"))
    own = each.join(cells, "word").withColumn("own", F.pmod(F.xxhash64("name"), "cells").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    side = lambda p: dealt.select(*(F.col(c).alias(f"{p}_{c}") for c in ("name", "words", "word", "own", "other")))
    met = side("a").join(side("b"), F.expr("a_word = b_word and a_own = b_other and a_other = b_own and a_name < b_name and abs(size(a_words) - size(b_words)) <= " + str(most)))
    both = F.size("a_words") + F.size("b_words")
    left = F.least(F.size("a_words") - F.array_position("a_words", F.col("a_word")), F.size("b_words") - F.array_position("b_words", F.col("a_word"))) + 1
    # A pair counts where it first meets, and only if enough words are left from there on.
    first = F.get(F.array_intersect(prefix("a_words"), prefix("b_words")), F.lit(0)) == F.col("a_word")
    met = met.where(first & (2 * left >= both - most))
    return met.select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), (both - 2 * F.size(F.array_intersect("a_words", "b_words"))).cast("long").alias("gap")).where(F.col("gap") <= most)


def rare_first_words(products: DataFrame, name: str = "norm") -> DataFrame:
    """name, word: of every different name the first word that is not common in the catalogue; names of common words only have none."""
    each_name = products.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).where("name is not null")
    words = F.filter(F.split("name", " "), lambda w: F.length(w) >= BRAND_LETTERS)
    each = each_name.select("name", "n", F.posexplode(words).alias("at", "word")).groupBy("name", "word").agg(F.min("at").alias("at"), F.first("n").alias("n"))
    most = each_name.agg(F.greatest(F.lit(COMMON_LEAST), F.floor(F.sum("n") / COMMON_SHARE)).alias("m")).scalar()
    rare = each.groupBy("word").agg(F.sum("n").alias("products")).where(F.col("products") < most)
    return each.join(rare.select("word"), "word").groupBy("name").agg(F.min_by("word", "at").alias("word"))


def closest_first(candidates: DataFrame, top: int = 1) -> DataFrame:
    """The candidates (p, q, q_site, and what tells them apart) in order of nearness, the first so many of each p and site.

    First those of p's own cluster (together), then by gap, by whether the offer is current, by whether the price is p's
    (same_price) and the country known no less (same_country); last by q."""
    order = [F.desc("together"), F.asc("gap"), F.desc("current"), (F.col("same_price") & F.col("same_country")).desc(), F.asc("q")]
    place = F.row_number().over(Window.partitionBy("p", "q_site").orderBy(*order))
    return candidates.withColumn("place", place).where(F.col("place") <= top)


def nearest_by_facts(mine: DataFrame, other: DataFrame, links: DataFrame) -> DataFrame:
    """For each p and site one or two candidates, among them the one that closest_first puts first of all that are not together.

    mine: p, name, p_price, p_country. other: q, other (its name), q_site, current, q_price, q_country. links: name, other, q_site,
    gap. Beside the gap only three facts count, so none is met but at the least gap, current if any there is: the first q of
    equal price and of a country known no less by equality, and the first q of all."""
    least = F.min("gap").over(Window.partitionBy("name", "q_site"))
    nearest = links.join(other.select("other", "q_site").distinct(), ["other", "q_site"], "left_semi").withColumn("least", least).where("gap = least").drop("least")
    one = F.struct((~F.col("current")).alias("late"), "q", "q_price", "q_country")
    firsts = other.groupBy("other", "q_site").agg(F.min(one).alias("r"))
    first = nearest.join(firsts, ["other", "q_site"]).groupBy("name", "q_site", "gap").agg(F.min("r").alias("r")).select("name", "q_site", "gap", (~F.col("r.late")).alias("current"), "r.q", "r.q_price", "r.q_country")
    alike = other.groupBy("other", "q_site", "current", "q_price", "q_country").agg(F.min("q").alias("q"))
    facts = nearest.join(alike, ["other", "q_site"]).join(first.select("name", "q_site", "current"), ["name", "q_site", "current"], "left_semi")
    told = facts.groupBy("name", "q_site", "gap", "current", "q_price", F.col("q_country").alias("asked")).agg(F.min(F.struct("q", "q_country")).alias("r")).where("asked is not null")
    untold = facts.groupBy("name", "q_site", "gap", "current", "q_price").agg(F.min(F.struct("q", "q_country")).alias("r")).withColumn("asked", F.lit(None).cast("string"))
    known = told.unionByName(untold).withColumnRenamed("name", "_name")
    equal = mine.join(known, F.expr("name = _name and p_price = q_price and p_country <=> asked")).select(mine["*"], "q_site", "gap", "current", "r.q", "q_price", "r.q_country")
    return equal.unionByName(mine.join(first, "name").select(equal.columns))


def ambiguous(links: DataFrame, features: DataFrame, conflict: Callable[[str, str], Column]) -> DataFrame:
    """name, site of names that fit two different ones, so that nothing tells which is meant.

    links: name, site, other, other_site (of another site), gap, and extra: significant words that the other has beside all of
    name's (null where it lacks one of these). features: name and what conflict(prefix, prefix) needs of it. A name is
    ambiguous if two others at one site, or two that conflict at different ones, have different extra words; or if two at one
    site that conflict are equally near and none is nearer."""
    more = links.where("size(extra) > 0")
    several = more.groupBy("name", "site", "other_site").agg(F.count_distinct("extra").alias("n")).where("n > 1").select("name", "site").distinct()
    # Of each of the rest all others of a site have the same extra words, if any: pairs are left between sites, and of the nearest.
    rest = links.join(several, ["name", "site"], "left_anti")
    nearest = F.min("gap").over(Window.partitionBy("name", "site", "other_site"))
    rest = rest.withColumn("tied", F.col("gap") == nearest).where("tied or size(extra) > 0").select("name", "site", "other", "other_site", "tied", "extra")
    one = rest.withColumnsRenamed({"other": "o1", "other_site": "s1", "tied": "t1", "extra": "e1"})
    two = rest.withColumnsRenamed({"other": "o2", "other_site": "s2", "tied": "t2", "extra": "e2"})
    pairs = one.join(two, ["name", "site"]).where("o1 <> o2 and (s1 = s2 and o1 < o2 and t1 and t2 or s1 < s2 and size(e1) > 0 and size(e2) > 0 and e1 <> e2)")
    both = pairs.select("name", "site", "o1", "o2")
    f = lambda p: features.select(*(F.col(c).alias(p + c) for c in features.columns))
    clash = both.select("o1", "o2").distinct().join(f("a_"), F.col("o1") == F.col("a_name")).join(f("b_"), F.col("o2") == F.col("b_name")).where(conflict("a_", "b_")).select("o1", "o2")
    return several.union(both.join(clash, ["o1", "o2"], "left_semi").select("name", "site")).distinct()


def sibling_forms(kinds: DataFrame) -> DataFrame:
    """name, site, form: forms that a name without one cannot have, as the site lists another of its bucket and key that says that form.

    kinds: site, name, form, bucket, key."""
    told = kinds.where("form is not null").select("site", "bucket", "key", "form").distinct()
    return kinds.where("form is null").select("site", "name", "bucket", "key").join(told, ["site", "bucket", "key"]).select("name", "site", "form").distinct()


def ordered_doses(kinds: DataFrame) -> DataFrame:
    """name, site of names whose order of doses means something: the site lists both orders of them for the brand.

    kinds: site, name, brand_word, parts (doses as written, an array)."""
    several = kinds.where("size(parts) > 1").withColumn("sorted", F.array_sort("parts"))
    orders = several.groupBy("site", "brand_word", "sorted").agg(F.count_distinct("parts").alias("n")).where("n > 1")
    return several.join(orders, ["site", "brand_word", "sorted"], "left_semi").select("name", "site").distinct()


def crowded(first_words: DataFrame, least: int = 25) -> DataFrame:
    """first_word of names that so many products begin with (first_word, one row a product): there only equal words make a pair."""
    return first_words.groupBy("first_word").agg(F.count("*").alias("products")).where(F.col("products") >= least)


def vetoed(links: DataFrame, kinds: DataFrame) -> DataFrame:
    """a_site, a, b_site, b of links that other names of the two sites speak against.

    links: a_site, a, b_site, b. kinds: site, name, form, bucket, key, brand_word, parts. A link falls if one name says a form
    that the other, without one, cannot have; or if both have the same doses in other orders and order means something."""
    lacking, ordered = sibling_forms(kinds), ordered_doses(kinds).withColumn("matters", F.lit(True))
    facts = kinds.select("site", "name", "form", "parts").join(ordered, ["site", "name"], "left")
    f = lambda p: facts.select(*(F.col(c).alias(f"{p}_{c}") for c in ("site", "form", "parts", "matters")), F.col("name").alias(p))
    both = links.select("a_site", "a", "b_site", "b").join(f("a"), ["a_site", "a"]).join(f("b"), ["b_site", "b"])
    swapped = both.where("size(a_parts) > 1 and a_parts <> b_parts and array_sort(a_parts) = array_sort(b_parts) and coalesce(a_matters, b_matters)")
    found = swapped.select("a_site", "a", "b_site", "b")
    for p, q in (("a", "b"), ("b", "a")):
        cannot = lacking.select(F.col("name").alias(p), F.col("site").alias(f"{p}_site"), F.col("form").alias(f"{q}_form"))
        found = found.union(both.where(f"{p}_form is null").join(cannot, [p, f"{p}_site", f"{q}_form"], "left_semi").select("a_site", "a", "b_site", "b"))
    return found.distinct()
