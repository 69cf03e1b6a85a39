"""Entity resolution: which products of different sites are one.

Names, not products, are compared: every different name is read once and each pair of names once, in blocks of equal
keys, a pass for each kind of key. Clusters then grow site by site, at most one product a site. Products of one name are
interchangeable, so a step matches classes with their counts: of all links between a class of clusters and a name, those
that both sides prefer are taken at once, until none is left. That is what taking links one by one in order of pass and
likeness gives, without a list of pairs of products and without a group that one task must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, text
from ..sources.shared import stored
from . import guards, near

#: A block of more names than this is compared in cells of about so many by so many, which together hold all its pairs.
CROWDED = 250
#: Parts that products of one class are numbered in.
SALTS = 32
#: Passes in order: what a block shares, the least likeness, and the most that a link is worth.
PASSES = (("primary", ("brand_word", "doses", "pack_key"), 75.0, 0.95), ("brand_pack", ("brand_word", "pack_key"), 85.0, 0.80), ("brand_dose", ("brand_word", "doses"), 85.0, 0.72), ("first_word", ("first_word",), 88.0, 0.68))


def blocks(products: DataFrame) -> DataFrame:
    """Features of every different (name, brand), with the keys of the passes."""
    named = products.select("name", *(["brand"] if "brand" in products.columns else [F.lit(None).cast("string").alias("brand")])).where("name is not null").distinct()
    f = guards.features(named)
    first = F.get(F.split(names.fold(F.col("norm")), " "), F.lit(0))
    brand = F.get(F.split(names.fold(F.col("brand")), " "), F.lit(0))
    f = f.withColumn("first_word", F.nullif(first, F.lit(""))).withColumn("brand_word", F.coalesce(F.nullif(brand, F.lit("")), F.col("first_word")))
    f = f.withColumn("strict", F.filter("key", lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$")))
    return f.withColumn("pack_key", F.when(F.col("pack")["sure"], F.col("pack")["count"].cast("string")).otherwise(F.coalesce("volume", F.lit(""))))


def links_in(f: DataFrame, keys: tuple[str, ...], least: float, rules: tuple[str, ...] = guards.HARD) -> DataFrame:
    """a, b (names, a before b) and score: pairs of one block that no rule tells apart and that are so much alike."""
    return name_links(f, (("", keys, least, 1.0),), rules).select("a", "b", "score")


def name_links(f: DataFrame, passes: tuple = PASSES, rules: tuple[str, ...] = guards.HARD) -> DataFrame:
    """a, b, pass (from 1), score: links between different names (features f), each by the first pass that makes it.

    A name has a block for each pass of which it has all keys; all passes meet in one join."""
    if "crowded" not in f.columns:
        f = f.withColumn("crowded", F.lit(False))
    block = lambda n, keys: F.when(F.expr(" and ".join(f"{k} is not null" for k in keys)), F.struct(F.lit(n).alias("pass"), F.xxhash64(F.lit(n), *keys).alias("block")))
    placed = F.array_compact(F.array(*(block(n, keys) for n, (_, keys, _, _) in enumerate(passes, 1))))
    f = f.withColumn("x", F.explode(placed)).withColumns({"pass": F.col("x.pass"), "block": F.col("x.block")}).drop("x").dropDuplicates(["block", "name"])
    sizes = f.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block", F.ceil(F.col("n") / CROWDED).cast("int").alias("cells"))
    f = f.join(sizes, "block").withColumn("own", F.pmod(F.xxhash64("name"), "cells").cast("int"))
    dealt = f.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    a, b = guards.side(dealt, "a_"), guards.side(dealt, "b_")
    met = a.join(b, (F.col("a_block") == F.col("b_block")) & (F.col("a_own") == F.col("b_other")) & (F.col("a_other") == F.col("b_own")) & (F.col("a_name") < F.col("b_name")))
    # Where very many products begin with a word, the rest of the name tells what they are.
    met = met.where((~F.col("a_crowded") & ~F.col("b_crowded")) | (F.col("a_strict") == F.col("b_strict")))
    least = F.element_at(F.array(*(F.lit(float(p[2])) for p in passes)), F.col("a_pass"))
    met = met.where(~guards.conflict("a_", "b_", rules)).where(text.token_set_bound(F.col("a_key"), F.col("b_key")) >= least)
    scored = met.select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), F.col("a_pass").alias("pass"), least.alias("least"), text.token_set_ratio(F.col("a_key"), F.col("b_key")).alias("score"))
    return scored.where("score >= least").groupBy("a", "b").agg(F.min("pass").alias("pass"), F.max("score").alias("score"))


def with_crowds(f: DataFrame, products: DataFrame, least: int) -> DataFrame:
    """f with crowded: whether so many products have names of the same first word."""
    words = products.select("name").join(f.select("name", "first_word").dropDuplicates(["name"]), "name")
    crowds = near.crowded(words.where("first_word is not null"), least).select("first_word", F.lit(True).alias("crowded"))
    return f.join(crowds, "first_word", "left").na.fill(False, ["crowded"])


def kind(site: str, name: str, country: str) -> Column:
    """What products have in common that no rule tells apart: site, name and country, if known."""
    return F.concat_ws("\x01", site, name, F.coalesce(country, F.lit("")))


def kind_links(products: DataFrame, passes: tuple = PASSES, crowd: int = 25) -> DataFrame:
    """a, b (kinds, each way), pass (0 for one name), score: links between kinds of different sites that nothing speaks against.

    products: product_id, site, name, brand, country_code, kind. Beside the rules over two names these count: the countries; what
    else the two sites list (forms that a sibling has, orders of doses); and whether one of the names fits several."""
    f = stored(with_crowds(blocks(products), products, crowd))
    one_name = f.dropDuplicates(["name"])
    pairs = name_links(f, passes)
    same = one_name.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(0).alias("pass"), F.lit(100.0).alias("score"))
    every = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "pass", "score")).unionByName(same)
    kinds = products.select("kind", "site", "name", "country_code").distinct()
    of = lambda p: kinds.select(F.col("kind").alias(f"{p}_kind"), F.col("site").alias(f"{p}_site"), F.col("name").alias(p), F.col("country_code").alias(f"{p}_country_code"))
    links = stored(every.join(of("a"), "a").join(of("b"), "b").where("a_site <> b_site").where(~guards.country("a_", "b_")))
    told = kinds.select("site", "name").distinct().join(one_name.select("name", "form", "brand_word", F.split(names.dosage(F.col("name")), "/").alias("parts"), F.concat_ws("|", "brand_word", F.array_join("doses", "/"), "pack_key").alias("bucket"), F.array_join(F.filter("key", lambda w: ~w.rlike("[0-9]")), " ").alias("key")), "name")
    links = links.join(near.vetoed(links.select("a_site", "a", "b_site", "b").distinct(), told), ["a_site", "a", "b_site", "b"], "left_anti")
    unclear = near.ambiguous(fits(links, one_name), one_name, lambda a, b: guards.conflict(a, b))
    for p in "ab":
        links = links.join(unclear.select(F.col("name").alias(p), F.col("site").alias(f"{p}_site")), [p, f"{p}_site"], "left_anti")
    return links.select(F.col("a_kind").alias("a"), F.col("b_kind").alias("b"), "pass", "score").distinct()


def fits(links: DataFrame, f: DataFrame) -> DataFrame:
    """name, site, other, other_site, gap, extra of links of the first pass, as near.ambiguous takes them."""
    words = f.select("name", "key", F.filter("key", lambda w: (F.length(w) >= 4) & ~w.rlike("[0-9]")).alias("said"))
    w = lambda p: words.select(F.col("name").alias(p), F.col("key").alias(f"{p}_key"), F.col("said").alias(f"{p}_said"))
    both = links.where("pass <= 1").select("a", "a_site", "b", "b_site").distinct().join(w("a"), "a").join(w("b"), "b")
    gap = F.size(F.array_except("a_key", "b_key")) + F.size(F.array_except("b_key", "a_key"))
    extra = F.when(F.size(F.array_except("a_said", "b_said")) == 0, F.array_except("b_said", "a_said"))
    return stored(both.select(F.col("a").alias("name"), F.col("a_site").alias("site"), F.col("b").alias("other"), F.col("b_site").alias("other_site"), gap.alias("gap"), extra.alias("extra")))


def numbered(df: DataFrame, key: str, item: str) -> DataFrame:
    """df with place: its rows of one key numbered from 0, in salted parts, so that no key is sorted in one task."""
    df = df.withColumn("salt", F.pmod(F.xxhash64(item), F.lit(SALTS)).cast("int"))
    counts = df.groupBy(key, "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(key).alias("_key"), F.col("salt").alias("_salt"), F.coalesce(before, F.lit(0)).alias("offset"))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key, "salt").orderBy(item)))
    return ranked.join(offsets, (F.col(key) == F.col("_key")) & (F.col("salt") == F.col("_salt"))).withColumn("place", F.col("offset") + F.col("rank") - 1).drop("_key", "_salt", "offset", "rank", "salt")


def _matched(left: DataFrame, right: DataFrame, edges: DataFrame) -> DataFrame:
    """l, r, pass, score, n, l_from, r_from: how many of each class are matched, and from which place on, given counts
    (l, n), (r, n) and edges (l, r, pass, score)."""
    free_l, free_r, done, turn = left, right, None, 0
    present = edges.join(right.select("r"), "r", "left_semi")
    open_edges = stored(present.withColumn("o", F.struct("pass", (-F.col("score")).alias("s"), "r", "l")))
    while True:
        best_l = open_edges.groupBy("l").agg(F.min("o").alias("o"))
        best_r = open_edges.groupBy("r").agg(F.min("o").alias("o"))
        chosen = best_l.join(best_r.withColumnRenamed("o", "p"), (F.col("o.r") == F.col("r")) & (F.col("o") == F.col("p"))).select("l", "r", F.col("o.pass").alias("pass"), (-F.col("o.s")).alias("score"))
        counts = chosen.join(free_l.withColumnRenamed("n", "ln"), "l").join(free_r.withColumnRenamed("n", "rn"), "r")
        taken = stored(counts.select("l", "r", "pass", "score", F.least("ln", "rn").alias("n"), F.lit(turn).alias("turn")))
        if taken.isEmpty():
            break
        done = taken if done is None else done.unionByName(taken)
        less = lambda free, k: free.join(taken.select(k, F.col("n").alias("used")), k, "left").select(k, (F.col("n") - F.coalesce("used", F.lit(0))).alias("n")).where("n > 0")
        free_l, free_r = stored(less(free_l, "l")), stored(less(free_r, "r"))
        open_edges = stored(open_edges.join(free_l.select("l"), "l", "left_semi").join(free_r.select("r"), "r", "left_semi"))
        turn += 1
    if done is None:
        done = taken
    so_far = lambda k: F.coalesce(F.sum("n").over(Window.partitionBy(k).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return done.withColumn("l_from", so_far("l")).withColumn("r_from", so_far("r"))


def by_barcode(products: DataFrame, least: int = 8) -> DataFrame:
    """product_id, cluster of products of one barcode of so many digits, one a site (the first by id), on two sites or more."""
    code = F.regexp_replace(F.col("barcode"), r"\D", "")
    one = products.where(F.length(code) >= least).groupBy(code.alias("code"), "site").agg(F.min("product_id").alias("product_id"))
    groups = one.groupBy("code").agg(F.count("*").alias("n"), F.min("product_id").alias("cluster")).where("n > 1")
    return one.join(groups.select("code", "cluster"), "code").select("product_id", "cluster")


def resolved(products: DataFrame, sites: tuple[str, ...], passes: tuple = PASSES, use_barcodes: bool = True, crowd: int = 25) -> DataFrame:
    """product_id, site, cluster, strategy, confidence of every product that has a counterpart at another site.

    products: product_id, site, name, and if there are any brand, country_code and barcode. A cluster has one product a
    site at most and is named by its smallest product. A product joins a cluster only if its kind (site, name, country) is
    linked to those of all members. Names that fit several others are linked to none. Products without a name or of
    another site take no part."""
    known = lambda c: F.col(c) if c in products.columns else F.lit(None).cast("string").alias(c)
    listed = products.where(F.col("site").isin(*sites) & F.col("name").isNotNull() & F.col("product_id").isNotNull())
    # Read for the barcodes, for the rest and for the sites of what barcodes found: written, so that products are worked out once.
    everything = stored(listed.select("product_id", "site", "name", known("brand"), known("country_code"), known("barcode")))
    coded = stored(by_barcode(everything)) if use_barcodes and "barcode" in products.columns else None
    rest = everything if coded is None else everything.join(coded, "product_id", "left_anti")
    rest = stored(rest.select("product_id", "site", "name", "brand", "country_code").withColumn("kind", kind("site", "name", "country_code")))
    links = stored(kind_links(rest, passes, crowd))
    start = lambda s: rest.where(F.col("site") == s)
    clusters = stored(start(sites[0]).select(F.col("product_id").alias("cluster"), F.array("kind").alias("l")))
    members = start(sites[0]).select("product_id", "site", F.col("product_id").alias("cluster"), F.lit(None).cast("int").alias("pass"), F.lit(None).cast("double").alias("score"))
    for site in sites[1:]:
        new = start(site).select("product_id", F.col("kind").alias("r"))
        classes = stored(clusters.groupBy("l").agg(F.count("*").alias("n")))
        each = classes.select("l", F.explode("l").alias("a")).join(links, "a")
        edges = each.groupBy("l", F.col("b").alias("r")).agg(F.count("*").alias("k"), F.max("pass").alias("pass"), F.min("score").alias("score")).where("k = size(l)").drop("k")
        plan = stored(_matched(classes, stored(new.groupBy("r").agg(F.count("*").alias("n"))), edges))
        within = lambda place, start: (F.col(place) >= F.col(start)) & (F.col(place) < F.col(start) + F.col("n"))
        left = numbered(clusters, "l", "cluster").join(plan, "l").where(within("place", "l_from")).select("cluster", "l", "r", "pass", "score", (F.col("place") - F.col("l_from") + F.col("r_from")).alias("at"))
        right = numbered(new, "r", "product_id").select("product_id", "r", F.col("place").alias("at"))
        pairs = stored(left.join(right, ["r", "at"]).select("product_id", "cluster", "l", "r", "pass", "score"))
        alone = new.join(pairs, "product_id", "left_anti").select(F.col("product_id").alias("cluster"), F.array("r").alias("l"))
        grown = pairs.select("cluster", F.array_sort(F.array_distinct(F.concat("l", F.array("r")))).alias("l"))
        clusters = stored(clusters.join(pairs, "cluster", "left_anti").unionByName(grown).unionByName(alone))
        members = members.unionByName(pairs.select("product_id", F.lit(site).alias("site"), "cluster", "pass", "score")).unionByName(new.join(pairs, "product_id", "left_anti").select("product_id", F.lit(site).alias("site"), F.col("product_id").alias("cluster"), F.lit(None).cast("int").alias("pass"), F.lit(None).cast("double").alias("score")))
    members = stored(members)
    worth = F.when(F.col("worst") == 0, F.lit(1.0))
    for number, (_, _, _, most) in enumerate(passes, 1):
        worth = worth.when(F.col("worst") == number, F.least(F.col("least") / 100, F.lit(most)))
    named = F.element_at(F.array(F.lit("same_name"), *(F.lit(p[0]) for p in passes)), F.col("worst") + 1)
    groups = members.groupBy("cluster").agg(F.count("*").alias("n"), F.max("pass").alias("worst"), F.min("score").alias("least"), F.min("product_id").alias("first")).where("n > 1")
    found = members.select("product_id", "site", "cluster").join(groups, "cluster").select("product_id", "site", F.col("first").alias("cluster"), named.alias("strategy"), worth.alias("confidence"))
    if coded is None:
        return found
    return found.unionByName(coded.join(everything.select("product_id", "site"), "product_id").select("product_id", "site", "cluster", F.lit("barcode").alias("strategy"), F.lit(1.0).alias("confidence")))


def suspects(members: DataFrame, prices: DataFrame, ratio: float = 5.0) -> DataFrame:
    """cluster, low, high: clusters whose dearest unit price is so many times the cheapest; a missing price says nothing."""
    unit = (F.col("price_cents") / F.greatest(F.coalesce("pack", F.lit(1)), F.lit(1))).alias("unit")
    a = members.join(prices.where("price_cents > 0").select("product_id", unit), "product_id").groupBy("cluster").agg(F.min("unit").alias("low"), F.max("unit").alias("high"))
    return a.where(F.col("high") >= ratio * F.col("low"))


def split_conflicts(members: DataFrame, products: DataFrame) -> DataFrame:
    """cluster, a, b: pairs of one cluster that a precise rule tells apart. Clusters have a product a site, so pairs are few."""
    f = members.join(products.select("product_id", "name"), "product_id").select("cluster", "product_id", "name")
    f = guards.features(f)
    a, b = guards.side(f, "a_"), guards.side(f, "b_")
    met = a.join(b, (F.col("a_cluster") == F.col("b_cluster")) & (F.col("a_product_id") < F.col("b_product_id")))
    return met.where(guards.conflict("a_", "b_", guards.SPEC)).select(F.col("a_cluster").alias("cluster"), F.col("a_product_id").alias("a"), F.col("b_product_id").alias("b"))


def analogs(products: DataFrame, wanted: DataFrame, least: float = 80.0, top: int = 5) -> DataFrame:
    """a, b (names), score, safe: for each wanted name the likest names that no rule tells apart; safe if equal in all respects."""
    f = stored(blocks(products))
    pairs = links_in(f, ("first_word",), least)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).join(wanted.select(F.col("name").alias("a")).distinct(), "a")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    best = both.withColumn("rank", rank).where(F.col("rank") <= top)
    x = best.join(guards.side(f.dropDuplicates(["name"]), "a_"), F.col("a") == F.col("a_name")).join(guards.side(f.dropDuplicates(["name"]), "b_"), F.col("b") == F.col("b_name"))
    return x.select("a", "b", "score", "rank", guards.same_in_all("a_", "b_").alias("safe"))


def without_rejected(pairs: DataFrame, rejections: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of products that nobody has rejected, in either order."""
    gone = rejections.where("is_active").select(F.least("product_a", "product_b").alias("_a"), F.greatest("product_a", "product_b").alias("_b"))
    return pairs.join(gone, (F.least(a, b) == F.col("_a")) & (F.greatest(a, b) == F.col("_b")), "left_anti")


def coverage(products: DataFrame, members: DataFrame) -> DataFrame:
    """By site: products, and those with a counterpart."""
    seen = products.select("product_id", "site").join(members.select("product_id", F.lit(1).alias("m")), "product_id", "left")
    return seen.groupBy("site").agg(F.count("*").alias("products"), F.count("m").alias("matched"))

