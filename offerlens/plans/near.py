"""Queries of names that differ in few words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import near
from ..sources.lineage import PRODUCTS_SQL
from ..sources.listings import LISTINGS_SQL, listings
from ..sources.shared import stored
from .registry import query

KEY = f"list_sort(list_distinct(list_filter(string_split({text.fold_sql('norm')}, ' '), lambda w: w <> '')))"
ONLY = "list_filter({a}, lambda w: NOT list_contains({b}, w))"
LISTED = f"{PRODUCTS_SQL},{LISTINGS_SQL}"
NAMED = f"{LISTED}, named AS MATERIALIZED (SELECT norm AS name, {KEY} AS key FROM (SELECT DISTINCT norm FROM listings))"
SIDES = ONLY.format(a="p.key", b="q.key"), ONLY.format(a="q.key", b="p.key")
NEAR = f"{NAMED}, near AS MATERIALIZED (SELECT p.name AS a, q.name AS b, CAST(len({SIDES[0]}) + len({SIDES[1]}) AS BIGINT) AS gap, len(list_intersect(p.key, q.key)) AS shared FROM named p JOIN named q ON p.name < q.name WHERE len({SIDES[0]}) + len({SIDES[1]}) <= 2 AND shared > 0)"


@query("SELECT a, b, gap FROM near", NEAR)
def near_names(spark, d):
    return near.near_names(near.keyed(listings(spark, d), "norm"), most=2)


@query(f"SELECT name, arg_min(word, spot) AS word FROM (SELECT DISTINCT norm AS name, unnest(string_split(norm, ' ')) AS word, unnest(range(len(string_split(norm, ' ')))) AS spot FROM coded) JOIN (SELECT word FROM (SELECT DISTINCT product_id, unnest(string_split(norm, ' ')) AS word FROM coded) GROUP BY word HAVING count(*) < greatest({near.COMMON_LEAST}, (SELECT count(*) // {near.COMMON_SHARE} FROM coded))) USING (word) WHERE length(word) >= {near.BRAND_LETTERS} GROUP BY name", f"{LISTED}, coded AS (SELECT product_id, norm || ' kod' || match_id // 8 AS norm FROM listings)")
def rare_first_words(spark, d):
    """Of names that end in a word of a few parts the first word that is not common."""
    return near.rare_first_words(listings(spark, d).withColumn("norm", F.expr("concat(norm, ' kod', match_id div 8)")))


def kinds_of(items):
    """name, site and significant words of everything listed, once each."""
    kinds = items.select(F.col("norm").alias("name"), "site").distinct()
    return kinds.withColumn("key", text.tokens(names.fold(F.col("name"))))


def linked(items):
    """Names of other sites that differ in two words at most, each way round, with the words beside those of the first."""
    kinds = stored(kinds_of(items))
    pairs = near.near_names(kinds.select("name", "key").distinct())
    every = pairs.union(pairs.select("b", "a", "gap")).union(kinds.select("name", F.col("name").alias("o"), F.lit(0).cast("long")).distinct()).toDF("name", "other", "gap")
    other = kinds.withColumnsRenamed({"name": "other", "site": "other_site", "key": "other_key"})
    both = every.join(kinds, "name").join(other, "other").where("site <> other_site")
    extra = F.when(F.size(F.array_except("key", "other_key")) == 0, F.array_except("other_key", "key"))
    return both.select("name", "site", "other", "other_site", "gap", extra.alias("extra"))


LINKED = f"{NEAR}, kinds AS (SELECT DISTINCT norm AS name, site FROM listings), two AS (SELECT a AS name, b AS other, gap FROM near UNION ALL SELECT b, a, gap FROM near UNION ALL SELECT name, name, 0 FROM named), links AS MATERIALIZED (SELECT k.name, k.site, o.name AS other, o.site AS other_site, gap, p.key AS key, q.key AS other_key, CASE WHEN list_has_all(q.key, p.key) THEN {SIDES[1]} END AS extra FROM two JOIN kinds k ON k.name = two.name JOIN kinds o ON o.name = two.other JOIN named p ON p.name = k.name JOIN named q ON q.name = o.name WHERE k.site <> o.site)"
CLASH = f"len({ONLY.format(a='x.other_key', b='y.other_key')}) > 0 AND len({ONLY.format(a='y.other_key', b='x.other_key')}) > 0"
TIED = "x.gap = y.gap AND x.gap = (SELECT min(gap) FROM links z WHERE z.name = x.name AND z.site = x.site AND z.other_site = x.other_site)"


@query(f"SELECT DISTINCT x.name, x.site FROM links x JOIN links y ON x.name = y.name AND x.site = y.site AND (x.other, x.other_site) <> (y.other, y.other_site) WHERE (x.other_site = y.other_site AND {TIED} AND {CLASH}) OR (len(x.extra) > 0 AND len(y.extra) > 0 AND x.extra <> y.extra AND (x.other_site = y.other_site OR ({CLASH})))", LINKED)
def ambiguous_names(spark, d):
    """Names that fit several others, where a pair conflicts if each name has a word that the other lacks."""
    items = stored(listings(spark, d))
    links = stored(linked(items))
    return near.ambiguous(links, near.keyed(items, "norm"), lambda a, b: text.one_sided(F.col(a + "key"), F.col(b + "key")))


CANDIDATES = f"{LINKED}, candidates AS (SELECT c.product_id AS p, r.product_id AS q, r.site AS q_site, gap, c.match_id = r.match_id AND c.product_id % 3 = r.product_id % 3 AS together, r.availability = 'in_stock' AS current, c.price_cents = r.price_cents AS same_price, c.country_code IS NULL OR c.country_code IS NOT DISTINCT FROM r.country_code AS same_country FROM links JOIN listings c ON c.norm = links.name AND c.site = links.site JOIN listings r ON r.norm = other AND r.site = other_site WHERE c.site = 'client')"


@query("SELECT p, q_site, q, gap FROM candidates QUALIFY row_number() OVER (PARTITION BY p, q_site ORDER BY together DESC, gap, current DESC, (same_price AND same_country) DESC, q) = 1", CANDIDATES)
def closest_candidates(spark, d):
    """The likest product at each rival of every product of the client. Products alike in all that counts are one candidate."""
    items = stored(listings(spark, d))
    links = stored(linked(items).where("site = 'client'").select("name", "other", F.col("other_site").alias("q_site"), "gap"))
    mine = items.where("site = 'client'").select(F.col("product_id").alias("p"), F.col("norm").alias("name"), F.col("price_cents").alias("p_price"), F.col("country_code").alias("p_country"), F.col("match_id").alias("p_match"))
    other = items.where("site <> 'client'").select(F.col("norm").alias("other"), F.col("site").alias("q_site"), (F.col("availability") == "in_stock").alias("current"), F.col("price_cents").alias("q_price"), F.col("country_code").alias("q_country"), F.col("match_id").alias("p_match"), F.col("product_id").alias("q"))
    # A cluster has one product a site, so its own members are few; they meet by cluster, the rest by name.
    own = mine.join(other, "p_match").where("p % 3 = q % 3").join(links, ["name", "other", "q_site"]).withColumn("together", F.lit(True))
    rest = near.nearest_by_facts(mine, other, links).withColumn("together", F.lit(False))
    same = {"same_price": F.col("p_price") == F.col("q_price"), "same_country": F.col("p_country").isNull() | F.col("p_country").eqNullSafe(F.col("q_country"))}
    columns = ["p", "q_site", "q", "gap", "current", "same_price", "same_country", "together"]
    return near.closest_first(own.withColumns(same).select(columns).unionByName(rest.withColumns(same).select(columns))).select("p", "q_site", "q", "gap")


KINDS = f"{NAMED}, kinds AS (SELECT DISTINCT site, norm AS name, form, norm || '|' || dose AS bucket, norm AS key, maker AS brand_word, string_split(dose, '/') AS parts FROM listings)"


def kinds_with_evidence(spark, d):
    return listings(spark, d).select("site", F.col("norm").alias("name"), "form", F.concat_ws("|", "norm", "dose").alias("bucket"), F.col("norm").alias("key"), F.col("maker").alias("brand_word"), F.split("dose", "/").alias("parts")).distinct()


@query("SELECT DISTINCT k.name, k.site, s.form FROM kinds k JOIN kinds s USING (site, bucket, key) WHERE k.form IS NULL AND s.form IS NOT NULL", KINDS)
def sibling_forms(spark, d):
    return near.sibling_forms(kinds_with_evidence(spark, d))


@query("SELECT DISTINCT k.name, k.site FROM kinds k JOIN kinds o ON k.site = o.site AND k.brand_word = o.brand_word AND list_sort(k.parts) = list_sort(o.parts) AND k.parts <> o.parts WHERE len(k.parts) > 1", KINDS)
def ordered_doses(spark, d):
    return near.ordered_doses(kinds_with_evidence(spark, d))


MATTERS = "EXISTS (SELECT 1 FROM kinds x JOIN kinds y ON x.site = y.site AND x.brand_word = y.brand_word AND list_sort(x.parts) = list_sort(y.parts) AND x.parts <> y.parts WHERE x.site = {s} AND x.brand_word = {m} AND list_sort(x.parts) = list_sort(string_split({d}, '/')))"
"""Whether the order of doses means something to a site and a maker."""
PAIRED = f"{KINDS}, listed AS (SELECT DISTINCT match_id, site, name, norm, form, maker, dose FROM listings), pairs AS (SELECT a.site AS a_site, a.name AS a, b.site AS b_site, b.name AS b, a.form AS af, b.form AS bf, a.norm AS an, b.norm AS bn, a.maker AS am, b.maker AS bm, a.dose AS ad, b.dose AS bd FROM listed a JOIN listed b ON a.match_id = b.match_id AND a.site < b.site)"
NO_FORM = "EXISTS (SELECT 1 FROM kinds s WHERE s.site = {s} AND s.bucket = {n} || '|' || {d} AND s.form = {f})"
SIBLING = " OR ".join(f"({p}f IS NULL AND {NO_FORM.format(s=f'{p}_site', n=f'{p}n', d=f'{p}d', f=f'{q}f')})" for p, q in ("ab", "ba"))
ORDER = f"(contains(ad, '/') AND ad <> bd AND list_sort(string_split(ad, '/')) = list_sort(string_split(bd, '/')) AND ({MATTERS.format(s='a_site', m='am', d='ad')} OR {MATTERS.format(s='b_site', m='bm', d='bd')}))"


@query(f"SELECT DISTINCT a_site, a, b_site, b FROM pairs WHERE {SIBLING} OR {ORDER}", PAIRED)
def vetoed_links(spark, d):
    """Of the links between listings of one cluster those that other listings of the two sites speak against."""
    listed = stored(listings(spark, d))
    kinds = listed.select("site", "name", "form", F.concat_ws("|", "norm", "dose").alias("bucket"), F.col("norm").alias("key"), F.col("maker").alias("brand_word"), F.split("dose", "/").alias("parts")).distinct()
    one, two = (listed.select("match_id", F.col("site").alias(f"{p}_site"), F.col("name").alias(p)).distinct() for p in "ab")
    return near.vetoed(one.join(two, "match_id").where("a_site < b_site").drop("match_id").distinct(), kinds)
