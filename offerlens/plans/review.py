"""Queries of what people decide about clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation, review
from ..sources.adapter import CLIENT, SITES
from ..sources.lineage import MATCHES_SQL, PRODUCTS_SQL, matches
from ..sources.listings import LISTINGS_SQL, listings
from ..sources.shared import stored
from .registry import query

FLAGGED = f"{PRODUCTS_SQL},{MATCHES_SQL}, flagged AS (SELECT *, match_id % 17 = 0 AS needs_review FROM matches)"


def flagged(spark, d):
    return matches(spark, d).withColumn("needs_review", F.col("match_id") % 17 == 0)


@query("SELECT match_id, f.name, confidence, needs_review, CASE WHEN n >= 2 THEN (high - low) * 10000 // high END AS spread_bp, coalesce(products, 0) AS products FROM flagged f LEFT JOIN (SELECT match_id, min(price_cents) AS low, max(price_cents) AS high, count(price_cents) AS n, count(*) AS products FROM products GROUP BY match_id) USING (match_id) WHERE NOT is_manual AND confidence < 0.85 ORDER BY needs_review DESC, coalesce(CASE WHEN n >= 2 THEN (high - low) * 10000 // high END, 0) DESC, confidence, match_id LIMIT 100", FLAGGED)
def match_suggestions(spark, d):
    return review.suggestions(flagged(spark, d), listings(spark, d))


@query("SELECT 'products' AS what, count(*) AS n FROM products UNION ALL SELECT 'matched_products', count(match_id) FROM products UNION ALL SELECT 'products_to_review', count(*) FROM products JOIN flagged USING (match_id) WHERE needs_review UNION ALL SELECT 'auto', count(*) FROM flagged WHERE NOT is_manual UNION ALL SELECT 'manual', count(*) FROM flagged WHERE is_manual UNION ALL SELECT 'matches_to_review', count(*) FROM flagged WHERE needs_review", FLAGGED)
def match_statistics(spark, d):
    return review.match_statistics(listings(spark, d), flagged(spark, d))


LISTED = f"{PRODUCTS_SQL},{LISTINGS_SQL}"
ASKED = f"{LISTED}, known AS (SELECT product_id, site, CAST(product_id AS VARCHAR) AS external_id, replace(norm, ' ', '-') AS slug FROM listings), asked AS (SELECT DISTINCT site, 'https://x.example/p/' || CASE WHEN product_id % 2 = 0 THEN external_id ELSE upper(slug) || '/?q=1#top' END AS url, CASE WHEN product_id % 2 = 0 THEN external_id END AS number, CASE WHEN product_id % 2 = 1 THEN slug END AS name FROM known WHERE product_id % 5 = 0)"


@query("SELECT url, a.site, product_id, count(*) OVER (PARTITION BY a.site, url) AS found FROM asked a JOIN known k ON a.site = k.site AND (a.number = k.external_id OR a.name = k.slug)", ASKED)
def products_at_addresses(spark, d):
    known = stored(listings(spark, d).select("product_id", "site", F.col("product_id").cast("string").alias("external_id"), F.replace("norm", F.lit(" "), F.lit("-")).alias("slug")))
    url = F.concat(F.lit("https://x.example/p/"), F.when(F.col("product_id") % 2 == 0, F.col("external_id")).otherwise(F.concat(F.upper("slug"), F.lit("/?q=1#top"))))
    return review.at_addresses(known, known.where("product_id % 5 = 0").select("site", url.alias("url")))


PINS = f"""{LISTED},
held AS (SELECT product_id, site, url, CASE WHEN product_id % 4 = 0 THEN match_id END AS match_id, dead, country_code, availability = 'in_stock' AS in_stock FROM listings),
pins AS (SELECT DISTINCT match_id + 1000000 AS target, site, url FROM listings WHERE match_id % 3 = 0 UNION SELECT match_id, site, url FROM listings WHERE match_id % 3 = 1),
one AS (SELECT target, site, url, product_id, match_id AS before, country_code, in_stock FROM pins JOIN held USING (site, url) WHERE NOT dead QUALIFY count(*) OVER (PARTITION BY target, site, url) = 1),
two AS (SELECT * FROM one WHERE in_stock QUALIFY row_number() OVER (PARTITION BY target, site ORDER BY product_id) = 1),
three AS MATERIALIZED (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY target) = 1),
inside AS (SELECT match_id AS target, site, country_code FROM held WHERE match_id IS NOT NULL AND NOT dead UNION ALL SELECT target, site, country_code FROM three)"""


@query("SELECT product_id, before, target AS after FROM three t WHERE before IS DISTINCT FROM target AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.target = t.target AND i.site <> t.site AND i.country_code <> t.country_code)", PINS)
def pinned_products(spark, d):
    """Addresses pinned to clusters of their own, and to those that there are."""
    p = stored(listings(spark, d))
    held = p.select("product_id", "site", "url", F.when(F.col("product_id") % 4 == 0, F.col("match_id")).alias("match_id"), "dead", "country_code", (F.col("availability") == "in_stock").alias("in_stock"))
    own = p.where("match_id % 3 = 0").select((F.col("match_id") + 1_000_000).alias("match_id"), "site", "url")
    pins = own.union(p.where("match_id % 3 = 1").select("match_id", "site", "url")).distinct()
    return review.pinned_moves(pins, held).select("product_id", "before", "after")


@query("SELECT category, count(*) AS products, count(match) AS matched, (SELECT count(DISTINCT c.match) FROM alive c WHERE c.category = a.category AND c.site = 'client' AND EXISTS (SELECT 1 FROM alive o WHERE o.match = c.match AND o.site <> 'client')) AS compared, (SELECT count(DISTINCT c.match) FROM alive c WHERE c.category = a.category AND c.site = 'client' AND NOT EXISTS (SELECT 1 FROM alive o WHERE o.match = c.match AND o.site = 'rival_a')) AS missing_rival_a, (SELECT count(DISTINCT c.match) FROM alive c WHERE c.category = a.category AND c.site = 'client' AND NOT EXISTS (SELECT 1 FROM alive o WHERE o.match = c.match AND o.site = 'rival_b')) AS missing_rival_b FROM alive a GROUP BY category", f"{PRODUCTS_SQL}, alive AS MATERIALIZED (SELECT site, category, CASE WHEN product_id % 4 <> 0 THEN match_id END AS match FROM products WHERE NOT dead)")
def watched_categories(spark, d):
    p = stored(listings(spark, d).select("product_id", "site", "category", F.when(F.col("product_id") % 4 != 0, F.col("match_id")).alias("match_id"), "dead"))
    return review.watched_categories(p, p.select("category"), CLIENT, SITES)


@query("SELECT product_id, CASE WHEN conflicted THEN 'identity_conflicted' WHEN availability = 'out_of_stock' THEN 'out_of_stock' WHEN availability <> 'in_stock' THEN 'offer_not_eligible' WHEN country_code IS NULL THEN 'country_unknown' END AS reason FROM products WHERE conflicted OR availability <> 'in_stock' OR country_code IS NULL", PRODUCTS_SQL)
def unmatchable_reasons(spark, d):
    """Why products can enter no cluster now."""
    found = listings(spark, d).select("product_id", curation.unmatchable_reason(with_country=True).alias("reason"))
    return found.where("reason is not null")


@query("SELECT site, category, expected, raw, failures, different, expected IS NOT NULL AND failures = 0 AND raw = expected AND different = expected AS complete FROM (SELECT site, category, CASE WHEN length(category) % 5 <> 0 THEN count(DISTINCT product_id) + length(site) % 2 * (length(category) % 2) END AS expected, count(DISTINCT product_id) AS raw, count(*) FILTER (conflicted AND length(category) % 7 = 0) AS failures, count(DISTINCT product_id) AS different FROM products GROUP BY site, category)", PRODUCTS_SQL)
def counted_passes(spark, d):
    """Whether a category's pass brought as many products as its source said there are."""
    g = listings(spark, d).groupBy("site", "category").agg(F.count_distinct("product_id").alias("raw"), F.count_if(F.col("conflicted") & (F.length("category") % 7 == 0)).alias("failures"))
    said = F.when(F.length("category") % 5 != 0, F.col("raw") + F.length("site") % 2 * (F.length("category") % 2))
    return review.counted_passes(g.select("site", "category", said.alias("expected"), "raw", "failures", F.col("raw").alias("different")))


EDITS = f"""{LISTED},
held AS MATERIALIZED (SELECT product_id, site, match_id AS own, CASE WHEN product_id % 4 <> 3 THEN match_id END AS match_id FROM listings),
gone AS (SELECT product_id, match_id AS before, match_id IS NULL AS bad FROM held WHERE product_id % 12 = 0),
there AS (SELECT match_id, site, product_id FROM held WHERE match_id IS NOT NULL AND product_id % 12 <> 0),
adds AS (SELECT h.product_id, h.match_id AS before, h.own + 1 AS target, t.product_id AS holder FROM held h LEFT JOIN there t ON t.match_id = h.own + 1 AND t.site = h.site WHERE h.product_id % 10 = 1)"""


@query("SELECT product_id, before, CASE WHEN holder IS NULL THEN target ELSE before END AS after, CASE WHEN holder IS NOT NULL THEN 'the site has a product there' END AS refused FROM adds UNION ALL SELECT product_id, before, NULL, CASE WHEN bad THEN 'not in that cluster' END FROM gone", EDITS)
def edits_by_hand(spark, d):
    """Products taken out of their clusters and put into the next ones, where their site has no other."""
    p = stored(listings(spark, d).select("product_id", "site", F.col("match_id").alias("own"), F.when(F.col("product_id") % 4 != 3, F.col("match_id")).alias("match_id")))
    edits = p.where("product_id % 12 = 0").selectExpr("1 seq", "'remove' kind", "product_id", "own match_id").union(p.where("product_id % 10 = 1").selectExpr("1", "'add'", "product_id", "own + 1"))
    return review.edit_moves(edits, p.drop("own")).select("product_id", "before", "after", "refused")
