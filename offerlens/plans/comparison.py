"""Queries of the comparison page and what is counted over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparison
from ..sources import lineage as source
from ..sources.adapter import CLIENT, NOW, SITES
from .lineage import AGES, IDENTITY, OFFERS
from .registry import query

STALE = 400
ORDER = "CASE site " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SITES, 1)) + " END"
AGE = f"CAST(greatest(0, floor((epoch(TIMESTAMP '{NOW}') - epoch(last_seen_at)) / 86400)) AS BIGINT)"


def rows_sql(unavailable: bool) -> str:
    out = "" if unavailable else " WHERE NOT out"
    return f"""
state AS (SELECT *, {AGE} AS age, {AGE} > {STALE} AS stale FROM shadow),
selling AS (SELECT * FROM state WHERE why IS NULL AND price_cents > 0 QUALIFY row_number() OVER (PARTITION BY match_id, site ORDER BY product_id DESC) = 1),
ended AS (SELECT * FROM state s WHERE why = 'out_of_stock' AND NOT stale AND NOT EXISTS (SELECT 1 FROM state o WHERE o.match_id = s.match_id AND o.site = s.site AND o.why IS NULL) QUALIFY row_number() OVER (PARTITION BY match_id, site ORDER BY product_id DESC) = 1),
e AS (SELECT * FROM (SELECT match_id, site, {ORDER} AS pos, CAST(price_cents AS DOUBLE) AS price, CAST(price_cents AS DOUBLE) / pack AS unit, pack, pack > 1 AS sure, age, stale, false AS out FROM selling
      UNION ALL SELECT match_id, site, {ORDER}, CAST(price_cents AS DOUBLE), CAST(price_cents AS DOUBLE) / pack, pack, pack > 1, age, false, true FROM ended){out}),
f AS (SELECT * FROM e WHERE NOT stale AND NOT out),
b AS (SELECT match_id, count(*) AS n, CASE WHEN count(*) >= 2 AND bool_or(sure) AND max(pack) >= 2 * min(pack) AND (max(unit) - min(unit)) / max(unit) * 100 < (max(price) - min(price)) / max(price) * 100 THEN 'unit' ELSE 'raw' END AS basis FROM f GROUP BY match_id),
v AS (SELECT f.*, n, basis, CASE WHEN basis = 'unit' THEN unit ELSE price END AS val FROM f JOIN b USING (match_id)),
mid AS (SELECT match_id, list_sort(list(val))[count(*) // 2 + 1] AS med FROM v GROUP BY match_id),
k AS (SELECT v.* FROM v JOIN mid USING (match_id) WHERE n < 2 OR (val >= med * 0.12 AND val <= med / 0.12)),
st AS (SELECT match_id, count(*) AS nk, min(val) AS mn, max(val) AS mx, arg_min(site, pos) FILTER (val = low) AS cheap FROM (SELECT *, min(val) OVER (PARTITION BY match_id) AS low FROM k) GROUP BY match_id),
left_over AS (SELECT match_id, count(*) FILTER (stale) AS old, count(*) FILTER (out) AS ended FROM e GROUP BY match_id),
cmp AS (
    SELECT l.match_id, m.name, m.confidence, m.is_manual, CAST(old + coalesce(nk, 0) AS INTEGER) AS n_priced, coalesce(basis, 'raw') AS basis,
           CASE WHEN nk >= 2 THEN mn END AS low, CASE WHEN nk >= 2 THEN mx END AS high, CASE WHEN nk >= 2 THEN cheap END AS cheapest, CASE WHEN nk >= 2 THEN (mx - mn) / mx * 100 END AS spread
    FROM left_over l LEFT JOIN b USING (match_id) LEFT JOIN st USING (match_id) JOIN matches m USING (match_id) JOIN identity USING (match_id)
    WHERE NOT clash AND match_id NOT IN (SELECT match_id FROM products WHERE site = '{CLIENT}' AND dead) AND (m.is_manual OR m.confidence >= 0.7) AND old + coalesce(nk, 0) > 0 AND old + coalesce(nk, 0) + ended >= 2),
kept AS (SELECT match_id, site, pos, CASE WHEN basis = 'unit' THEN unit ELSE price END AS val FROM k WHERE match_id IN (SELECT match_id FROM cmp))"""


BASE = f"{source.PRODUCTS_SQL}, {source.MATCHES_SQL}, {OFFERS}, {IDENTITY}"
PLAIN, WITH_ENDED = f"{BASE}, {rows_sql(False)}", f"{BASE}, {rows_sql(True)}"
OWN = f"p AS (SELECT c.*, o.val AS own, CASE WHEN o.val IS NULL OR low IS NULL THEN NULL WHEN low = high THEN 'equal' WHEN o.val = low THEN 'cheapest' WHEN o.val = high THEN 'priciest' ELSE 'middle' END AS position FROM cmp c LEFT JOIN (SELECT * FROM kept WHERE site = '{CLIENT}') o USING (match_id))"


def made(spark, d, unavailable: bool = False):
    return comparison.comparison_rows(source.products(spark, d), source.matches(spark, d), SITES, AGES, NOW, stale_days=STALE, unavailable=unavailable)


@query("SELECT *, coalesce(spread, 0) >= 50 AS needs_review FROM cmp", PLAIN)
def comparison_rows(spark, d):
    return comparison.ordered(made(spark, d)).drop("entries")


@query("SELECT match_id, n_priced, basis, low, high, cheapest, spread FROM cmp", WITH_ENDED)
def comparison_with_ended(spark, d):
    return made(spark, d, True).select("match_id", "n_priced", "basis", "low", "high", "cheapest", "spread")


@query("SELECT match_id, position FROM p", f"{PLAIN}, {OWN}")
def comparison_position(spark, d):
    return made(spark, d).select("match_id", comparison.position(CLIENT).alias("position"))


@query("SELECT count(*) AS compared, count(*) FILTER (low <> high) AS differing, count(*) FILTER (low <> high AND position <> 'cheapest') AS competitor_cheaper, count(*) FILTER (low <> high AND position = 'cheapest') AS client_cheapest, count(*) FILTER (low <> high AND position IS NULL) AS no_client_price, count(*) FILTER (low = high) AS same_price, count(*) FILTER (low IS NULL) AS not_comparable FROM p", f"{PLAIN}, {OWN}")
def difference_counts(spark, d):
    return comparison.difference_counts(made(spark, d), CLIENT)


@query("SELECT a.site AS a, b.site AS b, count(*) AS common, count(*) FILTER (a.val = b.val) AS same_price, count(*) FILTER (a.val < b.val) AS a_cheaper, count(*) FILTER (b.val < a.val) AS b_cheaper FROM kept a JOIN kept b ON a.match_id = b.match_id AND a.pos < b.pos GROUP BY ALL", PLAIN)
def comparison_pairs(spark, d):
    return comparison.pair_counts(made(spark, d), SITES)


@query(f"SELECT match_id FROM cmp WHERE EXISTS (SELECT 1 FROM e WHERE e.match_id = cmp.match_id AND site = '{CLIENT}' AND out) AND (EXISTS (SELECT 1 FROM e WHERE e.match_id = cmp.match_id AND site <> '{CLIENT}' AND stale) OR EXISTS (SELECT 1 FROM kept WHERE kept.match_id = cmp.match_id AND site <> '{CLIENT}'))", WITH_ENDED)
def client_out_of_stock(spark, d):
    return comparison.by_stock(made(spark, d, True), "own", CLIENT).select("match_id")


@query("SELECT match_id, coalesce((SELECT string_agg(site, ', ' ORDER BY pos) FROM kept WHERE kept.match_id = cmp.match_id AND val = low), '') AS cheapest_sites FROM cmp", WITH_ENDED)
def comparison_cheapest_sites(spark, d):
    return comparison.notes(made(spark, d, True)).select("match_id", "cheapest_sites")


@query("SELECT x.match_id, '{' || string_agg('\"' || site || '\":' || CAST(price AS BIGINT), ',' ORDER BY pos) || '}' AS prices FROM (SELECT match_id, site, pos, price FROM e WHERE stale UNION ALL SELECT match_id, site, pos, price FROM k) x JOIN cmp USING (match_id) GROUP BY x.match_id", PLAIN)
def comparison_feed(spark, d):
    return comparison.feed(made(spark, d))


@query("SELECT CASE WHEN spread IS NULL THEN 'none' WHEN spread < 5 THEN 'under 5' WHEN spread < 20 THEN 'under 20' ELSE 'wide' END AS band, count(*) AS clusters FROM cmp GROUP BY 1", PLAIN)
def spread_bands(spark, d):
    band = F.when(F.col("spread").isNull(), "none").when(F.col("spread") < 5, "under 5").when(F.col("spread") < 20, "under 20").otherwise("wide")
    return made(spark, d).groupBy(band.alias("band")).agg(F.count("*").alias("clusters"))
