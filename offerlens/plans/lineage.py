"""Queries about runs, trust and offers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage, prices
from ..sources import lineage as source
from ..sources.adapter import NOW, SITES, observations
from .registry import query

#: Hours after which a site's data are old.
AGES = {"client": 24 * 500, "rival_a": 24 * 900, "rival_b": 24 * 400}
CURRENT = 199806
RUNS, PRODUCTS = source.RUNS_SQL, source.PRODUCTS_SQL
BOTH = f"{RUNS},{PRODUCTS}"
DAY = "'%Y-%m-%d'"


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


@query("SELECT id, part AS partition, publishable, eligible, partial_ok, partial_ok AND mode = 'watchlist' AS watchlist_ok FROM elig", RUNS)
def run_eligibility(spark, d):
    r = source.runs(spark, d)
    return r.select("id", lineage.has_partition().alias("partition"), lineage.is_publishable().alias("publishable"), lineage.is_eligible().alias("eligible"), lineage.may_alert_locally().alias("partial_ok"), lineage.may_alert_locally("watchlist").alias("watchlist_ok"))


@query("SELECT id, status FROM runs WHERE tenant_id = 1 AND status <> 'running' AND finished_at IS NOT NULL ORDER BY finished_at DESC, id DESC LIMIT 1", RUNS)
def latest_terminal_run(spark, d):
    return lineage.latest_terminal(source.runs(spark, d)).select("id", "status")


SITE_ROWS = "x AS (SELECT trim(unnest(string_split(full_sites, ','))) AS site, * FROM runs WHERE tenant_id = 1 AND status <> 'running' AND finished_at IS NOT NULL AND scope = 'full'), attempts AS (SELECT site, id AS run_id, started_at FROM x QUALIFY row_number() OVER (PARTITION BY site ORDER BY finished_at DESC, id DESC) = 1)"
FINANCIAL = "y AS (SELECT site, id AS run_id, started_at FROM elig JOIN run_sites ON run_id = id WHERE eligible AND tenant_id = 1 AND s = 'ok')"


@query(f"SELECT site, run_id, strftime(started_at, {DAY}) AS started_at FROM attempts", f"{RUNS}, {SITE_ROWS}")
def full_attempts_by_site(spark, d):
    return lineage.full_attempts(source.runs(spark, d)).select("site", "run_id", day("started_at"))


@query(f"SELECT site, max(run_id) AS run_id, strftime(arg_max(started_at, run_id), {DAY}) AS started_at FROM y GROUP BY site", f"{RUNS}, {FINANCIAL}")
def financial_runs_by_site(spark, d):
    return lineage.financial_runs(source.runs(spark, d)).select("site", "run_id", day("started_at"))


@query(f"SELECT t.site, strftime(coalesce((SELECT arg_max(started_at, run_id) FROM y WHERE y.site = t.site AND run_id < {CURRENT}), (SELECT started_at FROM runs WHERE id = {CURRENT})), {DAY}) AS cutoff FROM (VALUES ('client'), ('rival_a'), ('rival_b')) t(site)", f"{RUNS}, {FINANCIAL}")
def new_product_cutoffs(spark, d):
    return lineage.new_product_cutoffs(source.runs(spark, d), SITES, CURRENT).select("site", day("cutoff"))


@query("SELECT site, max(id) AS last_attempt, max(CASE WHEN s = 'ok' AND (status = 'ok' OR part) THEN id END) AS last_success FROM elig JOIN run_sites ON run_id = id WHERE tenant_id = 1 AND n > 0 GROUP BY site", RUNS)
def site_attempts(spark, d):
    return lineage.site_history(source.runs(spark, d))


LIMITS = "(VALUES " + ", ".join(f"('{s}', {h})" for s, h in AGES.items()) + ") l(site, hours)"
FRESH = f"z AS (SELECT site, max(run_id) AS run_id, arg_max(started_at, run_id) AS started_at FROM y GROUP BY site), f AS (SELECT l.site, z.run_id, attempts.run_id AS attempt_id, coalesce(z.run_id = attempts.run_id AND epoch(TIMESTAMP '{NOW}') - epoch(z.started_at) <= hours * 3600, false) AS fresh FROM {LIMITS} LEFT JOIN z USING (site) LEFT JOIN attempts USING (site))"


@query("SELECT * FROM f", f"{RUNS}, {SITE_ROWS}, {FINANCIAL}, {FRESH}")
def financial_inputs_fresh(spark, d):
    return lineage.inputs_are_fresh(source.runs(spark, d), AGES, NOW)


@query(
    f"SELECT CASE WHEN bool_and(ok) THEN 'v1|' || string_agg(site || ':' || run_id, '|' ORDER BY site) || coalesce((SELECT '|isolated:' || sha256(count(*) || ',' || sum(product_id)) FROM products WHERE conflicted AND tenant_id = 1 HAVING count(*) > 0), '') END AS epoch FROM (SELECT l.site, run_id, coalesce(eligible AND epoch(TIMESTAMP '{NOW}') - epoch(attempts.started_at) <= hours * 3600, false) AS ok FROM {LIMITS} LEFT JOIN attempts USING (site) LEFT JOIN elig ON elig.id = run_id)",
    f"{BOTH}, {SITE_ROWS}",
)
def trusted_epoch(spark, d):
    return lineage.epoch(source.runs(spark, d), source.products(spark, d), AGES, NOW)


CONFIRMED = """j AS (
    SELECT *, row_number() OVER () AS row_id FROM (
        SELECT *, row_number() OVER w AS n, lag(price_cents) OVER w AS pp, lag(discount_cents) OVER w AS pd FROM s WINDOW w AS (PARTITION BY product_id ORDER BY k1, k2, k3, k4, k5, k6))
    WHERE n = 1 OR pp IS DISTINCT FROM price_cents OR pd IS DISTINCT FROM discount_cents),
seen AS (
    SELECT product_id, run_id, max((k1, k2, k3, k4, k5, k6)) AS last FROM s
    WHERE run_id IN (SELECT id FROM elig WHERE eligible AND tenant_id = 1) AND (product_id, run_id) NOT IN (SELECT (product_id, run_id) FROM j) GROUP BY ALL),
current AS (SELECT seen.run_id, arg_max(row_id, (k1, k2, k3, k4, k5, k6)) AS row_id FROM seen JOIN j ON j.product_id = seen.product_id AND (k1, k2, k3, k4, k5, k6) <= last GROUP BY seen.product_id, seen.run_id),
confirmed AS (
    SELECT j.*, coalesce(e.eligible, false) AS eligible, CASE WHEN NOT coalesce(e.eligible, false) THEN c.run END AS confirmed_run_id
    FROM j LEFT JOIN (SELECT id, eligible FROM elig WHERE tenant_id = 1) e ON e.id = j.run_id LEFT JOIN (SELECT row_id, min(run_id) AS run FROM current GROUP BY row_id) c USING (row_id))"""


def confirmed(spark, d):
    return lineage.confirmed_journal(observations(spark, d), lineage.eligible_runs(source.runs(spark, d)))


@query("SELECT product_id, run_id, price_cents, discount_cents, k2 AS orderkey, confirmed_run_id FROM confirmed", f"{RUNS}, {CONFIRMED}")
def price_confirmation(spark, d):
    return confirmed(spark, d).select("product_id", "run_id", "price_cents", "discount_cents", F.col("seq.l_orderkey").alias("orderkey"), "confirmed_run_id")


TRUSTED = "trusted AS (SELECT * FROM confirmed WHERE (eligible OR confirmed_run_id IS NOT NULL) AND product_id NOT IN (SELECT product_id FROM products WHERE conflicted))"


@query("SELECT site, count(*) AS rows, count(confirmed_run_id) AS confirmed, count(DISTINCT product_id) AS products FROM trusted GROUP BY site", f"{BOTH}, {CONFIRMED}, {TRUSTED}")
def trusted_snapshots(spark, d):
    t = lineage.trusted(confirmed(spark, d), source.products(spark, d))
    return t.groupBy("site").agg(F.count("*").alias("rows"), F.count("confirmed_run_id").alias("confirmed"), F.countDistinct("product_id").alias("products"))


@query("SELECT product_id, run_id, price_cents, eff AS eff_cents FROM trusted QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC, k5 DESC, k6 DESC) = 1", f"{BOTH}, {CONFIRMED}, {TRUSTED}")
def latest_trusted_prices(spark, d):
    seen = confirmed(spark, d).select("product_id", "run_id", "price_cents", "discount_cents", "seq", "eligible", "confirmed_run_id")
    # The columns of trust are not carried on.
    t = prices.with_effective(prices.latest(lineage.trusted(seen, source.products(spark, d)).drop("eligible", "confirmed_run_id")))
    return t.select("product_id", "run_id", "price_cents", F.col("eff").alias("eff_cents"))


HOURS = "CASE site " + " ".join(f"WHEN '{s}' THEN {h}" for s, h in AGES.items()) + " ELSE 30 END"
WHY = f"CASE WHEN conflicted THEN 'identity_conflicted' WHEN dead THEN 'dead_url' WHEN availability = 'out_of_stock' THEN 'out_of_stock' WHEN availability <> 'in_stock' THEN 'availability_unknown' WHEN epoch(TIMESTAMP '{NOW}') - epoch(observed_at) > {HOURS} * 3600 THEN 'availability_stale' END"
OFFERS = f"strict AS (SELECT *, {WHY} AS why FROM products), shadow AS (SELECT * REPLACE (CASE WHEN why NOT IN ('availability_unknown', 'availability_stale') THEN why END AS why) FROM strict)"
IDENTITY = "identity AS (SELECT match_id, count(DISTINCT country_code) FILTER (NOT conflicted) > 1 AS clash, coalesce(bool_or(country_code IS NULL) FILTER (NOT conflicted), false) AS unknown FROM products GROUP BY match_id)"


@query("SELECT product_id, why IS NULL AS eligible, why AS reason FROM strict", f"{PRODUCTS}, {OFFERS}")
def offer_eligibility(spark, d):
    return lineage.offers(source.products(spark, d), AGES, NOW, enforce=True).select("product_id", "eligible", "reason")


@query("SELECT coalesce(why, 'eligible') AS reason, count(*) AS products FROM shadow GROUP BY 1", f"{PRODUCTS}, {OFFERS}")
def offer_shadow_reasons(spark, d):
    return lineage.offers(source.products(spark, d), AGES, NOW).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("products"))


@query("SELECT match_id, NOT clash AND NOT unknown AS eligible, CASE WHEN clash THEN 'country_conflict' WHEN unknown THEN 'country_unknown' END AS reason FROM identity", f"{PRODUCTS}, {IDENTITY}")
def identity_eligibility(spark, d):
    return lineage.identity_of_clusters(source.products(spark, d), enforce=True)


@query("SELECT match_id, why IS NULL AS eligible, why AS reason FROM (SELECT match_id, CASE WHEN clash THEN 'country_conflict' ELSE offer END AS why FROM identity LEFT JOIN (SELECT match_id, arg_min(why, product_id) AS offer FROM shadow WHERE why IS NOT NULL GROUP BY match_id) USING (match_id))", f"{PRODUCTS}, {OFFERS}, {IDENTITY}")
def cluster_policy(spark, d):
    return lineage.cluster_policy(source.products(spark, d), AGES, NOW)


@query("SELECT site, count(*) AS products, count(*) FILTER (availability = 'in_stock') AS in_stock FROM products WHERE tenant_id = 1 GROUP BY site", PRODUCTS)
def tenant_products(spark, d):
    own = lineage.of_tenant(source.products(spark, d), 1)
    return own.groupBy("site").agg(F.count("*").alias("products"), F.count_if(F.col("availability") == "in_stock").alias("in_stock"))
