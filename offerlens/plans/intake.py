"""Queries of what collection runs bring in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake
from ..sources import lineage as source
from ..sources.adapter import NOW, observations, table
from ..sources.shared import stored
from .literal import rows, values
from .registry import query

RUNS, PRODUCTS = source.RUNS_SQL, source.PRODUCTS_SQL
CUT = 200001


@query(f"SELECT * FROM (WITH o AS (SELECT product_id, price_cents, discount_cents FROM s WHERE run_id < {CUT} QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC, k5 DESC, k6 DESC) = 1), n AS (SELECT *, lag(price_cents) OVER w AS lp, lag(discount_cents) OVER w AS ld, row_number() OVER w AS i FROM s WHERE run_id >= {CUT} WINDOW w AS (PARTITION BY product_id ORDER BY k1, k2, k3, k4, k5, k6)) SELECT n.product_id, n.run_id, n.price_cents AS price, n.discount_cents AS discount, k2 AS orderkey FROM n LEFT JOIN o USING (product_id) WHERE CASE WHEN i > 1 THEN lp ELSE o.price_cents END IS DISTINCT FROM n.price_cents OR CASE WHEN i > 1 THEN ld ELSE o.discount_cents END IS DISTINCT FROM n.discount_cents)")
def diff_only_persist(spark, d):
    named = observations(spark, d).select("product_id", "run_id", "seq", F.col("price_cents").alias("price"), F.col("discount_cents").alias("discount"), F.expr("discount_cents * 100 div price_cents").alias("percent"), F.col("discount_cents").isNotNull().alias("on_sale"), F.lit(None).cast("string").alias("promo"))
    old = named.where(F.col("run_id") < CUT).groupBy("product_id").agg(F.max_by(F.struct(*intake.PRICE_FIELDS), "seq").alias("x")).select("product_id", "x.*")
    kept = intake.persisted(named.where(F.col("run_id") >= CUT), old)
    return kept.select("product_id", "run_id", "price", "discount", F.col("seq.l_orderkey").alias("orderkey"))


OLD = [(1, "A", "x", "", 5), (2, "B", None, "999", 6), (3, "C", "z", "888", 7)]
NEW = [(1, "A2", "", "111", 8), (2, "B", "y", "222", 9), (4, "D", "w", None, 9)]
MERGED = [(1, "A2", "x", "111", 8), (2, "B", "y", "999", 9), (3, "C", "z", "888", 7), (4, "D", "w", None, 9)]


@query(f"SELECT * FROM {values(MERGED, 'id, name, brand, barcode, seen')}", prelude=False)
def upsert_policy(spark, d):
    kind = "id int, name string, brand string, barcode string, seen int"
    return intake.upserted(rows(spark, OLD, kind), rows(spark, NEW, kind), ["id"], ["name", "seen"], ["brand"], ["barcode"])


SEEN = [(1, 1, 1, "de"), (1, 2, 2, "tr"), (1, 3, 2, "tr"), (1, 4, 3, "tr"), (2, 1, 1, "de"), (2, 2, 2, "tr"), (2, 3, 3, "fr"), (3, 1, 1, None), (4, 1, 1, "az"), (4, 2, 2, "tr"), (4, 3, 3, "az"), (5, 1, 1, None), (5, 2, 1, "it")]
STATES = [(1, "tr", "resolved", None, 0), (2, "de", "ambiguous", "fr", 1), (3, None, "unknown", None, 0), (4, "az", "resolved", None, 0), (5, "it", "resolved", None, 0)]


@query(f"SELECT * FROM {values(STATES, 'product_id, code, status, candidate, seen')}", prelude=False)
def country_promotion(spark, d):
    return intake.countries(rows(spark, SEEN, "product_id long, seq long, run_id long, code string"))


@query("q AS (SELECT product_id, ['in_stock', 'unknown', 'out_of_stock'][(k2 + k3) % 3 + 1] AS status, (k1, k2, k3, k4, k5, k6) AS k FROM s) SELECT product_id, coalesce(arg_max(status, k) FILTER (status <> 'unknown'), 'unknown') AS status FROM q GROUP BY product_id")
def explicit_stock(spark, d):
    word = F.element_at(F.array(*map(F.lit, ("in_stock", "unknown", "out_of_stock"))), F.expr("cast((seq.l_orderkey + seq.l_linenumber) % 3 as int) + 1"))
    seen = observations(spark, d).select("product_id", "seq", F.col("captured_at").alias("observed_at"), word.alias("status"))
    return intake.stock_states(seen).select("product_id", "status")


QUANTITIES = [("5", "in_stock", 5.0), ("0", "out_of_stock", 0.0), ("-1", "unknown", None), ("many", "unknown", None), (None, "unknown", None), ("0.5", "in_stock", 0.5)]


@query(f"SELECT * FROM {values(QUANTITIES, 'raw, status, quantity')}", prelude=False)
def stock_signals(spark, d):
    made = rows(spark, [r[:1] for r in QUANTITIES], "raw string")
    return made.select("raw", intake.stock_of_quantity(F.col("raw")).alias("x")).select("raw", "x.*")


RESULTS = [("a", False, 5, 5, 0, 90, 0), ("b", False, 5, 4, 1, 90, 0), ("c", True, 5, 5, 0, 90, 0), ("d", False, 0, 0, 0, 90, 0), ("e", False, 5, 5, 0, 0, 0), ("f", False, 5, 5, 0, 40, 2)]
QUALITY = [("a", "ok", "", 0.9), ("b", "degraded", "incomplete_items", 0.9), ("c", "failed", "site_fatal", 0.9), ("d", "failed", "no_items_requested", 0.9), ("e", "failed", "zero_products", 0.0), ("f", "degraded", "scraper_errors+below_baseline", 0.4), ("g", "failed", "missing_site_result", None)]


@query(f"SELECT * FROM {values(QUALITY, 'site, status, reasons, fraction')}", prelude=False)
def site_quality(spark, d):
    asked = rows(spark, [(s,) for s in "abcdefg"], "site string")
    base = rows(spark, [(s, 100) for s in "abcdefg"], "site string, baseline int")
    return intake.site_quality(rows(spark, RESULTS, "site string, fatal boolean, expected int, completed int, failed int, products int, errors int"), asked, base)


ROUTES = [("a", "r1", True, 0, 0, 3, 3, 3, None, 3), ("a", "r2", True, 0, 0, 0, 0, 0, None, 0), ("b", "r1", True, 0, 2, 5, 5, 3, None, 3), ("b", "r2", False, 1, 0, None, 4, 4, "timeout", 4), ("c", "r1", True, 0, 0, None, 0, 0, None, 0)]
VERIFIED = [("a", True, 0, 0, ""), ("b", False, 0, 2, "item_count_mismatch+item_parse_failures+pages_skipped+timeout"), ("c", False, 2, 1, "missing_route_status")]


@query(f"SELECT * FROM {values(VERIFIED, 'site, verified, zero_routes, incomplete, causes')}", prelude=False)
def catalogue_verification(spark, d):
    routes = rows(spark, ROUTES, "site string, slug string, complete boolean, skipped int, failures int, expected int, raw int, parsed int, abort_reason string, products int")
    wanted = rows(spark, [("a", "r1"), ("a", "r2"), ("b", "r1"), ("b", "r2"), ("c", "r1"), ("c", "r9")], "site string, slug string")
    results = rows(spark, [("a", 3, 0), ("b", 7, 0), ("c", 5, 0)], "site string, products int, errors int")
    return intake.verified_catalogue(wanted, routes, results, rows(spark, [("a", 3)], "site string, baseline int"))


@query("SELECT site, string_agg(category || '=' || n, ',' ORDER BY category) AS by_category FROM (SELECT site, category, count(*) AS n FROM products GROUP BY ALL) GROUP BY site", PRODUCTS)
def category_breakdown(spark, d):
    found = intake.breakdown(source.products(spark, d))
    return found.select("site", F.array_join(F.transform(F.map_entries("by_category"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("by_category"))


@query("SELECT site, arg_max(n, run_id) AS baseline FROM run_sites WHERE s = 'ok' GROUP BY site", RUNS)
def latest_ok_baseline(spark, d):
    r = source.runs(spark, d)
    counts = r.select(F.col("id").alias("run_id"), F.col("site_status").alias("st"), F.explode("site_products").alias("site", "products"))
    return intake.latest_ok_baseline(counts.select("site", "run_id", "products", F.element_at("st", F.col("site")).alias("status")))


OLD_ROUTES = "o AS (SELECT DISTINCT site, category AS slug, length(category) % 3 <> 0 AS is_active FROM s WHERE run_id < 199701), n AS (SELECT DISTINCT site, category AS slug FROM s WHERE run_id >= 200101 AND length(category) % 5 <> 0)"


@query("SELECT site, slug, CASE WHEN o.site IS NULL THEN 'added' WHEN n.site IS NOT NULL AND NOT is_active THEN 'returned' WHEN n.site IS NOT NULL THEN 'unchanged' ELSE 'missing' END AS change FROM o FULL JOIN n USING (site, slug) WHERE o.site IS NULL OR n.site IS NOT NULL OR is_active", OLD_ROUTES)
def route_sync(spark, d):
    o = observations(spark, d)
    known = o.where("run_id < 199701").select("site", F.col("category").alias("slug")).distinct().withColumn("is_active", F.length("slug") % 3 != 0)
    return intake.route_sync(known, o.where("run_id >= 200101").select("site", F.col("category").alias("slug")).where("length(slug) % 5 <> 0"))


ITEMS = "o AS (SELECT product_id AS item_id, arg_max(eff, (k1, k2, k3, k4, k5, k6)) AS price, product_id % 7 = 0 AS is_gone FROM s WHERE run_id BETWEEN 200001 AND 200006 GROUP BY product_id), n AS (SELECT product_id AS item_id, arg_max(eff, (k1, k2, k3, k4, k5, k6)) AS price FROM s WHERE run_id BETWEEN 200007 AND 200012 GROUP BY product_id)"


@query("SELECT item_id, CASE WHEN o.item_id IS NULL THEN 'new' WHEN n.item_id IS NULL THEN 'gone' WHEN is_gone THEN 'back' ELSE 'price_changed' END AS change, o.price AS before, n.price AS after FROM o FULL JOIN n USING (item_id) WHERE o.item_id IS NULL OR (n.item_id IS NULL AND NOT is_gone) OR (n.item_id IS NOT NULL AND (is_gone OR o.price <> n.price))", ITEMS)
def marketplace_changes(spark, d):
    from ..operators.prices import with_effective

    last = lambda a, z: with_effective(observations(spark, d).where(F.col("run_id").between(a, z))).groupBy(F.col("product_id").alias("item_id")).agg(F.max_by("eff", "seq").alias("price"))
    return intake.store_changes(last(200001, 200006).withColumn("is_gone", F.expr("item_id % 7 = 0")), last(200007, 200012))


@query(f"SELECT id, CASE WHEN status = 'running' AND epoch(TIMESTAMP '{NOW}') - epoch(started_at) > 43200 THEN 'failed' ELSE status END AS status, finished_at IS NULL AND status <> 'running' AS open, eligible_flag AND NOT (status = 'running' AND epoch(TIMESTAMP '{NOW}') - epoch(started_at) > 43200) AS eligible_flag FROM runs", RUNS)
def reaped_runs(spark, d):
    return intake.reaped(source.runs(spark, d), NOW).select("id", "status", F.col("finished_at").isNull().alias("open"), "eligible_flag")


@query("SELECT page_id, url FROM pages WHERE page_id % 4 <> 1 AND lower(regexp_replace(url, '[?#].*$|/+$', '')) NOT IN (SELECT lower(regexp_replace(url, '[?#].*$|/+$', '')) FROM pages WHERE page_id % 9 = 2)", prelude=False)
def without_pending(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("external_id"), "url")
    pending = pages.where("page_id % 4 = 1").select("external_id", F.lit(None).cast("string").alias("url")).unionByName(pages.where("page_id % 9 = 2").select(F.lit(None).cast("string").alias("external_id"), F.upper("url").alias("url")))
    return intake.without_pending(pages, pending).select("page_id", "url")


@query("SELECT count(*) FILTER (CASE WHEN product_id % 10 = 1 THEN true WHEN product_id % 10 = 2 THEN false ELSE dead END) AS dead, count(*) AS products FROM products", PRODUCTS)
def link_states(spark, d):
    p = source.products(spark, d)
    status = F.when(F.expr("product_id % 10 = 1"), 404).when(F.expr("product_id % 10 = 2"), 200).otherwise(503)
    return intake.link_states(p, p.select("product_id", status.alias("http_status")))[0].agg(F.count_if("dead").alias("dead"), F.count("*").alias("products"))


@query("SELECT p_partkey AS external_id, 'first' AS source FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'second' FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0", prelude=False)
def with_fallback(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("external_id"))
    return intake.with_fallback(part.where("external_id % 3 <> 0").withColumn("source", F.lit("first")), part.where("external_id % 2 = 0").withColumn("source", F.lit("second")))


LINKS = [(1, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "d"), (2, "e"), (5, "e")]
REACHED = [("p:1",), ("e:a",), ("e:b",), ("p:2",), ("e:e",), ("p:5",)]


@query(f"SELECT * FROM {values(REACHED, 'node')}", prelude=False)
def isolated_identities(spark, d):
    return intake.isolated(rows(spark, LINKS, "product int, external string"), rows(spark, [("p:1",)], "node string"), stored)
