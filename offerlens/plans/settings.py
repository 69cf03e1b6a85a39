"""Queries of settings, seeds and standing, over what follows from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import health, intake, settings
from ..sources import seeds
from ..sources.adapter import CLIENT, NOW, SITES, events, table
from ..sources.lineage import PRODUCTS_SQL, RUNS_SQL, products, runs
from ..sources.listings import LISTINGS_SQL, listings
from ..sources.shared import shared_folder, stored
from .lineage import AGES, HOURS, SITE_ROWS
from .registry import query

LISTED = f"{PRODUCTS_SQL},{LISTINGS_SQL}"

# Every part is a category: its name in words is the label, and its numbers are the sections of two sites.
CATEGORY = """cats AS (
    SELECT p_partkey AS id, p_size % 4 <> 0 AS is_active, CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'all' WHEN p_partkey % 7 = 0 THEN '' ELSE 'c-' || p_partkey END END AS client_slug,
           CASE p_partkey % 4 WHEN 0 THEN 'filter=' || p_partkey WHEN 1 THEN 'all' WHEN 2 THEN 'a-' || p_partkey END AS rival_a_slug FROM part),
routes AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'rival_b' ELSE 'client' END AS site, 'r-' || p_partkey AS slug, p_size % 3 <> 0 AS is_active FROM part)"""
BROAD = {"rival_a": ("all", "kosmetika")}


def categories(spark, d):
    n = F.col("p_partkey")
    client = F.when(n % 3 != 0, F.when(n % 5 == 0, "all").when(n % 7 == 0, "").otherwise(F.concat(F.lit("c-"), n)))
    rival = F.when(n % 4 == 0, F.concat(F.lit("filter="), n)).when(n % 4 == 1, "all").when(n % 4 == 2, F.concat(F.lit("a-"), n))
    return table(spark, d, "part").select(n.alias("id"), (F.col("p_size") % 4 != 0).alias("is_active"), client.alias("client_slug"), rival.alias("rival_a_slug"))


@query("SELECT site, slug, rank, id FROM (SELECT 'client' AS site, client_slug AS slug, 1 AS rank, id FROM cats WHERE is_active UNION ALL SELECT 'rival_a', rival_a_slug, CASE WHEN id % 4 = 2 THEN 1 ELSE 0 END, id FROM cats WHERE is_active UNION ALL SELECT site, slug, 1, id FROM routes WHERE is_active AND site = 'rival_b') WHERE slug <> ''", CATEGORY)
def sections_to_visit(spark, d):
    n = F.col("p_partkey")
    routes = table(spark, d, "part").select(n.alias("id"), F.when(F.col("p_size") % 2 == 0, "rival_b").otherwise("client").alias("site"), F.concat(F.lit("r-"), n).alias("slug"), (F.col("p_size") % 3 != 0).alias("is_active"))
    return settings.sections_to_visit(categories(spark, d), routes, SITES, BROAD)


@query("SELECT regexp_replace(p_brand, '.*#', '') AS brand, 'part-' || p_partkey AS key, CASE p_size % 3 WHEN 0 THEN 'part-' || p_partkey ELSE p_name END AS label_ru, CASE WHEN p_size % 2 = 0 THEN 'it''s ' || p_size || ' # ' END AS label_az, 'c-' || p_partkey AS client_slug, CASE WHEN p_size % 5 <> 0 THEN 'a:' || p_size END AS rival_a_slug FROM part", prelude=False)
def seeded_categories(spark, d):
    """A seed file a brand, with comments, quotes, empty values and keys that hold no block, written and read again."""
    folder = f"{shared_folder(spark)}/offerlens-seeds-{uuid.uuid4().hex}"
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    n, size = F.col("p_partkey"), F.col("p_size")
    label = F.when(size % 3 == 0, "").when(size % 3 == 1, say('"', F.col("p_name"), '" # said')).otherwise(F.col("p_name"))
    block = say("  part-", n, ":\n    label_ru: ", label, "\n\n    label_az: ", F.when(size % 2 == 0, say('"it\'s ', size, ' # "')).otherwise(F.lit("null")), "\n    # a comment: no value\n    client: 'c-", n, "'\n    rival_a: ", F.when(size % 5 != 0, say("a:", size)).otherwise(F.lit("~")))
    files = table(spark, d, "part").select(F.regexp_replace("p_brand", ".*#", "").alias("brand"), block.alias("block")).groupBy("brand").agg(F.array_join(F.array_sort(F.collect_list("block")), "\n").alias("blocks"))
    whole = say("# seeds\nothers:\n  part-0:\n    label_ru: no\ncategories:\n  part-0: none\n", F.col("blocks"), "\nlast: 1\n")
    files.select("brand", whole.alias("value")).write.partitionBy("brand").text(folder)
    read = seeds.category_seeds(spark, folder, ("client", "rival_a"))
    return read.select(F.regexp_extract("file", "brand=([^/]*)/", 1).alias("brand"), "key", "label_ru", "label_az", "client_slug", "rival_a_slug")


def edited(spark, d):
    """The client's products, where every third has a category by hand, and edits: of every second listing two, with keys known and not."""
    p = stored(listings(spark, d).select("product_id", "tenant_id", "site", "name", "dead", "category", F.when(F.col("product_id") % 9 == 0, "by_hand").alias("manual_key")))
    n = F.col("product_id")
    key = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, "vitamins").when(n % 5 == 2, F.col("category")).when(n % 5 == 3, "nothing").otherwise("cosmetics")
    first = p.where(n % 2 == 0).select((n * 2).alias("seq"), "tenant_id", "product_id", key.alias("category_key"))
    second = p.where(n % 4 == 0).select((n * 2 + 1).alias("seq"), "tenant_id", "product_id", F.when(n % 3 == 0, "vitamins").when(n % 3 == 1, "no such").alias("category_key"))
    return p, first.unionByName(second), spark.createDataFrame([("vitamins",), ("cosmetics",)], "key string")


EDITS = f"""{LISTED},
edits AS (
    SELECT product_id * 2 AS seq, tenant_id, product_id, CASE product_id % 5 WHEN 1 THEN 'vitamins' WHEN 2 THEN category WHEN 3 THEN 'nothing' WHEN 4 THEN 'cosmetics' END AS category_key FROM listings WHERE product_id % 2 = 0
    UNION ALL SELECT product_id * 2 + 1, tenant_id, product_id, CASE product_id % 3 WHEN 0 THEN 'vitamins' WHEN 1 THEN 'no such' END FROM listings WHERE product_id % 4 = 0),
outcomes AS (
    SELECT e.*, CASE WHEN category_key NOT IN ('vitamins', 'cosmetics') AND NOT EXISTS (SELECT 1 FROM listings l WHERE l.site = 'client' AND l.tenant_id = e.tenant_id AND l.category = e.category_key) THEN 'unknown_category'
           WHEN NOT EXISTS (SELECT 1 FROM listings l WHERE l.site = 'client' AND l.product_id = e.product_id AND l.tenant_id = e.tenant_id) THEN 'no_product' WHEN category_key IS NULL THEN 'cleared' ELSE 'set' END AS outcome FROM edits e)"""


@query("SELECT * FROM outcomes", EDITS)
def category_edits(spark, d):
    return settings.category_edits(*edited(spark, d), CLIENT)


@query("SELECT product_id, site, CASE WHEN outcome IS NULL THEN CASE WHEN product_id % 9 = 0 THEN 'by_hand' END ELSE category_key END AS manual_key FROM listings LEFT JOIN (SELECT product_id, category_key, outcome FROM outcomes WHERE outcome IN ('set', 'cleared') QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq DESC) = 1) USING (product_id)", EDITS)
def categories_by_hand(spark, d):
    p, edits, canonical = edited(spark, d)
    return settings.categorized(p, settings.category_edits(p, edits, canonical, CLIENT), CLIENT).select("product_id", "site", "manual_key")


@query("SELECT product_id, name, category, CASE WHEN product_id % 9 = 0 THEN 'by_hand' END AS manual_key FROM listings WHERE tenant_id = 1 AND site = 'client' AND NOT dead AND name ILIKE '%WIDGET%' ORDER BY name, product_id LIMIT 30", LISTED)
def suggested_products(spark, d):
    p = listings(spark, d).withColumn("manual_key", F.when(F.col("product_id") % 9 == 0, "by_hand"))
    return settings.suggested_products(p, " WIDGET ", CLIENT, limit=99)


# Nations are tenants; their suppliers set thresholds, their customers' wishes are gaps.
CONFIGS = """tenants AS (SELECT n_nationkey AS tenant_id FROM nation),
configs AS (SELECT n_nationkey AS tenant_id, 100 + n_nationkey * 10 AS raise_bp, CASE WHEN n_nationkey % 2 = 0 THEN 200 END AS undercut_bp, 6000 AS spread_bp, 1000 AS margin_bp, 3 + n_nationkey % 4 AS per_type FROM nation WHERE n_nationkey % 3 <> 0),
limits AS (SELECT tenant_id, coalesce(raise_bp, 500) AS raise_bp, coalesce(undercut_bp, 300) AS undercut_bp, coalesce(spread_bp, 8000) AS spread_bp, coalesce(margin_bp, 1000) AS margin_bp, coalesce(per_type, 10) AS per_type FROM tenants LEFT JOIN configs USING (tenant_id))"""


def configs(spark, d):
    n = F.col("n_nationkey")
    nation = table(spark, d, "nation")
    made = nation.where(n % 3 != 0).select(n.cast("long").alias("tenant_id"), (100 + n * 10).cast("long").alias("raise_bp"), F.when(n % 2 == 0, F.lit(200)).cast("long").alias("undercut_bp"), F.lit(6000).cast("long").alias("spread_bp"), F.lit(1000).cast("long").alias("margin_bp"), (3 + n % 4).cast("long").alias("per_type"))
    return made, nation.select(n.cast("long").alias("tenant_id"))


@query("SELECT tenant_id, CASE WHEN rival > client THEN 'price_raise' ELSE 'undercut' END AS type, row_number() OVER w AS rank, match_id, gap_bp FROM (SELECT *, abs(rival - client) * 10000 // client AS gap_bp FROM (SELECT match_id % 25 AS tenant_id, match_id, client, least(rival_a, rival_b) AS rival FROM m) WHERE client > 0 AND rival > 0 AND rival <> client) JOIN limits USING (tenant_id) WHERE gap_bp < spread_bp AND gap_bp >= CASE WHEN rival > client THEN raise_bp ELSE undercut_bp END WINDOW w AS (PARTITION BY tenant_id, rival > client ORDER BY gap_bp DESC, match_id) QUALIFY rank <= per_type", CONFIGS)
def actions_by_thresholds(spark, d):
    from ..operators import prices
    from ..sources.adapter import observations

    m = prices.latest_by_match(observations(spark, d)).select((F.col("match_id") % 25).alias("tenant_id"), "match_id", F.col(CLIENT).alias("client"), F.least("rival_a", "rival_b").alias("rival"))
    return settings.within_thresholds(m, settings.thresholds(*configs(spark, d)))


CHANGED = f"{CONFIGS}, cut AS (SELECT s_nationkey AS tenant_id, s_suppkey AS seq, s_suppkey AS raise_bp, s_suppkey + 1 AS undercut_bp, 7000 AS spread_bp, 900 AS margin_bp, 5 AS per_type FROM supplier WHERE s_nationkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) = 1), after AS (SELECT * EXCLUDE (seq) FROM cut UNION ALL SELECT * FROM configs WHERE tenant_id NOT IN (SELECT tenant_id FROM cut))"


@query("SELECT 'thresholds' AS what, tenant_id, raise_bp, undercut_bp, per_type, 1 AS n FROM after UNION ALL SELECT 'kept lists', c_nationkey, NULL, NULL, NULL, count(*) FROM customer WHERE c_nationkey NOT IN (SELECT tenant_id FROM cut) GROUP BY c_nationkey", CHANGED)
def reconfigured_tenants(spark, d):
    """Suppliers of nations with odd keys set new thresholds; customers stand for lists that were kept."""
    n, s = F.col("s_nationkey"), F.col("s_suppkey").cast("long")
    edits = table(spark, d, "supplier").where(n % 2 == 1).select(n.cast("long").alias("tenant_id"), s.alias("seq"), s.alias("raise_bp"), (s + 1).alias("undercut_bp"), F.lit(7000).cast("long").alias("spread_bp"), F.lit(900).cast("long").alias("margin_bp"), F.lit(5).cast("long").alias("per_type"))
    cache = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("tenant_id"), "c_custkey")
    now, kept = settings.reconfigured(configs(spark, d)[0], edits, cache)
    none = F.lit(None).cast("long")
    one = now.select(F.lit("thresholds").alias("what"), "tenant_id", "raise_bp", "undercut_bp", "per_type", F.lit(1).cast("long").alias("n"))
    return one.unionByName(kept.groupBy("tenant_id").agg(F.count("*").alias("n")).select(F.lit("kept lists").alias("what"), "tenant_id", none.alias("raise_bp"), none.alias("undercut_bp"), none.alias("per_type"), "n"))


TENANT_ROWS = {"runs": ("orders", "o_custkey % 60", "o_orderkey % 5 = 0"), "categories": ("supplier", "s_nationkey", "true"), "products": ("customer", "c_custkey % 31", "true"), "tracked": ("customer", "c_nationkey", "c_custkey % 7 = 0")}
STANDING = "standing AS (SELECT c_custkey % 70 AS tenant_id FROM customer GROUP BY 1)"
HAS = ", ".join(f"tenant_id IN (SELECT {key} FROM {t} WHERE {where}) AS has_{n}" for n, (t, key, where) in TENANT_ROWS.items())


@query(f"SELECT *, CASE WHEN NOT has_runs AND NOT has_categories AND NOT has_products THEN 'empty_db' WHEN NOT has_categories AND NOT has_tracked THEN 'need_categories' WHEN NOT has_recipients THEN 'need_recipients' ELSE 'ready' END AS state FROM (SELECT tenant_id, {HAS}, tenant_id IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 8000) AS has_recipients FROM standing)", STANDING)
def onboarding_states(spark, d):
    """Numbers stand for tenants; rows of several tables that name them, for what they have."""
    parts = {n: table(spark, d, t).where(where).select(F.expr(key).alias("tenant_id")) for n, (t, key, where) in TENANT_ROWS.items()}
    customers = table(spark, d, "customer")
    parts["recipients"] = customers.select(F.col("c_nationkey").alias("tenant_id"), (F.col("c_acctbal") > 8000).alias("is_active"))
    return settings.onboarding(customers.select((F.col("c_custkey") % 70).alias("tenant_id")), parts)


@query("SELECT tenant_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, arg_min(event_id, (ts, event_id)) FILTER (status = 'pending') AS oldest_id, strftime(min(ts) FILTER (status = 'pending'), '%Y-%m-%d %H:%M:%S') AS oldest_at FROM (SELECT user_id % 20 AS tenant_id, event_id, ts, CASE event_id % 3 WHEN 0 THEN CASE WHEN user_id % 20 <> 7 THEN 'pending' END WHEN 1 THEN 'running' ELSE 'done' END AS status FROM events) GROUP BY tenant_id", prelude=False)
def request_queues(spark, d):
    n = F.col("event_id")
    asked = events(spark, d).select((F.col("user_id") % 20).alias("tenant_id"), n.alias("id"), F.when(n % 3 == 0, F.when(F.col("user_id") % 20 != 7, "pending")).when(n % 3 == 1, "running").otherwise("done").alias("status"), F.col("ts").alias("requested_at"))
    return settings.queues(asked).select("tenant_id", "pending", "running", "oldest_id", F.date_format("oldest_at", "yyyy-MM-dd HH:mm:ss").alias("oldest_at"))


@query(f"SELECT site, strftime(max(last_seen_at), '%Y-%m-%d') AS last_seen, CAST(epoch(TIMESTAMP '{NOW}') - epoch(max(last_seen_at)) AS BIGINT) AS seconds, {HOURS} AS hours, epoch(TIMESTAMP '{NOW}') - epoch(max(last_seen_at)) > {HOURS} * 3600 AS stale FROM products GROUP BY site", PRODUCTS_SQL)
def site_staleness(spark, d):
    return health.staleness(products(spark, d), AGES, NOW).select("site", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"), "seconds", "hours", "stale")


SNAPSHOT = f"""{RUNS_SQL},{PRODUCTS_SQL},{SITE_ROWS},
tried AS (SELECT a.site, e.*, e.status = 'ok' AND e.verified AND e.eligible_flag AND coalesce((SELECT s = 'ok' FROM run_sites r WHERE r.run_id = e.id AND r.site = a.site), false) AS well FROM attempts a JOIN elig e ON e.id = a.run_id),
last_run AS (SELECT id, status FROM runs WHERE tenant_id = 1 AND status <> 'running' AND finished_at IS NOT NULL ORDER BY finished_at DESC, id DESC LIMIT 1),
old AS (SELECT bool_or(stale) AS stale FROM (SELECT epoch(TIMESTAMP '{NOW}') - epoch(max(last_seen_at)) > {HOURS} * 3600 AS stale FROM products GROUP BY site)),
full_state AS (SELECT count(*) = 3 AND bool_and(well) AS verified, count(*) = 3 AND bool_and(eligible) AS complete, CASE WHEN count(*) = 0 THEN 'missing' WHEN bool_or(status = 'failed') THEN 'failed' WHEN count(*) = 3 AND bool_and(well) THEN 'ok' ELSE 'degraded' END AS full_status, max(coalesce(finished_at, started_at)) AS ended FROM tried)"""


@query("SELECT CASE WHEN stale OR l.status IN ('degraded', 'failed') OR NOT verified OR NOT complete THEN 'degraded' ELSE 'up' END AS status, l.id AS last_run_id, l.status AS last_run_status, stale, full_status, verified, complete AS source_complete, strftime(ended, '%Y-%m-%d') AS full_ended, (SELECT count(*) FROM products WHERE tenant_id = 1 AND conflicted) AS apart, (SELECT count(*) FROM products WHERE tenant_id = 1 AND NOT conflicted) AS trusted FROM full_state, old, last_run l", SNAPSHOT)
def health_snapshot(spark, d):
    s = health.snapshot(runs(spark, d), products(spark, d), SITES, AGES, NOW)
    return s.withColumn("full_ended", F.date_format("full_ended_at", "yyyy-MM-dd")).drop("full_ended_at")


# A site numbers countries in its own way: numbers that products carry, and what their pages say.
SAID = f"""{LISTED},
said_now AS (SELECT tenant_id, CAST(match_id % 53 AS VARCHAR) AS country_id, product_id AS seq, upper(country_code) AS code, CASE product_id % 6 WHEN 0 THEN '  ' ELSE ' ' || upper(country_code) || ' ' || product_id % 2 END AS raw, CASE WHEN product_id % 11 <> 0 THEN url END AS url, product_id % 4 AS samples FROM listings WHERE site = 'rival_a'),
dictionary AS (SELECT DISTINCT ON (tenant_id, country_id) tenant_id, country_id, lower(code) AS country_code, trim(raw) AS country_raw, url AS source_url, 1 + seq % 3 AS version FROM said_now WHERE code IS NOT NULL AND trim(raw) <> '' AND CAST(country_id AS INT) % 3 <> 0 AND url IS NOT NULL ORDER BY tenant_id, country_id, seq DESC),
steps AS (
    SELECT *, (country_code, country_raw) IS DISTINCT FROM lag((country_code, country_raw)) OVER (PARTITION BY tenant_id, country_id ORDER BY seq) AS differs FROM (
        SELECT tenant_id, country_id, -1 AS seq, country_code, country_raw, source_url, 1 AS samples, version FROM dictionary
        UNION ALL SELECT tenant_id, country_id, seq, lower(code), trim(raw), url, CASE samples WHEN 0 THEN 1 ELSE samples END, NULL FROM said_now WHERE code IS NOT NULL AND trim(raw) <> '' AND url IS NOT NULL))"""


@query("SELECT tenant_id, country_id, arg_max(country_code, seq) FILTER (differs) AS country_code, arg_max(country_raw, seq) FILTER (differs) AS country_raw, arg_max(source_url, seq) FILTER (differs) AS source_url, arg_max(samples, seq) FILTER (differs) AS sample_count, coalesce(max(version), 0) + count(*) FILTER (differs AND seq >= 0) AS version, bool_or(differs AND seq >= 0) AS changed FROM steps GROUP BY tenant_id, country_id", SAID)
def country_dictionary(spark, d):
    """A dictionary from each number's last page, and then every page in order again."""
    n = F.col("product_id")
    p = stored(listings(spark, d).where("site = 'rival_a'").select("tenant_id", (F.col("match_id") % 53).cast("string").alias("country_id"), n.alias("seq"), F.upper("country_code").alias("country_code"), F.when(n % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("country_code"), F.lit(" "), n % 2)).alias("country_raw"), F.when(n % 11 != 0, F.col("url")).alias("source_url"), (n % 4).alias("sample_count")))
    good = p.where("trim(country_raw) <> '' and country_code is not null and source_url is not null and int(country_id) % 3 <> 0")
    known = good.groupBy("tenant_id", "country_id").agg(F.max_by(F.struct(F.lower("country_code").alias("country_code"), F.trim("country_raw").alias("country_raw"), "source_url", (1 + F.col("seq") % 3).alias("version")), "seq").alias("r"))
    return intake.country_dictionary(known.select("tenant_id", "country_id", "r.*", F.lit(1).cast("long").alias("sample_count")), p)


BOUND = f"""{LISTED},
held AS (SELECT CAST(product_id AS VARCHAR) AS external_id, CASE WHEN product_id % 13 <> 0 THEN 'https://x/' || product_id END AS url, tenant_id FROM products),
sent AS (SELECT DISTINCT CAST(CASE product_id % 10 WHEN 3 THEN product_id + 30 ELSE product_id END AS VARCHAR) AS external_id, CASE product_id % 10 WHEN 4 THEN NULL WHEN 5 THEN 'https://x/new/' || product_id // 40 ELSE 'https://x/' || product_id END AS url FROM products WHERE site = 'client')"""


@query("SELECT DISTINCT external_id, url, fault FROM (SELECT external_id, url, CASE WHEN url IS NULL OR (external_id IN (SELECT external_id FROM sent WHERE url IS NOT NULL GROUP BY 1 HAVING count(*) > 1) AND url IS NOT NULL) OR url IN (SELECT url FROM sent WHERE url IS NOT NULL GROUP BY 1 HAVING count(*) > 1) THEN 'ambiguous' END AS fault FROM sent UNION ALL SELECT s.external_id, s.url, 'rebound' FROM sent s JOIN held h USING (external_id) WHERE h.tenant_id <> 1 OR h.url <> s.url UNION ALL SELECT s.external_id, s.url, 'taken' FROM sent s JOIN held h USING (url) WHERE h.tenant_id <> 1 OR h.external_id <> s.external_id) WHERE fault IS NOT NULL", BOUND)
def continuity_faults(spark, d):
    """A partial batch of the client's products: most as they are known, some with the id or address of another, a new one or none."""
    p = stored(products(spark, d).select("product_id", "site", "tenant_id"))
    n, at = F.col("product_id"), F.concat(F.lit("https://x/"), F.col("product_id"))
    held = p.select(n.cast("string").alias("external_id"), F.when(n % 13 != 0, at).alias("url"), "tenant_id")
    sent = p.where(F.col("site") == CLIENT).select(F.when(n % 10 == 3, n + 30).otherwise(n).cast("string").alias("external_id"), F.when(n % 10 == 5, F.concat(F.lit("https://x/new/"), F.expr("product_id div 40"))).when(n % 10 != 4, at).alias("url"))
    return intake.continuity_faults(sent, held, 1, r"^\d+$")
