"""What scans bring and how it is told, over what follows from the test tables; the oracles work from what the rows were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health, intake, marketplace, taxonomy
from ..sources.adapter import CLIENT, table
from ..sources.lineage import PRODUCTS_SQL, RUNS_SQL, products, runs
from ..sources.shared import stored
from .registry import query

# A result of every run and site; a few runs are asked for sites that gave none.
QUALITY = f"""{RUNS_SQL},
results AS (SELECT run_id || '-' || site AS site, run_id % 17 = 0 AS fatal, run_id % 4 + length(site) % 2 AS expected, run_id % 4 AS completed, run_id % 6 // 5 AS failed, CASE WHEN run_id % 10 = 9 THEN 0 ELSE n END AS products, run_id % 5 // 4 AS errors, n * (1 + run_id % 3) AS baseline FROM run_sites),
asked AS (SELECT site FROM results UNION ALL SELECT 'lost-' || run_id FROM run_sites WHERE run_id % 12 = 0 GROUP BY run_id),
why AS (SELECT a.site, r.*, CASE WHEN r.site IS NULL THEN 'missing_site_result' WHEN fatal THEN 'site_fatal' WHEN expected = 0 THEN 'no_items_requested' WHEN products = 0 THEN 'zero_products' END AS grave,
        concat_ws('+', CASE WHEN failed > 0 OR completed < expected THEN 'incomplete_items' END, CASE WHEN errors > 0 THEN 'scraper_errors' END, CASE WHEN baseline > 0 AND products * 2 < baseline THEN 'below_baseline' END) AS weak FROM asked a LEFT JOIN results r USING (site))"""


@query("SELECT site, CASE WHEN grave IS NOT NULL THEN 'failed' WHEN weak <> '' THEN 'degraded' ELSE 'ok' END AS status, coalesce(grave, weak) AS reasons, CAST(products AS DOUBLE) / baseline AS fraction FROM why", QUALITY)
def quality_of_runs(spark, d):
    """Every site of every run judged by what it was asked for, what came and what came before."""
    r = runs(spark, d).select("id", F.explode("site_products").alias("at", "n"))
    name = F.concat_ws("-", F.col("id").cast("string"), "at")
    results = r.select(name.alias("site"), (F.col("id") % 17 == 0).alias("fatal"), (F.col("id") % 4 + F.length("at") % 2).alias("expected"), (F.col("id") % 4).alias("completed"), F.expr("id % 6 div 5").alias("failed"), F.when(F.col("id") % 10 == 9, 0).otherwise(F.col("n")).alias("products"), F.expr("id % 5 div 4").alias("errors"))
    base = r.select(name.alias("site"), (F.col("n") * (1 + F.col("id") % 3)).alias("baseline"))
    asked = results.select("site").union(r.where("id % 12 = 0").select(F.concat(F.lit("lost-"), "id")).distinct())
    return intake.site_quality(results, asked, base)


# A route is a category of a brand; its figures follow from how many products it has.
ROUTES = f"""{PRODUCTS_SQL},
counted AS (SELECT brand AS site, category || '-' || site AS slug, count(*) AS n, sum(match_id) % 29 AS k FROM products GROUP BY ALL),
routes AS (SELECT site, slug, CASE WHEN k <> 7 THEN true END AS complete, CASE k WHEN 11 THEN 1 ELSE 0 END AS skipped, CASE k WHEN 13 THEN 2 ELSE 0 END AS failures, CASE WHEN k % 2 = 0 THEN n END AS expected, CASE k WHEN 14 THEN n + 1 ELSE n END AS raw, n AS parsed, CASE k WHEN 17 THEN 'timeout' END AS abort_reason, CASE k WHEN 19 THEN 0 ELSE n END AS products FROM counted WHERE k <> 23),
judged AS (
    SELECT c.site, r.site IS NULL OR r.products = 0 AS zero,
           CASE WHEN r.complete IS NULL THEN ['missing_route_status'] WHEN skipped > 0 THEN ['pages_skipped'] WHEN failures > 0 THEN ['item_parse_failures'] WHEN expected IS NOT NULL AND raw <> expected THEN ['item_count_mismatch'] ELSE [] END AS causes
    FROM counted c LEFT JOIN routes r USING (site, slug)),
by_site AS (SELECT site, count(*) FILTER (zero) AS zero_routes, count(*) FILTER (len(causes) > 0) AS incomplete, array_to_string(list_sort(list_distinct(flatten(list(causes)))), '+') AS causes FROM judged GROUP BY site)"""


@query("SELECT site, zero_routes = 0 AND incomplete = 0 AND site NOT LIKE '%3' AS verified, zero_routes, incomplete, causes FROM by_site", ROUTES)
def verification_of_brands(spark, d):
    """Brands seen as sites of which every route has to be whole; those that end in 3 had errors."""
    c = stored(products(spark, d).groupBy(F.col("brand").alias("site"), F.concat_ws("-", "category", "site").alias("slug")).agg(F.count("*").alias("n"), (F.sum("match_id") % 29).alias("k")))
    k, n = F.col("k"), F.col("n")
    routes = c.where("k <> 23").select("site", "slug", F.when(k != 7, True).alias("complete"), F.when(k == 11, 1).otherwise(0).alias("skipped"), F.when(k == 13, 2).otherwise(0).alias("failures"), F.when(k % 2 == 0, n).alias("expected"), F.when(k == 14, n + 1).otherwise(n).alias("raw"), n.alias("parsed"), F.when(k == 17, "timeout").alias("abort_reason"), F.when(k == 19, 0).otherwise(n).alias("products"))
    total = c.groupBy("site").agg(F.sum("n").alias("products")).withColumn("errors", F.col("site").endswith("3").cast("int"))
    return intake.verified_catalogue(c.select("site", "slug"), routes, total, total.select("site", (F.col("products") * 1.1).cast("long").alias("baseline")))


# A venue's page holds the parts of twenty products in order; the last of them stands on a page of its own too, with another price.
ITEMS = f"""{PRODUCTS_SQL},
placed AS (SELECT site, product_id, match_id, name, price_cents, count(*) OVER w AS n, product_id = max(product_id) OVER w AS last FROM products WINDOW w AS (PARTITION BY site, match_id // 20))"""


@query("SELECT site AS venue, CAST(product_id AS VARCHAR) AS item_id, name, price_cents + (CASE WHEN last AND n > 1 THEN 1 ELSE 0 END) AS price_cents, CASE WHEN match_id % 3 = 0 THEN price_cents + 500 END AS original_cents, match_id % 4 <> 0 AS in_stock FROM placed WHERE match_id % 9 <> 0 OR (last AND n > 1)", ITEMS)
def items_of_venues(spark, d):
    n = F.col("match_id")
    p = products(spark, d).select("site", "product_id", n, (n / 20).cast("int").alias("page"), "name", "price_cents")
    item = lambda price: F.struct(F.col("product_id").cast("string").alias("id"), F.concat(F.lit(" "), F.replace("name", F.lit(" "), F.lit(" \n ")), F.lit(" ")).alias("name"), price.alias("price"), F.when(n % 3 == 0, F.col("price_cents") + 500).when(n % 3 == 1, 1).alias("original_price"), F.when(n % 4 == 0, 0).when(n % 4 == 1, 2).alias("purchasable_balance"))
    made = p.select("site", "page", "product_id", item(F.when(n % 9 == 0, 0).otherwise(F.col("price_cents"))).alias("i"), item(F.col("price_cents") + 1).alias("again"))
    page = made.groupBy("site", "page").agg(F.array_sort(F.collect_list(F.struct("product_id", "i"))).alias("rows"), F.max_by("again", "product_id").alias("again"))
    body = lambda items: F.to_json(F.struct(items.alias("items")))
    first = page.select(F.col("site").alias("venue"), body(F.col("rows.i")).alias("body"))
    return marketplace.items(first.union(page.where(F.size("rows") > 1).select("site", body(F.array("again")))))


# Names of letters stand for clusters, so that names of two are never alike; forms tell some venues apart.
OFFERED = f"""{PRODUCTS_SQL},
offered AS (SELECT match_id, site AS venue, any_value(price_cents) AS price_cents, bool_or(match_id % 8 <> 0 OR site <> 'rival_a') AS in_stock, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY match_id, site) AS c FROM products) WHERE c = 1 AND NOT (match_id % 5 = 0 AND site = 'client') GROUP BY match_id, site),
grouped AS (SELECT * FROM offered WHERE match_id % 7 <> 0 OR match_id % 5 = 0 QUALIFY count(*) FILTER (venue <> 'client') OVER (PARTITION BY match_id) >= 2)"""


@query("SELECT match_id, count(*) FILTER (rival) AS venues, min(price_cents) FILTER (rival) AS low, max(price_cents) FILTER (rival) AS high, arg_min(venue, (price_cents, venue)) FILTER (rival) AS cheapest, max(price_cents) FILTER (venue = 'client') AS owner_price FROM (SELECT *, in_stock AND venue <> 'client' AS rival FROM grouped) GROUP BY match_id HAVING count(*) FILTER (rival) >= 2 AND max(price_cents) FILTER (rival) <= 3 * min(price_cents) FILTER (rival)", OFFERED)
def comparison_of_venues(spark, d):
    """One row a cluster that two venues have; of every fifth the owner, of every seventh a venue sells another form."""
    n, at = F.col("match_id"), F.col("site")
    form = F.when((n % 5 == 0) & (at == CLIENT), " krem").when(n % 5 == 0, " gel").when((n % 7 == 0) & (at == "rival_a"), " krem").when(n % 7 == 0, " gel").otherwise(" gel")
    word = F.regexp_replace(F.translate(n.cast("string"), "0123456789", "bdfglmnrpt"), "(.)", "$1a")
    made = stored(products(spark, d).select(at.alias("venue"), F.col("product_id").cast("string").alias("item_id"), F.concat(F.lit("zu"), word, form, F.lit(" 500 mq N20")).alias("name"), "price_cents", ((n % 8 != 0) | (at != "rival_a")).alias("in_stock"), n))
    members = stored(marketplace.groups(made, (CLIENT,)))
    named = members.join(made, ["venue", "item_id"]).groupBy("group").agg(F.min("match_id").alias("match_id"))
    return marketplace.comparison(members, made, CLIENT).join(named, "group").drop("group")


@query("SELECT strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS moment, CASE WHEN sig IS NULL THEN 'recovery' WHEN sig = before THEN 'reminder' ELSE 'incident' END AS step FROM (SELECT finished_at, sig, lag(sig) OVER (ORDER BY finished_at) AS before FROM (SELECT finished_at, CASE WHEN status <> 'ok' THEN id // 100 || status END AS sig FROM runs WHERE finished_at IS NOT NULL)) WHERE sig IS NOT NULL OR before IS NOT NULL", RUNS_SQL)
def incidents_of_runs(spark, d):
    """What the state of each run, told as it ends, comes to: runs are a month apart, so that what goes on is told again."""
    r = runs(spark, d).where("finished_at is not null").select(F.col("finished_at").alias("at"), F.when(F.col("status") != "ok", F.concat(F.expr("string(id div 100)"), "status")).alias("signature"))
    return health.incident_steps(r).select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("moment"), "step")


LABELS = "cats AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'a_' || p_size ELSE 'k' || p_partkey END AS key, p_partkey % 5 <> 0 AS is_active, p_name AS label_ru, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS label_az, CAST(p_size AS VARCHAR) AS a_slug, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_type END AS b_slug FROM part), each AS (SELECT 'site_a' AS site, a_slug AS slug, key = 'a_' || a_slug AS own, * FROM cats UNION ALL SELECT 'site_b', b_slug, key = 'b_' || b_slug, * FROM cats)"


@query("SELECT site, slug, label_ru, label_az FROM each WHERE slug <> '' QUALIFY row_number() OVER (PARTITION BY site, slug ORDER BY own DESC, is_active DESC, id DESC) = 1", LABELS)
def labels_of_sections(spark, d):
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    made = table(spark, d, "part").select(n.alias("id"), F.when(n % 3 == 0, F.concat(F.lit("a_"), size)).otherwise(F.concat(F.lit("k"), n)).alias("key"), (n % 5 != 0).alias("is_active"), F.col("p_name").alias("label_ru"), F.when(n % 2 == 0, F.col("p_brand")).alias("label_az"), size.alias("site_a_slug"), F.when(n % 4 == 0, "").when(n % 4 == 1, F.col("p_type")).alias("site_b_slug"))
    return taxonomy.labels(made, {"site_a": "a", "site_b": "b"})


# Rules in rows of five, each of which supersedes the next; in every third row the last one supersedes the first.
RULES = """rules AS (
    SELECT p_partkey AS n, p_partkey - 1 - p_partkey % 13 // 12 AS of, CASE WHEN p_partkey % 5 <> 4 THEN p_partkey + 1 WHEN p_partkey // 5 % 3 = 0 THEN p_partkey - 4 END AS next, p_partkey % 17 = 0 AS upper FROM part),
said AS (SELECT *, (CASE WHEN upper THEN 'Signal ' ELSE 'signal ' END) || of AS signal FROM rules)"""


@query("SELECT 'r' || n AS id, 'signal twice' AS fault FROM said WHERE signal IN (SELECT signal FROM said GROUP BY 1 HAVING count(*) > 1) UNION SELECT 'r' || n, 'signal is not folded' FROM said WHERE upper UNION SELECT 'r' || n, 'supersedes no rule' FROM said WHERE n % 11 = 0 OR (next IS NOT NULL AND next NOT IN (SELECT n FROM said)) UNION SELECT 'r' || n, 'circle' FROM said WHERE n // 5 % 3 = 0 AND (SELECT count(*) FROM said o WHERE o.n // 5 = said.n // 5) = 5", RULES)
def faults_of_rules(spark, d):
    n = F.col("p_partkey")
    following = F.when(n % 5 != 4, n + 1).when(F.expr("p_partkey div 5 % 3 = 0"), n - 4)
    signal = F.concat(F.when(n % 17 == 0, "Signal ").otherwise("signal "), F.expr("p_partkey - 1 - p_partkey % 13 div 12"))
    over = F.concat_ws(",", F.concat(F.lit("r"), following), F.when(n % 11 == 0, "none"))
    made = table(spark, d, "part").select(F.concat(F.lit("r"), n).alias("id"), signal.alias("signal"), over.alias("supersedes"))
    return taxonomy.rule_faults(stored(made))
