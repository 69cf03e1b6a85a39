"""Queries of what is due, of identities, of a whole run, and of kept lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import analysis, identity, rotation
from ..sources.adapter import CLIENT, NOW, events, observations, table
from ..sources.lineage import PRODUCTS_SQL, RUNS_SQL, products, runs
from ..sources.shared import shared_folder, stored
from .registry import query

DUE = f"""{RUNS_SQL}, tries AS (SELECT site, started_at, finished_at, status, eligible AND tenant_id = 1 AS eligible FROM elig JOIN run_sites ON run_id = id WHERE scope = 'full'),
lasts AS (SELECT * FROM tries WHERE started_at <= TIMESTAMP '1998-08-20' QUALIFY row_number() OVER (PARTITION BY site ORDER BY started_at DESC) = 1),
sites AS (SELECT DISTINCT site, 24 * 7 * (1 + length(site) % 5) AS hours FROM run_sites),
windows AS (SELECT site, epoch(TIMESTAMP '1998-01-01') + floor((epoch(TIMESTAMP '1998-08-20') - epoch(TIMESTAMP '1998-01-01')) / (hours * 3600)) * hours * 3600 AS start FROM sites),
judged AS (SELECT w.site, coalesce((status = 'ok' OR (status = 'degraded' AND eligible)) AND epoch(started_at) >= start, false) AS done, coalesce(finished_at, started_at) AS ended FROM windows w LEFT JOIN lasts USING (site))"""


@query("SELECT site, NOT done AS due, CASE WHEN done THEN (epoch(TIMESTAMP '1998-08-20') - epoch(date_trunc('second', ended))) / 3600 END AS hours FROM judged", DUE)
def due_sites(spark, d):
    """Sites to collect in full, by windows of one to five weeks from a fixed day."""
    from ..operators.lineage import eligible_runs

    every = runs(spark, d)
    good = eligible_runs(every).select("id", F.lit(True).alias("eligible"))
    each = every.where("scope = 'full'").select("id", "started_at", "finished_at", "status", F.explode(F.map_keys("site_products")).alias("site")).join(good, "id", "left").na.fill(False, ["eligible"])
    sites = every.select(F.explode(F.map_keys("site_products")).alias("site")).distinct()
    cadence = sites.select("site", (24 * 7 * (1 + F.length("site") % 5)).alias("hours"), F.lit("1998-01-01").cast("timestamp_ntz").alias("anchor"))
    return rotation.due_sites(cadence, each, "1998-08-20 00:00:00")


TICKS = "ticks AS (SELECT user_id % 50 AS key, event_id AS seq, 'site' || event_id % 3 AS site, epoch(date_trunc('second', ts))::BIGINT AS second FROM events)"
#: Ticks taken follow one another, each the first of its site that is late enough after the last taken of it.
CHAIN = f"""WITH RECURSIVE {TICKS},
chain AS (
    SELECT key, site, second, seq FROM ticks QUALIFY row_number() OVER (PARTITION BY key, site ORDER BY second, seq) = 1
    UNION ALL
    SELECT key, site, second, seq FROM (
        SELECT t.key, t.site, t.second, t.seq, row_number() OVER (PARTITION BY t.key, t.site ORDER BY t.second, t.seq) AS i
        FROM chain c JOIN ticks t ON t.key = c.key AND t.site = c.site AND t.second >= c.second + 7200) WHERE i = 1)
SELECT t.key, t.site, t.seq, t.second, (count(c.seq) OVER (PARTITION BY t.key ORDER BY t.second, t.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) % 5 AS turn, c.seq IS NOT NULL AS taken
FROM ticks t LEFT JOIN chain c USING (key, site, second, seq)"""


@query(CHAIN, prelude=False)
def rotation_turns(spark, d):
    """Events as ticks of fifty shops over five categories and three sites, each site two hours apart."""
    ticks = events(spark, d).select((F.col("user_id") % 50).alias("key"), F.col("event_id").alias("seq"), F.concat(F.lit("site"), F.col("event_id") % 3).alias("site"), F.col("ts").alias("at"))
    return rotation.rotated(ticks, 5, 7200)


RUN, BEFORE = 199806, 199805
ANALYSED = f"""facts AS MATERIALIZED (
    SELECT product_id, match_id, site, category, arg_max(eff, (k1, k2, k3, k4, k5, k6)) FILTER (run_id = {RUN}) AS eff, arg_max(eff, (k1, k2, k3, k4, k5, k6)) FILTER (run_id < {RUN}) AS previous, min(run_id) AS first_run,
           coalesce(bool_or(discount_cents IS NOT NULL) FILTER (run_id = {RUN}), false) AS promo, coalesce(bool_or(discount_cents IS NOT NULL) FILTER (run_id = {BEFORE}), false) AS promo_before
    FROM s WHERE run_id <= {RUN} GROUP BY ALL),
cur AS (SELECT match_id, site, min(coalesce(eff, previous)) AS price FROM facts GROUP BY ALL),
under AS (SELECT count(*) AS n FROM cur c JOIN cur r USING (match_id) WHERE c.site = 'client' AND r.site <> 'client' AND r.price < c.price AND r.price * 10 >= c.price)"""


@query("SELECT 'undercuts' AS what, n FROM under UNION ALL SELECT 'products', count(*) FROM facts WHERE eff IS NOT NULL UNION ALL SELECT 'price_changes', count(*) FROM facts WHERE previous > 0 AND abs(eff - previous) >= 1 UNION ALL SELECT 'new_products', count(*) FROM facts WHERE first_run = 199806 UNION ALL SELECT 'promo_changes', count(*) FROM (SELECT site, category FROM facts GROUP BY ALL HAVING bool_or(promo) <> bool_or(promo_before))", ANALYSED)
def run_analysis(spark, d):
    """All that a run changed, counted; one scan of the observations."""
    o = observations(spark, d)
    eff = F.coalesce(F.nullif("discount_cents", F.lit(0)), "price_cents")
    return analysis.analyse(o.withColumn("eff", eff).withColumn("on_promo", F.col("discount_cents").isNotNull()), RUN, BEFORE, CLIENT)[1]


NUMBERED = f"""{PRODUCTS_SQL},
start AS MATERIALIZED (SELECT product_id, site, 'p' || product_id // 6 AS slug, CASE WHEN product_id % 4 = 0 THEN product_id // 6 * 10 + product_id % 8 // 4 END AS number, product_id % 5 = 0 AS matched, last_seen_at FROM products),
seen AS MATERIALIZED (SELECT DISTINCT site, slug, n AS number FROM (SELECT site, slug, product_id, product_id // 6 * 10 + CASE WHEN product_id % 35 = 0 THEN 1 ELSE 0 END AS n FROM start WHERE product_id % 9 <> 0 UNION ALL SELECT site, slug, product_id, product_id // 6 * 10 FROM start WHERE product_id % 50 = 0)),
bad AS MATERIALIZED (SELECT * FROM seen WHERE (site, slug) IN (SELECT (site, slug) FROM seen GROUP BY site, slug HAVING count(*) > 1) OR (site, number) IN (SELECT (site, number) FROM seen GROUP BY site, number HAVING count(*) > 1)),
sound AS (SELECT * FROM seen EXCEPT SELECT * FROM bad),
cands AS MATERIALIZED (SELECT DISTINCT s.site, s.number AS wanted, p.product_id, p.number, p.matched, p.last_seen_at FROM sound s JOIN start p ON p.site = s.site AND (p.slug = s.slug OR p.number = s.number)),
ranked AS (SELECT *, row_number() OVER w AS rank, first_value(product_id) OVER w AS best FROM cands WHERE number IS NULL OR number = wanted WINDOW w AS (PARTITION BY site, wanted ORDER BY number IS NOT NULL DESC, matched DESC, last_seen_at DESC, product_id)),
told AS MATERIALIZED (SELECT site, product_id, CASE WHEN rank > 1 THEN 'retire' ELSE 'adopt' END AS kind, number AS before, CASE WHEN rank = 1 THEN wanted END AS after, CASE WHEN rank > 1 THEN best END AS "into" FROM ranked WHERE rank > 1 OR number IS NULL),
entries AS MATERIALIZED (
    SELECT * FROM told UNION ALL
    SELECT * FROM (SELECT site, product_id, 'isolate', number, number, NULL FROM cands WHERE number <> wanted UNION SELECT p.site, product_id, 'isolate', p.number, p.number, NULL FROM start p WHERE (p.site, p.slug) IN (SELECT (site, slug) FROM bad)) WHERE product_id NOT IN (SELECT product_id FROM told))"""


def numbered(spark, d):
    p = products(spark, d)
    start = p.select("product_id", "site", F.expr("concat('p', product_id div 6)").alias("slug"), F.expr("case when product_id % 4 = 0 then product_id div 6 * 10 + product_id % 8 div 4 end").alias("number"), F.lit(False).alias("retired"), F.lit(False).alias("isolated"), (F.col("product_id") % 5 == 0).alias("matched"), "last_seen_at", F.lit(None).cast("long").alias("into"))
    start = stored(start)
    one = start.where("product_id % 9 <> 0").select("site", "slug", F.expr("product_id div 6 * 10 + if(product_id % 35 = 0, 1, 0)").alias("number"))
    two = start.where("product_id % 50 = 0").select("site", "slug", F.expr("product_id div 6 * 10").alias("number"))
    return start, stored(one.union(two))


@query("SELECT 1::BIGINT AS seq, site, product_id, kind, before, after, \"into\" FROM entries", NUMBERED)
def identity_ledger(spark, d):
    """What a pass that says which address has which number adds to the ledger."""
    start, seen = numbered(spark, d)
    return identity.proposals(start, seen, 1)


@query("SELECT product_id, coalesce(e.after, CASE WHEN e.product_id IS NULL THEN s.number END) AS number, coalesce(kind = 'retire', false) AS retired, coalesce(kind = 'isolate', false) AS isolated, \"into\" FROM start s LEFT JOIN entries e USING (product_id)", NUMBERED)
def identities_after(spark, d):
    """The state that the ledger leads to. The same pass again adds nothing to it, which is worked out here too."""
    start, seen = numbered(spark, d)
    ledger = stored(identity.proposals(start, seen, 1))
    after = stored(identity.replayed(start, ledger))
    again = stored(identity.proposals(after, seen, 2))
    return identity.replayed(start, ledger.unionByName(again)).select("product_id", "number", "retired", "isolated", "into")


@query("SELECT CAST(p_partkey AS BIGINT) AS place, p_name AS payload FROM part WHERE p_size % 2 = 0", prelude=False)
def kept_list(spark, d):
    """A list published, superseded by another, and read as of the epoch and policy that it rests on."""
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    part = table(spark, d, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("payload"), "p_size")
    analysis.publish(part.where("p_size % 2 = 1"), folder, 1, CLIENT, "e1", "f", 1, 1, NOW)
    analysis.publish(part.where("p_size % 2 = 0"), folder, 1, CLIENT, "e2", "f", 2, 2, NOW)
    analysis.publish(part, folder, 2, CLIENT, "e2", "f", 2, 3, NOW)
    return analysis.current_items(spark.read.schema(analysis.PUBLISHED).parquet(folder), 1, CLIENT, "e2", "f", NOW, 24)
