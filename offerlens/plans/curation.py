"""Queries of the upkeep of clusters, over a stored state that follows from the listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import curation
from ..sources.lineage import PRODUCTS_SQL
from ..sources.listings import LISTINGS_SQL, listings
from ..sources.shared import stored
from .near import KEY, ONLY
from .registry import query

NOW = "2001-11-05 00:00:00"
CLASH = "({a}.product_id + {b}.product_id) % 7 = 0 AND {a}.product_id <> {b}.product_id"

STATE = f"""{PRODUCTS_SQL},{LISTINGS_SQL},
state AS MATERIALIZED (
    SELECT product_id, site, CASE WHEN product_id % 5 < 3 THEN match_id END AS match_id, match_id % 11 = 0 AS is_manual, product_id % 13 = 0 AS dead, availability = 'out_of_stock' AS out_of_stock, availability = 'in_stock' AS matchable,
           words AS norm, dose, 10 + match_id % 2 * 10 AS pack, [match_id % 3] AS strengths, string_split(words, ' ')[2] AS block, {KEY.replace("norm", "words")} AS key, url, country_code, CASE WHEN product_id // 9 % 3 = 1 THEN TIMESTAMP '2001-09-01' ELSE TIMESTAMP '2001-11-01' END AS last_seen_at,
           1000 + match_id % 4 * 100 + CASE WHEN product_id % 7 = 0 THEN 1000 ELSE 0 END AS price_cents
    FROM listings),
fresh AS MATERIALIZED (
    SELECT state.*, old AND complete AS lost, old AND NOT complete AS unknown
    FROM (SELECT *, last_seen_at < TIMESTAMP '{NOW}' - INTERVAL 342 HOUR AS old FROM state) AS state
    JOIN (SELECT site, avg(CASE WHEN last_seen_at >= TIMESTAMP '{NOW}' - INTERVAL 342 HOUR THEN 1 ELSE 0 END) >= 0.5 AS complete FROM state WHERE NOT dead GROUP BY site) USING (site))"""


def state_of(spark, d):
    """The state; a name is folded once, however many rows have it."""
    p = listings(spark, d)
    rows = stored(p.select(
        "product_id",
        "site",
        F.when(F.col("product_id") % 5 < 3, F.col("match_id")).alias("match_id"),
        (F.col("match_id") % 11 == 0).alias("is_manual"),
        (F.col("product_id") % 13 == 0).alias("dead"),
        (F.col("availability") == "out_of_stock").alias("out_of_stock"),
        (F.col("availability") == "in_stock").alias("matchable"),
        F.col("words").alias("norm"),
        "dose",
        (10 + F.col("match_id") % 2 * 10).alias("pack"),
        F.array(F.col("match_id") % 3).alias("strengths"),
        F.split("words", " ")[1].alias("block"),
        "url",
        "country_code",
        F.when(F.expr("product_id div 9 % 3 = 1"), F.lit("2001-09-01")).otherwise(F.lit("2001-11-01")).cast("timestamp_ntz").alias("last_seen_at"),
        (1000 + F.col("match_id") % 4 * 100 + F.when(F.col("product_id") % 7 == 0, 1000).otherwise(0)).alias("price_cents"),
    ))
    keys = stored(rows.select("norm").distinct().select("norm", text.tokens(names.fold(F.col("norm"))).alias("key")))
    return rows.join(keys, "norm", "left")


def fresh(spark, d):
    return stored(curation.with_freshness(state_of(spark, d), NOW))


def clash(a, b):
    x, y = F.col(a + "product_id"), F.col(b + "product_id")
    return ((x + y) % 7 == 0) & (x != y)


def gap(a, b):
    x, y = F.col(a + "key"), F.col(b + "key")
    return F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))


def score(a, b):
    return text.token_set_ratio(F.col(a + "key"), F.col(b + "key"))


@query("SELECT site, count(*) AS products, count(*) FILTER (lost) AS lost, count(*) FILTER (unknown) AS unknown FROM fresh GROUP BY site", STATE)
def lost_rows(spark, d):
    return fresh(spark, d).groupBy("site").agg(F.count("*").alias("products"), F.count_if("lost").alias("lost"), F.count_if("unknown").alias("unknown"))


def conflicts_of(spark, d, s):
    """Pairs of one cluster whose countries differ, or that the rule tells apart."""
    a, b = (curation.side(s.where("match_id is not null"), p) for p in ("a_", "b_"))
    met = a.join(b, F.expr("a_match_id = b_match_id and a_product_id < b_product_id and a_site <> b_site"))
    country = F.coalesce(F.col("a_country_code") != F.col("b_country_code"), F.lit(False)) & (F.col("a_match_id") % 2 == 0)
    found = met.where(country | clash("a_", "b_")).select(F.col("a_match_id").alias("match_id"), F.col("a_product_id").alias("a"), F.col("b_product_id").alias("b"), F.when(country, "country").otherwise("spec").alias("kind"))
    return found


def split_of(spark, d):
    s = stored(state_of(spark, d).withColumn("match_id", (F.col("product_id") / 6).cast("long")))
    conflicts = stored(conflicts_of(spark, d, s))
    return s, conflicts, stored(curation.splits(s, conflicts, lambda m, i: m * 100 + i))


#: Two matched parts make one cluster here, of six products at most; groups are worked out one member after another.
SPLIT = f"""{STATE},
six AS MATERIALIZED (SELECT product_id // 6 AS match_id, product_id, site, is_manual, out_of_stock, country_code FROM state),
clashes AS MATERIALIZED (
    SELECT a.match_id, a.product_id AS a, b.product_id AS b, coalesce(a.country_code <> b.country_code, false) AND a.match_id % 2 = 0 AS country
    FROM six a JOIN six b ON a.match_id = b.match_id AND a.product_id < b.product_id AND a.site <> b.site
    WHERE (coalesce(a.country_code <> b.country_code, false) AND a.match_id % 2 = 0) OR ({CLASH.format(a='a', b='b')})),
judged AS MATERIALIZED (SELECT match_id, bool_or(out_of_stock) AS offer, list(product_id ORDER BY product_id) AS before FROM six WHERE NOT is_manual GROUP BY match_id HAVING bool_or(out_of_stock) OR match_id IN (SELECT match_id FROM clashes)),
ordered AS MATERIALIZED (SELECT match_id, product_id, site, row_number() OVER (PARTITION BY match_id ORDER BY product_id) AS i FROM six JOIN judged USING (match_id) WHERE NOT six.is_manual AND NOT six.out_of_stock),
p1 AS (SELECT *, 1 AS g FROM ordered WHERE i = 1)"""
for _i in range(2, 7):
    SPLIT += f""",
p{_i} AS MATERIALIZED (
    SELECT * FROM p{_i - 1} UNION ALL
    SELECT o.match_id, o.product_id, o.site, o.i, coalesce((
        SELECT min(x.g) FROM (SELECT DISTINCT g FROM p{_i - 1} q WHERE q.match_id = o.match_id) x
        WHERE NOT EXISTS (SELECT 1 FROM p{_i - 1} q JOIN clashes c ON (c.a = q.product_id AND c.b = o.product_id) OR (c.b = q.product_id AND c.a = o.product_id) WHERE q.match_id = o.match_id AND q.g = x.g)),
        (SELECT max(g) + 1 FROM p{_i - 1} q WHERE q.match_id = o.match_id)) AS g
    FROM ordered o WHERE i = {_i})"""
SPLIT += """,
grouped AS (SELECT match_id, g, list(product_id ORDER BY product_id) AS members FROM p6 GROUP BY match_id, g HAVING count(DISTINCT site) >= 2),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY len(members) DESC, g) - 1 AS place FROM grouped),
audits AS MATERIALIZED (
    SELECT match_id, CASE WHEN offer THEN 'offer' WHEN match_id IN (SELECT match_id FROM clashes WHERE country) THEN 'country' ELSE 'spec' END || CASE WHEN match_id IN (SELECT match_id FROM ranked) THEN '_repartition' ELSE '_dissolve' END AS action, before
    FROM judged)"""


@query("SELECT match_id, action, len(before) AS members, (SELECT count(*) FROM ranked r WHERE r.match_id = a.match_id) AS groups, len(before) - coalesce((SELECT sum(len(members)) FROM ranked r WHERE r.match_id = a.match_id), 0) AS unmatched FROM audits a", SPLIT)
def split_clusters(spark, d):
    _, _, audits = split_of(spark, d)
    return audits.select("match_id", "action", F.size("before").cast("long").alias("members"), F.size("groups").cast("long").alias("groups"), F.size("unmatched").cast("long").alias("unmatched"))


@query("SELECT product_id, match_id AS before, after FROM (SELECT match_id, place, unnest(members) AS product_id, CASE WHEN place = 0 THEN match_id ELSE match_id * 100 + place END AS after FROM ranked) WHERE place > 0 UNION ALL SELECT product_id, match_id, NULL FROM (SELECT match_id, unnest(before) AS product_id FROM audits) WHERE product_id NOT IN (SELECT unnest(members) FROM ranked)", SPLIT)
def split_moves(spark, d):
    _, _, audits = split_of(spark, d)
    return curation.split_moves(audits).select("product_id", "before", "after")


@query("SELECT a, b, CASE WHEN country THEN 'system_country' ELSE 'system_spec' END AS reason_type FROM clashes WHERE match_id IN (SELECT match_id FROM judged)", SPLIT)
def split_rejections(spark, d):
    _, conflicts, audits = split_of(spark, d)
    return curation.split_rejections(audits, conflicts)


TWINS = f"""{STATE},
free AS (SELECT * FROM fresh WHERE match_id IS NULL AND NOT lost AND NOT unknown AND NOT dead AND matchable),
twins AS (
    SELECT l.product_id AS gone, l.match_id, l.site, t.product_id AS twin, l.country_code AS lc, t.country_code AS tc, count(*) OVER (PARTITION BY l.product_id) AS n, count(*) FILTER (l.url = t.url) OVER (PARTITION BY l.product_id) AS u, l.url = t.url AS same
    FROM fresh l JOIN free t ON l.site = t.site AND l.norm = t.norm AND l.dose = t.dose AND l.pack = t.pack WHERE l.lost AND l.match_id IS NOT NULL AND NOT l.is_manual),
sound AS (
    SELECT * FROM twins WHERE (n = 1 OR (u = 1 AND same)) AND (lc IS NULL OR lc IS NOT DISTINCT FROM tc) AND (gone + twin) % 7 <> 0
      AND NOT EXISTS (SELECT 1 FROM fresh o WHERE o.match_id = twins.match_id AND o.site <> twins.site AND (o.product_id + twin) % 7 = 0)),
won AS (SELECT twin, arg_min(gone, (match_id, gone)) AS gone, arg_min(match_id, (match_id, gone)) AS match_id FROM sound GROUP BY twin)"""


@query("SELECT gone AS product_id, match_id AS before, NULL::BIGINT AS after, 'lost_out' AS reason FROM won UNION ALL SELECT twin, NULL, match_id, 'lost_in' FROM won", TWINS)
def lost_members(spark, d):
    """Places of rows that their sites no longer show, handed to their living twins."""
    return curation.lost_moves(fresh(spark, d), clash)


GAP = " + ".join(f"len({ONLY.format(a=a, b=b)})" for a, b in (("{a}.key", "{b}.key"), ("{b}.key", "{a}.key")))
STRANGERS = f"""{STATE},
sane AS (SELECT *, NOT lost AND NOT unknown AND NOT dead AND matchable AS live FROM fresh),
sound AS (SELECT match_id FROM sane WHERE match_id IS NOT NULL AND NOT is_manual GROUP BY match_id HAVING count(*) = count(DISTINCT site) AND NOT bool_or(unknown) AND count(*) FILTER (live) >= 2),
inside AS MATERIALIZED (SELECT sane.* FROM sane JOIN sound USING (match_id) WHERE NOT is_manual),
odd AS (SELECT * FROM inside m WHERE live AND EXISTS (SELECT 1 FROM inside o WHERE o.match_id = m.match_id AND o.product_id <> m.product_id AND o.live) AND NOT EXISTS (SELECT 1 FROM inside o WHERE o.match_id = m.match_id AND o.product_id <> m.product_id AND o.live AND abs(m.price_cents - o.price_cents) <= 0.01 * greatest(m.price_cents, o.price_cents))),
fits AS (
    SELECT m.product_id AS gone, m.match_id, c.product_id AS new FROM odd m JOIN sane c ON c.site = m.site AND c.match_id IS NULL AND c.live
    WHERE (m.country_code IS NULL OR m.country_code IS NOT DISTINCT FROM c.country_code)
      AND EXISTS (SELECT 1 FROM inside o WHERE o.match_id = m.match_id AND o.product_id <> m.product_id AND o.live AND o.block = c.block)
      AND NOT EXISTS (SELECT 1 FROM inside o WHERE o.match_id = m.match_id AND o.product_id <> m.product_id
          AND ((o.live AND abs(c.price_cents - o.price_cents) > 0.005 * greatest(c.price_cents, o.price_cents)) OR (o.product_id + c.product_id) % 7 = 0 OR {GAP.format(a='o', b='c')} > {GAP.format(a='o', b='m')}))),
single AS (SELECT * FROM fits QUALIFY count(*) OVER (PARTITION BY gone) = 1),
first AS (SELECT * FROM single QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY gone) = 1),
won AS (SELECT new, arg_min(gone, (match_id, gone)) AS gone, min(match_id) AS match_id FROM first GROUP BY new)"""


@query("SELECT gone AS product_id, match_id AS before, NULL::BIGINT AS after, 'price_out' AS reason FROM won UNION ALL SELECT new, NULL, match_id, 'price_in' FROM won", STRANGERS)
def price_stranger_moves(spark, d):
    """Members whose price fits no other, replaced by the one row of their site whose price does. Their journal here is the present price."""
    s = fresh(spark, d)
    return curation.stranger_moves(s, s.select("product_id", "price_cents"), clash, gap, alike=("key",))


@query()
def dead_members(spark, d):
    """Places of members with dead addresses, given to living rows in order of clusters; tests hold it against a plain version."""
    return curation.dead_moves(stored(state_of(spark, d)), clash, score, alike=("key",))


@query()
def cluster_merges(spark, d):
    """Clusters that hold a lost row and its living twin, joined; tests hold it against what must come of it."""
    return curation.merge_moves(fresh(spark, d), clash)


@query("SELECT product_id, match_id FROM fresh", STATE)
def rolled_back_topology(spark, d):
    """Three steps of upkeep, each logged, undone from the log: the state is what it was."""
    start = fresh(spark, d)
    state, log = start, None
    steps = (lambda s: curation.lost_moves(s, clash), lambda s: curation.dead_moves(s, clash, score, alike=("key",)), lambda s: curation.stranger_moves(s, s.select("product_id", "price_cents"), clash, gap, alike=("key",)))
    for seq, step in enumerate(steps, 1):
        moves = stored(curation.logged(step(state), seq))
        log = moves if log is None else log.unionByName(moves)
        # What comes after the last step reads only where products are.
        state = stored(curation.applied(state if seq < len(steps) else state.select("product_id", "match_id"), moves))
    return curation.rolled_back(state, stored(log), 0).select("product_id", "match_id")
