"""Every query of the library by name and, where plain SQL can say it, its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import analytics, changes, ingest, matching, prices, trust, windows
from ..sources import files
from ..sources.adapter import NOW, events, observations, stock, table
from ..streaming import twins
from .registry import ORACLES, QUERIES, query

RUN, BEFORE = 199806, 199805

def obs(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d)


#: Since when observations are recent: a time in which not every site has shown everything.
RECENT = "2001-06-01 00:00:00"


def recent(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).where(F.col("captured_at") >= F.lit(RECENT).cast("timestamp_ntz"))


LATE = f"late AS (SELECT * FROM s WHERE captured_at >= TIMESTAMP '{RECENT}'), lm AS (SELECT match_id, any_value(category) AS category, max(eff) FILTER (site = 'client') AS client, max(eff) FILTER (site = 'rival_a') AS rival_a, max(eff) FILTER (site = 'rival_b') AS rival_b FROM latest WHERE captured_at >= TIMESTAMP '{RECENT}' GROUP BY match_id)"
RIVAL_PAIRS = "(SELECT match_id, category, brand, client, 'rival_a' AS site, rival_a AS rival FROM m UNION ALL SELECT match_id, category, brand, client, 'rival_b', rival_b FROM m) WHERE client IS NOT NULL AND rival IS NOT NULL"
CHEAPEST = f"q AS (SELECT * FROM {RIVAL_PAIRS} QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY rival, site) = 1), st AS (SELECT p_partkey AS match_id, CAST(round(p_retailprice * 100) AS BIGINT) * 80 // 100 AS cost_cents, p_size > 5 AS in_stock FROM part)"
ASOF = f"""q AS (
    SELECT product_id, arg_max(site, (k1, k2, k3, k4, k5, k6)) AS site, arg_max(match_id, (k1, k2, k3, k4, k5, k6)) AS match_id,
           arg_max(eff, (k1, k2, k3, k4, k5, k6)) FILTER (run_id = {RUN}) AS eff, arg_max(price_cents, (k1, k2, k3, k4, k5, k6)) FILTER (run_id = {RUN}) AS regular,
           arg_max(eff, (k1, k2, k3, k4, k5, k6)) FILTER (run_id < {RUN}) AS previous, arg_max(price_cents, (k1, k2, k3, k4, k5, k6)) FILTER (run_id < {RUN}) AS previous_regular
    FROM s WHERE run_id <= {RUN} GROUP BY product_id HAVING eff IS NOT NULL),
ch AS (SELECT *, sign(eff - previous) * (abs(eff - previous) * 10000 // previous) AS bp FROM q WHERE previous > 0 AND abs(eff - previous) >= 1)"""
JOURNAL = """q AS (
    SELECT * FROM (SELECT *, row_number() OVER w AS n, lag(price_cents) OVER w AS pp, lag(discount_cents) OVER w AS pd FROM s WINDOW w AS (PARTITION BY product_id ORDER BY k1, k2, k3, k4, k5, k6))
    WHERE n = 1 OR pp IS DISTINCT FROM price_cents OR pd IS DISTINCT FROM discount_cents)"""
DAILY = "q AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY product_id, CAST(captured_at AS DATE) ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC, k5 DESC, k6 DESC) = 1)"
COUNTS = "q AS (SELECT run_id, site, count(DISTINCT product_id) AS products FROM s GROUP BY ALL), b AS (SELECT *, (SELECT median(products) FROM (SELECT products FROM q AS o WHERE o.site = q.site AND o.run_id < q.run_id ORDER BY o.run_id DESC LIMIT 5)) AS baseline FROM q), quality AS (SELECT run_id, site, products, baseline, CASE WHEN products = 0 THEN 'failed' WHEN products * 2 < baseline THEN 'degraded' ELSE 'ok' END AS quality FROM b)"


@query("SELECT product_id, site, match_id, price_cents, eff AS eff_cents, strftime(captured_at, '%Y-%m-%d') AS day FROM latest")
def latest_snapshot(spark, d):
    seen = obs(spark, d).select("product_id", "site", "match_id", "price_cents", "discount_cents", "captured_at", "seq")
    now = prices.with_effective(prices.latest(seen))
    return now.select("product_id", "site", "match_id", "price_cents", F.col("eff").alias("eff_cents"), F.date_format("captured_at", "yyyy-MM-dd").alias("day"))


@query(f"SELECT match_id, site, client, rival, (client - rival) * 10000 // client AS bp FROM {RIVAL_PAIRS} AND rival < client AND rival * 10 >= client")
def undercuts(spark, d):
    return changes.undercuts(obs(spark, d)).select("match_id", "site", "client", "rival", "bp")


@query(f"{ASOF} SELECT product_id, site, match_id, eff, regular, previous, previous_regular FROM q")
def asof_previous(spark, d):
    return prices.as_of_previous(obs(spark, d), RUN)


@query(f"{ASOF} SELECT product_id, site, eff, previous, CAST(bp AS BIGINT) AS bp FROM ch")
def price_changes(spark, d):
    return changes.price_changes(obs(spark, d), RUN).select("product_id", "site", "eff", "previous", "bp")


@query(f"{ASOF} SELECT product_id, CAST(bp AS BIGINT) AS bp, CASE WHEN bp <= -2000 THEN 'critical' ELSE 'warning' END AS severity, regular >= previous_regular AS promo FROM ch WHERE bp <= -1000")
def price_drop_alerts(spark, d):
    return changes.price_drops(obs(spark, d), RUN).select("product_id", "bp", "severity", "promo")


@query(f"SELECT product_id, site, min(run_id) AS first_run FROM s GROUP BY ALL HAVING min(run_id) = {RUN}")
def new_products(spark, d):
    return changes.new_products(obs(spark, d), RUN)


@query(f"q AS (SELECT DISTINCT run_id, site, match_id AS title FROM s WHERE discount_cents IS NOT NULL) SELECT coalesce(n.site, o.site) AS site, coalesce(n.title, o.title) AS title, CASE WHEN o.site IS NULL THEN 'started' ELSE 'ended' END AS change FROM (SELECT * FROM q WHERE run_id = {RUN}) n FULL JOIN (SELECT * FROM q WHERE run_id = {BEFORE}) o ON n.site = o.site AND n.title = o.title WHERE n.site IS NULL OR o.site IS NULL")
def promo_set_diff(spark, d):
    return changes.promo_diff(obs(spark, d), RUN, BEFORE, "match_id")


@query("SELECT site, title, count(*) AS runs, min(run_id) AS first_run, max(run_id) AS last_run FROM (SELECT DISTINCT run_id, site, category AS title FROM s WHERE discount_cents IS NOT NULL) GROUP BY ALL")
def promo_history(spark, d):
    return changes.promotions(obs(spark, d)).groupBy("site", "title").agg(F.count("*").alias("runs"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))


@query(f"{ASOF} SELECT site, count(*) AS movers, count(*) FILTER (bp < 0) AS down, greatest(count(*) FILTER (bp < 0), count(*) - count(*) FILTER (bp < 0)) AS major, greatest(count(*) FILTER (bp < 0), count(*) - count(*) FILTER (bp < 0)) >= 10 AS collapse FROM ch GROUP BY site")
def mass_move_share(spark, d):
    return changes.mass_moves(obs(spark, d), RUN)


@query(f"{JOURNAL} SELECT product_id, price_cents, discount_cents, strftime(captured_at, '%Y-%m-%d') AS day, k2 AS orderkey FROM q")
def diff_only_journal(spark, d):
    j = prices.journal(obs(spark, d))
    return j.select("product_id", "price_cents", "discount_cents", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), F.col("seq.l_orderkey").alias("orderkey"))


@query(f"{DAILY} SELECT product_id, strftime(captured_at, '%Y-%m-%d') AS day, eff FROM q")
def daily_last_price(spark, d):
    return prices.daily_last(obs(spark, d)).select("product_id", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "eff")


SHARE = f"q AS (SELECT product_id, brand, site FROM s GROUP BY ALL HAVING max(captured_at) >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY), r AS (SELECT brand, count(*) FILTER (site = 'client') AS client, count(*) FILTER (site = 'rival_a') AS rival_a, count(*) FILTER (site = 'rival_b') AS rival_b, count(*) AS total, count(DISTINCT site) = 1 AS exclusive FROM q GROUP BY brand)"


@query(f"{SHARE} SELECT * FROM r")
def brand_share_pivot(spark, d):
    return analytics.brand_share(obs(spark, d))


@query(f"{SHARE.replace('400 DAY', '2 DAY')} SELECT brand, total FROM r WHERE exclusive")
def brand_exclusive(spark, d):
    return analytics.brand_share(obs(spark, d), days=2).where("exclusive").select("brand", "total")


@query("SELECT sites, count(*) AS clusters FROM (SELECT match_id, string_agg(DISTINCT site, '+' ORDER BY site) AS sites FROM s GROUP BY match_id) GROUP BY sites")
def assortment_overlap(spark, d):
    return analytics.assortment_overlap(obs(spark, d))


N_SITES = "((client IS NOT NULL)::INT + (rival_a IS NOT NULL)::INT + (rival_b IS NOT NULL)::INT)"
BOTH = "client IS NOT NULL AND (rival_a IS NOT NULL OR rival_b IS NOT NULL)"


@query(f"SELECT {N_SITES} AS n_sites, count(*) AS clusters, count(*) FILTER (greatest(client, rival_a, rival_b) * 2 >= least(client, rival_a, rival_b) * 3) AS suspected FROM m GROUP BY 1")
def match_quality(spark, d):
    return analytics.match_quality(obs(spark, d))


@query(f"SELECT category, count(*) AS clusters, CAST(sum(client) * sum((rival_a IS NOT NULL)::INT + (rival_b IS NOT NULL)::INT) * 100 AS DOUBLE) / CAST(sum(coalesce(rival_a, 0) + coalesce(rival_b, 0)) * count(*) AS DOUBLE) AS index FROM m WHERE {BOTH} GROUP BY category")
def price_index_category(spark, d):
    return analytics.price_index(obs(spark, d))


@query(f"q AS (SELECT *, least(rival_a, rival_b) AS best FROM m WHERE {BOTH}), r AS (SELECT *, abs(client - best) * 200 <= greatest(best, 200) AS par FROM q) SELECT category, count(*) AS clusters, count(*) FILTER (NOT par AND client < best) AS win, count(*) FILTER (NOT par AND client > best) AS lose, count(*) FILTER (par) AS parity, avg(client) AS avg_client, avg(rival_a) AS avg_rival_a, avg(rival_b) AS avg_rival_b FROM r GROUP BY category")
def category_comparison(spark, d):
    return analytics.category_comparison(obs(spark, d))


@query("q AS (SELECT match_id, site, eff FROM latest), r AS (SELECT match_id, count(*) AS n, min(eff) AS low, max(eff) AS high, list_sort(list(eff))[count(*) // 2 + 1] AS median FROM q GROUP BY match_id HAVING count(*) >= 2) SELECT r.*, (high - low) * 10000 // low AS spread_bp, (SELECT string_agg(site, ',' ORDER BY site) FROM q WHERE q.match_id = r.match_id AND q.eff = r.low) AS cheapest FROM r")
def comparison_spread(spark, d):
    return analytics.comparison_spread(obs(spark, d))


@query("q AS (SELECT 'client' AS a, 'rival_a' AS b, client AS pa, rival_a AS pb FROM m UNION ALL SELECT 'client', 'rival_b', client, rival_b FROM m UNION ALL SELECT 'rival_a', 'rival_b', rival_a, rival_b FROM m) SELECT a, b, count(*) AS \"both\", count(*) FILTER (pa < pb) AS a_cheaper, count(*) FILTER (pb < pa) AS b_cheaper, count(*) FILTER (pa = pb) AS equal FROM q WHERE pa IS NOT NULL AND pb IS NOT NULL GROUP BY a, b")
def pair_summary(spark, d):
    return analytics.pair_summary(obs(spark, d))


@query(f"SELECT CASE WHEN client < least(rival_a, rival_b) THEN 'cheapest' WHEN client = least(rival_a, rival_b) THEN 'tied' WHEN client > greatest(rival_a, rival_b) THEN 'dearest' ELSE 'between' END AS position, count(*) AS clusters FROM m WHERE {BOTH} GROUP BY 1")
def client_position(spark, d):
    return analytics.client_position(obs(spark, d))


@query(f"{CHEAPEST} SELECT q.match_id, site, client, rival, (rival - client) * 10000 // client AS gap_bp, CASE WHEN rival * 98 // 100 > client THEN rival * 98 // 100 ELSE rival - 1 END AS target FROM q JOIN st USING (match_id) WHERE in_stock AND rival > client AND (rival - client) * 10000 // client BETWEEN 500 AND 7999")
def price_raise(spark, d):
    return analytics.price_raises(obs(spark, d), stock(spark, d))


@query(f"{CHEAPEST} SELECT q.match_id, site, client, rival, (client - rival) * 10000 // client AS gap_bp, rival - 1 AS target, CASE WHEN (client - rival) * 10000 // client >= 1000 THEN 'critical' ELSE 'warning' END AS severity, (rival - 1) * 100 >= cost_cents * 110 AS feasible FROM q LEFT JOIN st USING (match_id) WHERE rival < client AND (client - rival) * 10000 // client BETWEEN 300 AND 7999")
def undercut_margin_aware(spark, d):
    return analytics.undercut_responses(obs(spark, d), stock(spark, d))


@query("SELECT match_id, category, greatest(rival_a, rival_b) AS price FROM lm WHERE client IS NULL ORDER BY price DESC, match_id LIMIT 50", LATE)
def assortment_gaps(spark, d):
    return analytics.assortment_gaps(recent(spark, d))


@query(f"{CHEAPEST}, l AS (SELECT * FROM s WHERE site = 'client' AND run_id <= {RUN} QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC, k5 DESC, k6 DESC) = 1) SELECT match_id, eff, cost_cents, in_stock, sign(eff - cost_cents)::BIGINT * (abs(eff - cost_cents) * 10000 // eff) AS margin_bp FROM l JOIN st USING (match_id)")
def margin_report(spark, d):
    return analytics.margin_report(obs(spark, d), stock(spark, d), RUN)


@query(f"{DAILY}, x AS (SELECT product_id, date_diff('day', DATE '1995-01-01', CAST(captured_at AS DATE)) AS x, eff AS y FROM q), a AS (SELECT product_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x * y) AS BIGINT) AS sxy, CAST(sum(x * x) AS BIGINT) AS sxx FROM x GROUP BY product_id HAVING count(*) >= 3) SELECT product_id, n, CASE WHEN n * sxx - sx * sx = 0 THEN 0 ELSE CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) END AS slope FROM a")
def linear_trend(spark, d):
    return analytics.linear_trend(obs(spark, d))


@query(f"{DAILY} SELECT product_id, strftime(captured_at, '%Y-%m-%d') AS day, CASE WHEN count(*) OVER (PARTITION BY product_id) > 3 THEN avg(eff) OVER (PARTITION BY product_id ORDER BY captured_at ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE CAST(eff AS DOUBLE) END AS smooth FROM q")
def moving_average(spark, d):
    return analytics.moving_average(obs(spark, d))


@query("SELECT site, (isodow(captured_at) - 1)::BIGINT AS weekday, count(*) AS n, avg(eff) AS mean FROM s GROUP BY ALL")
def weekly_seasonality(spark, d):
    return analytics.weekly_profile(obs(spark, d))


@query("q AS (SELECT product_id, arg_max(eff, (k1, k2, k3, k4, k5, k6)) FILTER (captured_at < TIMESTAMP '2001-01-01') AS anchor, arg_min(eff, (k1, k2, k3, k4, k5, k6)) FILTER (captured_at >= TIMESTAMP '2001-01-01') AS first, arg_max(eff, (k1, k2, k3, k4, k5, k6)) FILTER (captured_at >= TIMESTAMP '2001-01-01') AS last FROM s GROUP BY product_id), r AS (SELECT product_id, coalesce(anchor, first) AS start, last FROM q WHERE last IS NOT NULL), t AS (SELECT *, sign(last - start)::BIGINT * (abs(last - start) * 10000 // start) AS bp FROM r) SELECT product_id, start, last, bp FROM t WHERE abs(bp) BETWEEN 500 AND 9500 ORDER BY abs(bp) DESC, product_id LIMIT 500")
def top_movers(spark, d):
    return analytics.top_movers(obs(spark, d), "2001-01-01 00:00:00")


@query(f"{JOURNAL} SELECT category, count(*) AS changes FROM q GROUP BY category ORDER BY changes DESC, category LIMIT 10")
def volatile_categories(spark, d):
    return analytics.volatile_categories(obs(spark, d))


@query("q AS (SELECT DISTINCT site, brand, category FROM s) SELECT a.category AS client_category, b.category AS rival_category, count(DISTINCT a.brand) AS brands FROM q a JOIN q b ON a.brand = b.brand AND a.site = 'client' AND b.site = 'rival_a' GROUP BY ALL HAVING count(DISTINCT a.brand) >= 2")
def brand_overlap_self_join(spark, d):
    return analytics.brand_overlap(obs(spark, d))


@query("SELECT DISTINCT match_id, category FROM late WHERE match_id NOT IN (SELECT match_id FROM late WHERE site = 'rival_b')", LATE)
def missing_site_anti(spark, d):
    return analytics.missing_at(recent(spark, d), "rival_b")


@query(f"{COUNTS}, e AS (SELECT run_id FROM quality GROUP BY run_id HAVING bool_and(quality = 'ok') AND count(*) = 3) SELECT run_id, site, count(*) AS n FROM s WHERE run_id IN (SELECT run_id FROM e) GROUP BY ALL")
def trusted_semi_join(spark, d):
    return trust.trusted(obs(spark, d)).groupBy("run_id", "site").agg(F.count("*").alias("n"))


@query(f"SELECT site, count(DISTINCT product_id) AS products, count(DISTINCT CASE WHEN discount_cents IS NOT NULL THEN product_id END) AS promoted, count(DISTINCT CASE WHEN captured_at >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY THEN product_id END) AS recent, CAST(count(DISTINCT CASE WHEN captured_at >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY THEN product_id END) * 100 AS DOUBLE) / count(DISTINCT product_id) AS recent_pct FROM s GROUP BY site")
def coverage_pct_distinct(spark, d):
    return trust.coverage(obs(spark, d))


@query(f"{COUNTS} SELECT * FROM quality")
def run_baseline_median(spark, d):
    return trust.baselines(obs(spark, d))


@query(f"SELECT site, strftime(max(captured_at), '%Y-%m-%d %H:%M:%S') AS last, CAST(greatest(0, floor((epoch(TIMESTAMP '{NOW}') - epoch(max(captured_at))) / 86400)) AS BIGINT) AS days FROM s GROUP BY site")
def site_silence(spark, d):
    return trust.freshness(obs(spark, d))


@query(f"q AS (SELECT *, date_diff('day', CAST(captured_at AS DATE), DATE '{NOW[:10]}') AS age FROM s), r AS (SELECT site, count(DISTINCT CASE WHEN age <= 60 THEN product_id END) AS now, count(DISTINCT CASE WHEN age > 60 AND age <= 120 THEN product_id END) AS before FROM q GROUP BY site) SELECT site, r.now, before, r.now * 2 < before AS dropped FROM r")
def site_drop(spark, d):
    return trust.site_drop(obs(spark, d))


@query("SELECT run_id, site, count(*) AS n, count(*) FILTER (price_cents < 95000) AS low, count(*) FILTER (price_cents < 95000) * 2 >= count(*) AS suspect FROM s GROUP BY ALL HAVING count(*) >= 10")
def zero_price_share(spark, d):
    return trust.low_price_share(obs(spark, d))


@query("SELECT product_id, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS \"at\", count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return trust.duplicate_keys(obs(spark, d))


@query("WITH RECURSIVE e AS (SELECT event_type, user_id, epoch_us(ts) AS us FROM events), c AS (SELECT event_type, user_id, min(us) AS us FROM e GROUP BY ALL UNION ALL SELECT c.event_type, c.user_id, (SELECT min(e.us) FROM e WHERE e.event_type = c.event_type AND e.user_id = c.user_id AND e.us >= c.us + 43200000000) AS us FROM c WHERE c.us IS NOT NULL) SELECT event_type, user_id, us FROM c WHERE us IS NOT NULL", prelude=False)
def alert_dedup_cooldown(spark, d):
    return changes.cooldown(events(spark, d), ["event_type", "user_id"], 12)


@query("SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 40", prelude=False)
def digest_topk_per_type(spark, d):
    top = changes.top_per_group(events(spark, d), "event_type", [F.desc("value"), F.col("event_id")], 40)
    return top.select("event_type", "event_id", "value", F.col("rank").cast("long").alias("rank"))


@query("SELECT strftime(time_bucket(INTERVAL 24 HOUR, ts, TIMESTAMP '1970-01-01 22:00:00'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL", prelude=False)
def cadence_window_tumbling(spark, d):
    return windows.anchored(events(spark, d)).drop("total")


@query("q AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL (2 * i) HOUR AS w FROM events, range(3) t(i)) SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM q GROUP BY ALL")
def sliding_window_counts(spark, d):
    return windows.sliding(events(spark, d))


@query("SELECT event_id, user_id, n FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 3", prelude=False)
def rate_limit_rejections(spark, d):
    return windows.over_limit(events(spark, d), 86400, 3)


@query("q AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM q) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM r GROUP BY user_id, g")
def session_windows(spark, d):
    return windows.sessions(events(spark, d))


@query("SELECT match_id, site, eff, rank() OVER (PARTITION BY match_id ORDER BY eff) AS rank, dense_rank() OVER (PARTITION BY match_id ORDER BY eff) AS dense, row_number() OVER (PARTITION BY match_id ORDER BY eff, site) AS number FROM latest")
def offer_rank(spark, d):
    return analytics.offer_rank(obs(spark, d))


@query("SELECT site, category, count(*) AS n, count(DISTINCT product_id) AS products FROM s GROUP BY ROLLUP (site, category)")
def rollup_site_category(spark, d):
    return analytics.rollup_counts(obs(spark, d))


@query("SELECT brand AS value, count(DISTINCT product_id) AS products FROM s GROUP BY brand ORDER BY products DESC, value LIMIT 20")
def facets_topk(spark, d):
    return analytics.facets(obs(spark, d), "brand")


def products(spark, d) -> DataFrame:
    return obs(spark, d).select("product_id", "site", "name").distinct()


@query("SELECT DISTINCT product_id, site, name, CASE WHEN lower(name) = 'red bo' THEN 0 WHEN starts_with(lower(name), 'red bo') THEN 1 WHEN starts_with(lower(name), 'red') THEN 2 ELSE 3 END AS rank FROM s WHERE contains(' ' || lower(name), ' red') AND contains(' ' || lower(name), ' bo')")
def search_prefix_rank(spark, d):
    return matching.search(products(spark, d), "red bo")


@query("q AS (SELECT product_id, unnest(string_split(lower(name), ' ')) AS w FROM (SELECT DISTINCT product_id, name FROM s)), r AS (SELECT w, count(DISTINCT product_id) AS products, levenshtein(left(w, 4), 'bult') AS errors FROM q GROUP BY w) SELECT w, products, errors FROM r WHERE errors <= 1 ORDER BY errors, products DESC, w LIMIT 10")
def levenshtein_suggest(spark, d):
    words = matching.suggest(products(spark, d), "bult", 10)
    return words


@query(r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/?$', 1) AS slug FROM pages", prelude=False)
def url_parse(spark, d):
    return table(spark, d, "pages").select("page_id", *files.url_parts(F.col("url")))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages", prelude=False)
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", files.page_text(F.col("html")).alias("text"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY event_type", prelude=False)
def json_props(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(F.get_json_object("props", "$.k")).alias("kinds"))


@query("q AS (SELECT DISTINCT product_id, site, name || ' ' || brand || ' ' || category AS name FROM s) SELECT name AS key, count(DISTINCT site) AS sites, min(product_id) AS cluster FROM q GROUP BY name HAVING count(*) = count(DISTINCT site) AND count(*) >= 2")
def same_name_groups(spark, d):
    """Exact names here, so that the oracle needs no folding; same_key_groups folds them."""
    p = obs(spark, d).select("product_id", "site", F.concat_ws(" ", "name", "brand", "category").alias("name")).distinct()
    g = p.groupBy(F.col("name").alias("key")).agg(F.count("*").alias("n"), F.countDistinct("site").alias("sites"), F.min("product_id").alias("cluster"))
    return g.where("n = sites and sites >= 2").drop("n")


@query(f"q AS (SELECT DISTINCT product_id, site, {text.fold_sql("name || ' ' || brand || ' ' || category")} AS key FROM s) SELECT key, count(DISTINCT site) AS sites, min(product_id) AS cluster FROM q GROUP BY key HAVING count(*) = count(DISTINCT site) AND count(*) >= 2")
def same_key_groups(spark, d):
    p = obs(spark, d).select("product_id", "site", F.concat_ws(" ", "name", "brand", "category").alias("name")).distinct()
    return matching.same_key_groups(p)


@query(f"q AS (SELECT product_id, site, arg_max(eff, (k1, k2, k3, k4, k5, k6)) FILTER (run_id = {BEFORE}) AS old, arg_max(eff, (k1, k2, k3, k4, k5, k6)) FILTER (run_id = {RUN}) AS new FROM s WHERE run_id IN ({RUN}, {BEFORE}) GROUP BY ALL) SELECT product_id, site, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'gone' ELSE 'price_changed' END AS state, old, new FROM q WHERE old IS DISTINCT FROM new")
def store_diff(spark, d):
    return ingest.store_diff(obs(spark, d), RUN, BEFORE)


@query("q AS (SELECT run_id, site, count(DISTINCT product_id) AS products FROM s GROUP BY ALL), r AS (SELECT *, count(*) OVER w AS h, CAST(sum(products) OVER w AS BIGINT) AS t FROM q WINDOW w AS (PARTITION BY site ORDER BY run_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT run_id, site, products, CAST(t AS DOUBLE) / h AS mean, 2 * products * h < t AS alarm FROM r WHERE h >= 2")
def smoke_test(spark, d):
    return ingest.smoke_test(obs(spark, d))


@query("SELECT product_id, site, arg_max(name, (k1, k2, k3, k4, k5, k6)) FILTER (name <> '') AS name, arg_max(brand, (k1, k2, k3, k4, k5, k6)) FILTER (brand <> '') AS brand, arg_max(category, (k1, k2, k3, k4, k5, k6)) FILTER (category <> '') AS category, arg_max(discount_cents, (k1, k2, k3, k4, k5, k6)) FILTER (discount_cents IS NOT NULL) AS last_discount, min(run_id) AS first_run, max(run_id) AS last_run FROM s GROUP BY product_id, site")
def upsert_merge(spark, d):
    return ingest.merged(obs(spark, d))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.07)", prelude=False)
def orphans_anti_join(spark, d):
    discounted = table(spark, d, "lineitem").where("l_discount >= 0.07")
    return ingest.orphans(table(spark, d, "orders"), "o_orderkey", discounted, "l_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT field, nulls, n, nulls > 0.8 * n AS too_many FROM (SELECT 'discount_cents' AS field, count(*) FILTER (discount_cents IS NULL) AS nulls, count(*) AS n FROM s UNION ALL SELECT 'price_cents', count(*) FILTER (price_cents IS NULL), count(*) FROM s)")
def null_shares(spark, d):
    return ingest.null_shares(obs(spark, d), ["discount_cents", "price_cents"])


@query("SELECT site, count(*) AS listings, count(DISTINCT product_id) AS products, count(DISTINCT brand) AS brands, avg(eff) AS mean, count(discount_cents) AS on_sale FROM s GROUP BY site")
def site_summary(spark, d):
    return ingest.site_summary(obs(spark, d))


@query("SELECT product_id, price_cents, count(DISTINCT run_id) AS runs, count(DISTINCT run_id) >= 2 AS promoted FROM s GROUP BY product_id, price_cents")
def confirmed_prices(spark, d):
    return ingest.confirmed_prices(obs(spark, d))


def _event_stream(spark, d):
    # Globbed, as a stream takes a folder or a pattern, and the table may be a file.
    return twins.stream(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query(ORACLES["alert_dedup_cooldown"], prelude=False)
def stream_cooldown(spark, d):
    return twins.drained(twins.cooldown(_event_stream(spark, d), 12))


@query("WITH w AS (SELECT time_bucket(INTERVAL 24 HOUR, ts, TIMESTAMP '1970-01-01 22:00:00') AS start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n FROM w WHERE start + INTERVAL 25 HOUR <= (SELECT max(ts) FROM events)", prelude=False)
def stream_anchored(spark, d):
    """Windows that the watermark, an hour behind the newest event, has closed."""
    counts = twins.drained(twins.anchored(_event_stream(spark, d)))
    return counts.select(F.date_format("w.start", windows.SECONDS).alias("start"), "event_type", "n")


@query("WITH q AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM q) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM r GROUP BY user_id, g HAVING max(ts) + INTERVAL 90 MINUTE <= (SELECT max(ts) FROM events)", prelude=False)
def stream_sessions(spark, d):
    counts = twins.drained(twins.sessions(_event_stream(spark, d)))
    return counts.select("user_id", F.date_format("w.start", windows.SECONDS).alias("start"), "n")


from . import brands, catalogue, comparison, curation, decisions, feeds, intake, lineage, names, near, resolution, review, scans, settings, state, written  # noqa: E402, F401 - registers its queries
