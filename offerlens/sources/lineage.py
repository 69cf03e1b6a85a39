"""The star-schema test tables seen as runs, products and offers, beside the observations of the adapter.

What the tables lack (statuses, countries, stock, dead links) follows from their keys by whole-number arithmetic,
so that oracles can say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapter import SITES, latest_observations, observations

#: Country codes that products get in turn; the second stands for an unresolved one.
COUNTRIES = ("de", None, "tr", "az", "fr")
STATUSES = ("in_stock", "in_stock", "in_stock", "out_of_stock", "unknown", "in_stock")


def _nth(values: tuple, n: str):
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.expr(f"cast({n} as int) + 1"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a month of observations: id, tenant_id, started_at, finished_at, status, scope, verified, mode, eligible_flag,
    full_sites (comma-separated), site_products and site_status (maps by site), and partition (a struct of counts)."""
    by_site = observations(spark, sf_dir).groupBy("run_id", "site").agg(F.countDistinct("product_id").alias("n"), F.min("captured_at").alias("a"), F.max("captured_at").alias("z"))
    status = F.when(F.expr("(run_id * 3 + length(site) + ascii(right(site, 1))) % 10 = 0"), "failed").otherwise("ok")
    df = by_site.groupBy("run_id").agg(
        F.min("a").alias("started_at"),
        F.max("z").alias("finished_at"),
        F.sum("n").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("site", "n")))).alias("site_products"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("site", status.alias("s"))))).alias("site_status"),
    )
    return df.select(
        F.col("run_id").alias("id"),
        F.expr("case when run_id % 19 = 0 then 2L else 1L end").alias("tenant_id"),
        "started_at",
        F.expr("case when run_id % 13 <> 0 then finished_at end").alias("finished_at"),
        F.expr("case when run_id % 13 = 0 then 'running' when run_id % 7 = 0 then 'failed' when run_id % 5 = 0 then 'degraded' else 'ok' end").alias("status"),
        F.expr("case when run_id % 4 = 1 then 'partial' else 'full' end").alias("scope"),
        F.expr("run_id % 3 <> 1 and run_id % 5 <> 0").alias("verified"),
        F.expr("case when run_id % 8 = 1 then 'watchlist' else 'scan' end").alias("mode"),
        F.expr("run_id % 6 <> 2").alias("eligible_flag"),
        F.expr("case run_id % 4 when 0 then 'client, rival_a,rival_b' when 2 then 'rival_b' when 3 then 'client,rival_a' end").alias("full_sites"),
        "site_products",
        "site_status",
        F.expr("struct(run_id % 9 <> 0 as complete, total, total - run_id % 30 as trusted, run_id % 30 as isolated, run_id % 28 as excluded)").alias("partition"),
    )


#: The same runs in SQL; site maps as rows of run_sites.
RUNS_SQL = """
run_sites AS (
    SELECT run_id, site, count(DISTINCT product_id) AS n, min(captured_at) AS a, max(captured_at) AS z,
           CASE WHEN (run_id * 3 + length(site) + ascii(right(site, 1))) % 10 = 0 THEN 'failed' ELSE 'ok' END AS s
    FROM s GROUP BY run_id, site),
runs AS (
    SELECT run_id AS id, CASE WHEN run_id % 19 = 0 THEN 2 ELSE 1 END AS tenant_id, min(a) AS started_at, CASE WHEN run_id % 13 <> 0 THEN max(z) END AS finished_at,
           CASE WHEN run_id % 13 = 0 THEN 'running' WHEN run_id % 7 = 0 THEN 'failed' WHEN run_id % 5 = 0 THEN 'degraded' ELSE 'ok' END AS status,
           CASE WHEN run_id % 4 = 1 THEN 'partial' ELSE 'full' END AS scope, run_id % 3 <> 1 AND run_id % 5 <> 0 AS verified,
           CASE WHEN run_id % 8 = 1 THEN 'watchlist' ELSE 'scan' END AS mode, run_id % 6 <> 2 AS eligible_flag,
           CASE run_id % 4 WHEN 0 THEN 'client, rival_a,rival_b' WHEN 2 THEN 'rival_b' WHEN 3 THEN 'client,rival_a' END AS full_sites,
           bool_and(s = 'ok') AS all_ok, run_id % 9 <> 0 AS complete, CAST(sum(n) AS BIGINT) AS total, run_id % 30 AS isolated, run_id % 28 AS excluded
    FROM run_sites GROUP BY run_id),
flags AS (
    SELECT *, scope = 'full' AND NOT verified AND complete AND total > isolated AND isolated BETWEEN 1 AND 25 AND isolated * 100 <= total AND excluded BETWEEN 1 AND 25 AS part FROM runs),
elig AS (
    SELECT *, scope = 'full' AND (verified OR part) AS publishable,
           scope = 'full' AND (verified OR part) AND eligible_flag AND ((status = 'ok' AND verified) OR (status = 'degraded' AND finished_at IS NOT NULL AND part)) AS eligible,
           status = 'ok' AND scope = 'partial' AND all_ok AS partial_ok
    FROM flags)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a listed product: product_id, match_id, site, name, brand, category, price_cents, country_code, country_status,
    availability, observed_at, last_seen_at, conflicted, dead, barcode, pack and tenant_id. The price is the last effective one."""
    from ..operators.prices import with_effective

    now = with_effective(latest_observations(spark, sf_dir))
    code = _nth(COUNTRIES, "(match_id + product_id div 7) % 5")
    return now.select(
        "product_id", "match_id", "site", "name", "brand", "category",
        F.col("eff").alias("price_cents"),
        code.alias("country_code"),
        F.when(code.isNotNull(), "resolved").otherwise("unknown").alias("country_status"),
        _nth(STATUSES, "product_id % 6").alias("availability"),
        F.expr("captured_at + make_interval(0, 0, 0, 0, product_id % 90)").alias("observed_at"),
        F.col("captured_at").alias("last_seen_at"),
        F.expr("product_id % 37 = 0").alias("conflicted"),
        F.expr("product_id % 41 = 0").alias("dead"),
        F.expr("case when match_id % 3 <> 0 then cast(4000000000000 + match_id as string) end").alias("barcode"),
        F.expr("1 + (match_id + product_id) % 4 * 10").alias("pack"),
        F.expr("case when match_id % 23 = 0 then 2L else 1L end").alias("tenant_id"),
    )


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


#: The same products in SQL.
PRODUCTS_SQL = f"""
products AS (
    SELECT product_id, match_id, site, name, brand, category, eff AS price_cents, {_list(COUNTRIES)}[(match_id + product_id // 7) % 5 + 1] AS country_code,
           {_list(STATUSES)}[product_id % 6 + 1] AS availability, captured_at + INTERVAL (product_id % 90) HOUR AS observed_at, captured_at AS last_seen_at,
           product_id % 37 = 0 AS conflicted, product_id % 41 = 0 AS dead, CASE WHEN match_id % 3 <> 0 THEN CAST(4000000000000 + match_id AS VARCHAR) END AS barcode,
           1 + (match_id + product_id) % 4 * 10 AS pack, CASE WHEN match_id % 23 = 0 THEN 2 ELSE 1 END AS tenant_id
    FROM latest)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, name, confidence and is_manual of every cluster."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("match_id"), F.col("p_name").alias("name"), F.expr("(50 + p_partkey % 50) / 100D").alias("confidence"), F.expr("p_partkey % 11 = 0").alias("is_manual"))


#: The same clusters in SQL.
MATCHES_SQL = "matches AS (SELECT p_partkey AS match_id, p_name AS name, CAST(50 + p_partkey % 50 AS DOUBLE) / 100 AS confidence, p_partkey % 11 = 0 AS is_manual FROM part)"
