"""Recommendations of all kinds in one list, and the table that keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import analytics, changes, lineage

# Severities in the order of the list.
ORDER = ("critical", "warning", "opportunity", "info")


def promo_responses(obs: DataFrame, runs: DataFrame, client: str, top: int = 10) -> DataFrame:
    """site, title: promotions in each rival's latest eligible run, in order of site and title."""
    at = lineage.financial_runs(runs).where(F.col("site") != client).select("site", "run_id")
    return changes.promotions(obs).join(F.broadcast(at), ["site", "run_id"]).orderBy("site", "title").limit(top).select("site", "title")


def merged(obs: DataFrame, stock: DataFrame, runs: DataFrame, client: str, per_type: int = 10, with_gaps: bool = True) -> DataFrame:
    """type, severity, match_id, site, target, gap_bp, gap_cents of the best of each kind, the gravest and widest first;
    clusters that the client lacks are a kind of their own, which can be left out."""
    rank = lambda df, *by: df.orderBy(*by).limit(per_type)
    columns = ("type", "severity", "match_id", "site", "target", "gap_bp", "gap_cents")
    none = F.lit(None).cast("long")
    up = rank(analytics.price_raises(obs, stock), F.desc("gap_bp"), "match_id").select(F.lit("price_raise").alias("type"), F.lit("opportunity").alias("severity"), "match_id", "site", "target", "gap_bp", (F.col("target") - F.col("client")).alias("gap_cents"))
    down = rank(analytics.undercut_responses(obs, stock), F.desc("gap_bp"), "match_id").select(F.lit("undercut").alias("type"), "severity", "match_id", "site", "target", "gap_bp", (F.col("rival") - F.col("client")).alias("gap_cents"))
    gaps = analytics.assortment_gaps(obs, per_type).select(F.lit("assortment_gap").alias("type"), F.lit("info").alias("severity"), "match_id", F.lit(None).cast("string").alias("site"), F.col("price").alias("target"), none.alias("gap_bp"), none.alias("gap_cents"))
    promos = promo_responses(obs, runs, client, per_type).select(F.lit("promo_response").alias("type"), F.lit("warning").alias("severity"), none.alias("match_id"), "site", none.alias("target"), none.alias("gap_bp"), none.alias("gap_cents"))
    every = up.select(*columns).unionByName(down.select(*columns)).unionByName(promos.select(*columns))
    every = every.unionByName(gaps.select(*columns)) if with_gaps else every
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("severity"))
    return every.orderBy(place, F.desc(F.abs(F.coalesce("gap_bp", F.lit(0)))), "type", "match_id", "site")


def impact(actions: DataFrame) -> DataFrame:
    """opportunity, loss, total (cents a unit) and count of a list of actions."""
    gap = F.coalesce("gap_cents", F.lit(0))
    return actions.agg(F.sum(F.greatest(gap, F.lit(0))).alias("opportunity"), F.sum(F.least(gap, F.lit(0))).alias("loss"), F.sum(gap).alias("total"), F.count("*").alias("count"))


def cached(cache: DataFrame, tenant_id: int, client: str, epoch: str | None, fingerprint: str) -> DataFrame:
    """The kept list of a tenant and client, only if it rests on the current epoch and policy: none without an epoch."""
    own = cache.where((F.col("tenant_id") == tenant_id) & (F.col("client_site") == client))
    valid = (F.col("epoch") == F.lit(epoch)) & (F.col("fingerprint") == fingerprint)
    return own.where(F.coalesce(valid, F.lit(False))).select("payload", "computed_at")


def as_json(actions: DataFrame) -> DataFrame:
    """One JSON text an action, for the cache and for other systems."""
    return actions.select(F.to_json(F.struct(*actions.columns)).alias("payload"))


def said(actions: DataFrame) -> DataFrame:
    """actions with a title in words."""
    euros = lambda c: F.format_string("%d.%02d", F.expr(f"{c} div 100"), F.expr(f"{c} % 100"))
    title = F.when(F.col("type") == "price_raise", F.concat(F.lit("Raise to "), euros("target"), F.lit(", rival "), "site")).when(F.col("type") == "undercut", F.concat("site", F.lit(" is cheaper, go to "), euros("target")))
    title = title.when(F.col("type") == "assortment_gap", F.concat(F.lit("Not listed, rivals ask "), euros("target"))).otherwise(F.concat(F.lit("Promotion at "), "site"))
    return actions.withColumn("title", title)
