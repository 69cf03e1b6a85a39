"""Checks of the collection itself: each is a small DataFrame of issues, and a report is their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage


def _hours(since: Column, now: str) -> Column:
    return (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(since.cast("timestamp"))) / 3600


def _issue(df: DataFrame, code: str, severity: Column | str, site: Column | None = None) -> DataFrame:
    grade = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(code).alias("code"), grade.alias("severity"), (F.lit(None).cast("string") if site is None else site).alias("site"))


def issues(runs: DataFrame, sites: tuple[str, ...], ages: dict[str, int], now: str, tenant_id: int = 1, stale_hours: int = 26) -> DataFrame:
    """code, severity, site: no runs; the last run too old, failed or degraded; sites whose verified catalogue is overdue,
    and sites whose newest full attempt is missing or not to be relied on."""
    spark = runs.sparkSession
    last = lineage.latest_terminal(runs, tenant_id)
    limits = F.broadcast(spark.createDataFrame([(s, ages.get(s, stale_hours)) for s in sites], "site string, hours int"))
    good = lineage.financial_runs(runs, tenant_id).withColumn("age", _hours(F.col("started_at"), now)).join(limits, "site")
    fresh = good.where(F.col("age") <= F.col("hours")).select("site")
    limit = max([stale_hours, min(ages.values(), default=0)])
    any_fresh = fresh.agg((F.count("*") > 0).alias("any_fresh"))
    state = last.crossJoin(any_fresh)
    failed_grade = F.when((F.col("scope") == "partial") | F.col("any_fresh"), "warning").otherwise("critical")
    degraded_grade = F.when(F.col("any_fresh") | ~((F.col("scope") == "full") & ~F.col("verified")), "warning").otherwise("critical")
    tried = lineage.full_attempts(runs, tenant_id).select("site", "run_id")
    relied = lineage.eligible_runs(runs, tenant_id).select(F.col("id").alias("run_id"), F.lit(True).alias("good"))
    unproven = limits.select("site").join(tried, "site", "left").join(relied, "run_id", "left").where("good is null")
    unproven = unproven.join(fresh.withColumn("has_fresh", F.lit(True)), "site", "left")
    parts = [
        _issue(runs.agg(F.count_if((F.col("tenant_id") == tenant_id) & (F.col("status") != "running")).alias("n")).where("n = 0"), "no_runs", "warning"),
        _issue(last.where(_hours(F.col("started_at"), now) > limit), "stale_run", "critical"),
        _issue(good.where(F.col("age") > F.col("hours")), "full_catalog_overdue", "critical", F.col("site")),
        _issue(state.where("status = 'failed'"), "last_run_failed", failed_grade),
        _issue(state.where((F.col("status") == "degraded") & ~lineage.is_eligible()), "last_run_degraded", degraded_grade),
        _issue(unproven.where("run_id is null"), "full_catalog_missing", "warning", F.col("site")),
        _issue(unproven.where("run_id is not null"), "full_catalog_unverified", F.when(F.col("has_fresh"), "warning").otherwise("critical"), F.col("site")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brand_loss(products: DataFrame, since: str, least: int = 10) -> DataFrame:
    """now_total, now_branded, rest_total, rest_branded, lost: whether a run that saw a fair part of the catalogue found brands
    on under a fifth of its products while the rest has them on half or more."""
    seen = F.col("last_seen_at") >= F.lit(since).cast("timestamp_ntz")
    branded = F.col("brand").isNotNull()
    by_site = products.groupBy("site").agg(F.count_if(seen).alias("seen"), F.count("*").alias("catalogue"), F.count_if(seen & branded).alias("a"), F.count_if(~seen).alias("r"), F.count_if(~seen & branded).alias("b"))
    a = by_site.agg(F.sum("seen").alias("now_total"), F.sum("a").alias("now_branded"), F.sum("r").alias("rest_total"), F.sum("b").alias("rest_branded"), F.max_by("catalogue", F.struct("seen", "site")).alias("dominant"))
    fair = (F.col("now_total") >= least) & (F.col("rest_total") >= least) & (F.col("now_total") * 4 >= F.col("dominant"))
    lost = fair & (F.col("rest_branded") * 2 >= F.col("rest_total")) & (F.col("now_branded") * 5 < F.col("now_total"))
    return a.select("now_total", "now_branded", "rest_total", "rest_branded", lost.alias("lost"))


def silent(runs: DataFrame, sites: tuple[str, ...], hours: dict[str, int], now: str, tenant_id: int = 1) -> DataFrame:
    """site, last_success, silent, empty: sites without a good run for too long, and whether the newest run that names a site
    found nothing there."""
    wanted = F.broadcast(runs.sparkSession.createDataFrame([(s, hours.get(s, 30)) for s in sites], "site string, hours int"))
    own = runs.where(F.col("tenant_id") == tenant_id)
    rows = own.select("id", "started_at", "status", F.explode("site_products").alias("site", "n"))
    a = rows.groupBy("site").agg(F.max(F.when((F.col("n") > 0) & (F.col("status") == "ok"), F.col("started_at"))).alias("last"), F.max_by("n", "id").alias("n"), F.max_by("id", F.when((F.col("n") > 0) & (F.col("status") == "ok"), F.col("id"))).alias("last_success"))
    return wanted.join(a, "site", "left").select("site", "last_success", F.coalesce(_hours(F.col("last"), now) > F.col("hours"), F.lit(True)).alias("silent"), F.coalesce(F.col("n") == 0, F.lit(False)).alias("empty"))


def signature(found: DataFrame) -> DataFrame:
    """signature: one digest of an incident by its issues without what moves (ages, counts), so that it stays while the
    incident does; null without issues."""
    parts = F.array_sort(F.collect_set(F.concat_ws(":", "code", "severity", F.coalesce("site", F.lit("")))))
    return found.agg(F.when(F.count("*") > 0, F.sha2(F.array_join(parts, "|"), 256)).alias("signature"))


def incident_steps(signatures: DataFrame, remind_hours: int = 24) -> DataFrame:
    """at, step from reports (at, signature): incident for a new signature, reminder for one that goes on for so long since it was
    last told, recovery when it ends; nothing else is told. Reports of one place are few, and folded in order of time."""
    state = "struct<sig: string, told: bigint, out: array<struct<at: bigint, step: string>>>"
    rows = signatures.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.unix_seconds(F.col("at").cast("timestamp")).alias("at"), "signature"))).alias("rows"))

    def fold(acc: Column, r: Column) -> Column:
        step = F.when(r["signature"].isNotNull() & ~acc["sig"].eqNullSafe(r["signature"]), "incident").when(r["signature"].isNotNull() & (r["at"] - acc["told"] >= remind_hours * 3600), "reminder").when(r["signature"].isNull() & acc["sig"].isNotNull(), "recovery")
        out = F.when(step.isNotNull(), F.concat(acc["out"], F.array(F.struct(r["at"].alias("at"), step.alias("step"))))).otherwise(acc["out"])
        return F.struct(r["signature"].alias("sig"), F.when(step.isNotNull(), r["at"]).otherwise(acc["told"]).alias("told"), out.alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("sig"), F.lit(None).cast("long").alias("told"), F.array().cast("array<struct<at: bigint, step: string>>").alias("out")).cast(state)
    return rows.select(F.explode(F.aggregate("rows", start, fold)["out"]).alias("s")).select(F.timestamp_seconds("s.at").alias("at"), "s.step")


def history(runs: DataFrame, tenant_id: int = 1, page: int = 0, size: int = 20) -> DataFrame:
    """A page of runs, the newest first, with the products of sites that went well only."""
    good = F.map_filter("site_products", lambda s, n: F.element_at("site_status", s) == "ok")
    own = runs.where(F.col("tenant_id") == tenant_id).select("id", "status", "scope", F.aggregate(F.map_values(good), F.lit(0).cast("long"), lambda a, n: a + n).alias("good_products"))
    return own.orderBy(F.desc("id")).offset(page * size).limit(size)


def streaks(runs: DataFrame, tenant_id: int = 1) -> DataFrame:
    """status, first_run, last_run, runs: stretches of runs of one status."""
    w = Window.orderBy("id")
    own = runs.where(F.col("tenant_id") == tenant_id).select("id", "status").withColumn("new", (~F.col("status").eqNullSafe(F.lag("status").over(w))).cast("int"))
    return own.withColumn("g", F.sum("new").over(w)).groupBy("g", "status").agg(F.min("id").alias("first_run"), F.max("id").alias("last_run"), F.count("*").alias("runs")).drop("g")


def staleness(products: DataFrame, ages: dict[str, int], now: str, otherwise: int = 30) -> DataFrame:
    """site, last_seen_at, seconds since (null where never seen), hours allowed and stale of every site that has products."""
    hours = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ages.items() for x in pair)), F.col("site")), F.lit(otherwise)) if ages else F.lit(otherwise)
    seconds = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last_seen_at").cast("timestamp"))
    seen = products.groupBy("site").agg(F.max("last_seen_at").alias("last_seen_at")).select("*", seconds.alias("seconds"), hours.alias("hours"))
    return seen.withColumn("stale", F.coalesce(F.col("seconds") > F.col("hours") * 3600, F.lit(False)))


def snapshot(runs: DataFrame, products: DataFrame, sites: tuple[str, ...], ages: dict[str, int], now: str, tenant_id: int = 1) -> DataFrame:
    """One row of how things stand: status (up or degraded), the last run, whether a site is stale, and the full catalogues: missing,
    ok, degraded or failed, verified (each site's newest attempt went well, is verified and may be relied on), source_complete
    (each may be relied on, be it with a part set apart), when the last ended, and products set apart and trusted.

    Without a verified catalogue of every site the answer is degraded, a new installation included. A policy that isn't ready, that is
    a site whose catalogue may not be relied on, degrades too."""
    run = F.struct("finished_at", "id", "started_at", "status")
    tried = lineage.full_attempts(runs, tenant_id).where(F.col("site").isin(*sites)).select("site", F.col("run_id").alias("id"))
    well = (F.col("status") == "ok") & F.coalesce("verified", F.lit(False)) & F.coalesce("eligible_flag", F.lit(False)) & F.coalesce(F.element_at("site_status", F.col("site")) == "ok", F.lit(False))
    full = tried.join(runs, "id").select(
        F.lit(None).cast(f"struct<finished_at:{dict(runs.dtypes)['finished_at']},id:bigint,started_at:{dict(runs.dtypes)['started_at']},status:string>").alias("last"),
        well.alias("well"), lineage.is_eligible().alias("relied"), (F.col("status") == "failed").alias("failed"), F.coalesce("finished_at", "started_at").alias("ended"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("stale", "boolean"), ("apart", "bigint"), ("trusted", "bigint"))),
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in full.dtypes]
    with_ = lambda df, **made: df.select(*(made.get(c, none[i]).alias(c) for i, c in enumerate(full.columns)))
    own = products.where(F.col("tenant_id") == tenant_id).agg(F.count_if("conflicted").alias("apart"), F.count_if(~F.col("conflicted")).alias("trusted"))
    parts = [full, with_(lineage.latest_terminal(runs, tenant_id), last=run), with_(staleness(products, ages, now), stale=F.col("stale")), with_(own, apart=F.col("apart"), trusted=F.col("trusted"))]
    # A few rows each, brought together by a union and one aggregation.
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    yes = lambda c: F.coalesce(c, F.lit(False))
    a = every.agg(F.max("last").alias("last"), F.count("well").alias("n"), F.bool_and("well").alias("well"), F.bool_and("relied").alias("relied"), yes(F.bool_or("failed")).alias("failed"), F.max("ended").alias("ended"), yes(F.bool_or("stale")).alias("stale"), F.coalesce(F.max("apart"), F.lit(0)).alias("apart"), F.coalesce(F.max("trusted"), F.lit(0)).alias("trusted"))
    all_there = F.col("n") == len(sites)
    verified, complete = yes(F.col("well") & all_there), yes(F.col("relied") & all_there)
    bad = F.col("stale") | yes(F.col("last.status").isin("degraded", "failed")) | ~verified | ~complete
    return a.select(
        F.when(bad, "degraded").otherwise("up").alias("status"), F.col("last.id").alias("last_run_id"), F.col("last.status").alias("last_run_status"), "stale",
        F.when(F.col("n") == 0, "missing").when(F.col("failed"), "failed").when(verified, "ok").otherwise("degraded").alias("full_status"),
        verified.alias("verified"), complete.alias("source_complete"), F.col("ended").alias("full_ended_at"), "apart", "trusted",
    )
