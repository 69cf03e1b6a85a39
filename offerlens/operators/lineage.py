"""Which runs, prices and offers money-facing results may rest on: run envelopes, confirmation, latest attempts.

Runs are few (one row a collection), so what is derived from them is small; journals and observations are not, and
meet them in equi-joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What bounds an isolated part of a catalogue, and days after which an offer is stale.
MOST_ISOLATED, MOST_EXCLUDED, MOST_SHARE = 25, 25, 0.01
STALE_DAYS = 14


def has_partition() -> Column:
    """A complete source of which a small, counted part is set apart. Not the same as verification."""
    p = F.col("partition")
    whole = p["complete"] & (p["total"] == p["trusted"] + p["isolated"]) & (p["trusted"] > 0)
    small = p["isolated"].between(1, MOST_ISOLATED) & (p["isolated"] <= p["total"] * MOST_SHARE) & p["excluded"].between(1, MOST_EXCLUDED)
    return F.coalesce((F.col("scope") == "full") & ~F.col("verified") & whole & small, F.lit(False))


def is_publishable() -> Column:
    """A full catalogue that is verified, or of which only a small part is set apart."""
    return (F.col("scope") == "full") & (F.coalesce("verified", F.lit(False)) | has_partition())


def is_eligible(finalizing: int | None = None) -> Column:
    """What money-facing results may rest on. A run that is still going counts only if it is named."""
    done = F.when(F.col("status") == "ok", F.coalesce("verified", F.lit(False))).when(F.col("status") == "degraded", F.col("finished_at").isNotNull() & has_partition())
    done = done.when(F.col("status") == "running", F.col("id") == (-1 if finalizing is None else finalizing)).otherwise(False)
    return is_publishable() & F.coalesce("eligible_flag", F.lit(False)) & done


def may_alert_locally(mode: str | None = None) -> Column:
    """A partial run of which every site went well; of one mode, if asked for."""
    well = (F.size("site_status") > 0) & F.forall(F.map_values("site_status"), lambda s: s == "ok")
    found = (F.col("status") == "ok") & (F.col("scope") == "partial") & F.coalesce(well, F.lit(False))
    return found if mode is None else found & (F.col("mode") == mode)


def eligible_runs(runs: DataFrame, tenant_id: int = 1, include: int | None = None) -> DataFrame:
    return runs.where((F.col("tenant_id") == tenant_id) & is_eligible(include))


def latest_terminal(runs: DataFrame, tenant_id: int = 1) -> DataFrame:
    """The run that finished last; of equals the one of larger id."""
    done = runs.where((F.col("tenant_id") == tenant_id) & (F.col("status") != "running") & F.col("finished_at").isNotNull())
    return done.orderBy(F.desc("finished_at"), F.desc("id")).limit(1)


def _sites() -> Column:
    return F.explode(F.filter(F.transform(F.split("full_sites", ","), lambda s: F.trim(s)), lambda s: s != ""))


def full_attempts(runs: DataFrame, tenant_id: int = 1) -> DataFrame:
    """site, run_id, started_at: each site's newest finished attempt at a full catalogue, however it ended."""
    done = runs.where((F.col("tenant_id") == tenant_id) & (F.col("status") != "running") & F.col("finished_at").isNotNull() & (F.col("scope") == "full"))
    last = done.select(_sites().alias("site"), "id", "started_at", F.struct("finished_at", "id").alias("o")).groupBy("site").agg(F.max_by(F.struct("id", "started_at"), "o").alias("r"))
    return last.select("site", F.col("r.id").alias("run_id"), "r.started_at")


def financial_runs(runs: DataFrame, tenant_id: int = 1, before: int | None = None) -> DataFrame:
    """site, run_id, started_at: the latest eligible run in which each site went well, if asked for before some run."""
    good = eligible_runs(runs, tenant_id).where(F.lit(True) if before is None else F.col("id") < before)
    sites = good.select(F.explode("site_status").alias("site", "s"), "id", "started_at").where("s = 'ok'")
    return sites.groupBy("site").agg(F.max("id").alias("run_id"), F.max_by("started_at", "id").alias("started_at"))


def new_product_cutoffs(runs: DataFrame, sites: tuple[str, ...], current: int, tenant_id: int = 1) -> DataFrame:
    """site, cutoff: since when a product counts as new: the start of the site's eligible run before the current
    one, or the current one's own where there is none."""
    wanted = runs.sparkSession.createDataFrame([(s,) for s in sites], "site string")
    own = runs.where(F.col("id") == current).select(F.col("started_at").alias("own"))
    before = financial_runs(runs, tenant_id, current).select("site", "started_at")
    return wanted.join(before, "site", "left").crossJoin(F.broadcast(own)).select("site", F.coalesce("started_at", "own").alias("cutoff"))


def site_history(runs: DataFrame, tenant_id: int = 1) -> DataFrame:
    """site, last_attempt, last_success: the newest run that tried a site, and the newest that got it."""
    rows = runs.where(F.col("tenant_id") == tenant_id).select("id", "status", has_partition().alias("part"), F.explode("site_products").alias("site", "n"), F.col("site_status").alias("st"))
    good = (F.col("n") > 0) & (F.coalesce(F.element_at("st", F.col("site")), F.lit("ok")) == "ok") & ((F.col("status") == "ok") | F.col("part"))
    return rows.where("n > 0").groupBy("site").agg(F.max("id").alias("last_attempt"), F.max(F.when(good, F.col("id"))).alias("last_success"))


def epoch(runs: DataFrame, products: DataFrame, ages: dict[str, int], now: str, tenant_id: int = 1) -> DataFrame:
    """epoch: one row that names the exact runs behind the figures, and a digest of the products set apart; null
    unless each site's newest full attempt is publishable, eligible and younger than its hours."""
    limits = runs.sparkSession.createDataFrame(list(ages.items()), "site string, hours int")
    good = eligible_runs(runs, tenant_id).select(F.col("id").alias("run_id"), F.lit(True).alias("good"))
    state = F.broadcast(limits).join(full_attempts(runs, tenant_id), "site", "left").join(good, "run_id", "left")
    fresh = F.coalesce(F.col("good"), F.lit(False)) & (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp")) <= F.col("hours") * 3600)
    sites = state.agg(F.bool_and(F.coalesce(fresh, F.lit(False))).alias("ok"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site", "run_id"))), lambda x: F.concat_ws(":", x["site"], x["run_id"].cast("string"))), "|").alias("sites"))
    # Sums of hashes, not a list of ids: products set apart may be many.
    apart = products.where(F.col("conflicted") & (F.col("tenant_id") == tenant_id)).agg(F.count("*").alias("n"), F.sum(F.col("product_id")).alias("total"))
    both = sites.crossJoin(apart)
    return both.select(F.when(F.col("ok"), F.concat_ws("|", F.lit("v1"), "sites", F.when(F.col("n") > 0, F.concat(F.lit("isolated:"), F.sha2(F.concat_ws(",", F.col("n").cast("string"), F.col("total").cast("string")), 256))))).alias("epoch"))


def inputs_are_fresh(runs: DataFrame, ages: dict[str, int], now: str, tenant_id: int = 1) -> DataFrame:
    """site, run_id, attempt_id, fresh: whether a site's newest full attempt is its newest eligible run, and young enough."""
    limits = runs.sparkSession.createDataFrame(list(ages.items()), "site string, hours int")
    df = F.broadcast(limits).join(financial_runs(runs, tenant_id), "site", "left").join(full_attempts(runs, tenant_id).select("site", F.col("run_id").alias("attempt_id")), "site", "left")
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return df.select("site", "run_id", "attempt_id", F.coalesce((F.col("run_id") == F.col("attempt_id")) & (age <= F.col("hours") * 3600), F.lit(False)).alias("fresh"))


def confirmed_journal(obs: DataFrame, eligible: DataFrame) -> DataFrame:
    """The change-only journal with confirmed_run_id: the first eligible run that saw a price unchanged.

    Rows of obs are sorted once by product. Each belongs to the journal row that was current when it was seen; a run
    that wrote a row for a product confirms none of its others, and a row of an eligible run needs no confirmation."""
    ids = eligible.select(F.col("id").alias("run_id"), F.lit(True).alias("eligible"))
    state = F.struct("price_cents", "discount_cents")
    by_time = Window.partitionBy("product_id").orderBy("seq")
    df = obs.withColumn("before", F.lag(state).over(by_time)).withColumn("written", F.col("before").isNull() | ~state.eqNullSafe(F.col("before"))).drop("before")
    df = df.withColumn("number", F.sum(F.col("written").cast("long")).over(by_time)).withColumn("wrote", F.max("written").over(Window.partitionBy("product_id", "run_id")))
    df = df.join(F.broadcast(ids), "run_id", "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    seen = F.min(F.when(F.col("eligible") & ~F.col("wrote"), F.col("run_id"))).over(Window.partitionBy("product_id", "number"))
    return df.withColumn("confirmed_run_id", F.when(~F.col("eligible"), seen)).where("written").drop("written", "wrote")


def trusted(journal: DataFrame, products: DataFrame) -> DataFrame:
    """Journal rows of products whose identity is clear, written or confirmed by an eligible run."""
    apart = products.where("conflicted").select("product_id")
    return journal.where("eligible or confirmed_run_id is not null").join(apart, "product_id", "left_anti")


def offer_state(ages: dict[str, int], now: str, retired: Column | None = None) -> Column:
    """eligible and reason of a product's current offer, by the first rule that it breaks. Missing stock is unknown."""
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ages.items() for x in pair)), F.col("site")), F.lit(30))
    old = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("observed_at").cast("timestamp")) > limit * 3600
    reason = F.when(F.coalesce("conflicted", F.lit(False)), "identity_conflicted").when(F.lit(False) if retired is None else retired, "identity_retired").when(F.col("dead"), "dead_url")
    reason = reason.when(F.col("availability") == "out_of_stock", "out_of_stock").when(F.coalesce("availability", F.lit("unknown")) != "in_stock", "availability_unknown")
    reason = reason.when(F.coalesce(old, F.lit(True)), "availability_stale")
    return F.struct(reason.isNull().alias("eligible"), reason.alias("reason"))


def offers(products: DataFrame, ages: dict[str, int], now: str, enforce: bool = False) -> DataFrame:
    """Products with eligible and reason. Unless stock rules are enforced, an unknown or stale stock only is a remark."""
    state = products.withColumn("o", offer_state(ages, now))
    soft = F.col("o.reason").isin("availability_unknown", "availability_stale")
    return state.withColumn("eligible", F.col("o.eligible") | (F.lit(not enforce) & F.coalesce(soft, F.lit(False)))).withColumn("reason", F.when(~F.col("eligible"), F.col("o.reason"))).drop("o")


def identity_of_clusters(products: DataFrame, enforce: bool = False, key: str = "match_id") -> DataFrame:
    """key, eligible, reason: two resolved countries are a conflict; a product without one is unknown, which counts
    only where it is enforced. Products set apart have no say."""
    code = F.when(F.col("country_status") == "resolved", F.col("country_code"))
    clear = ~F.coalesce("conflicted", F.lit(False))
    a = products.groupBy(key).agg(F.min(F.when(clear, code)).alias("low"), F.max(F.when(clear, code)).alias("high"), F.max(clear & code.isNull()).alias("unknown"))
    reason = F.when(F.col("low") < F.col("high"), "country_conflict").when(F.lit(enforce) & F.col("unknown"), "country_unknown")
    return a.select(key, reason.isNull().alias("eligible"), reason.alias("reason"))


def cluster_policy(products: DataFrame, ages: dict[str, int], now: str, enforce: bool = False) -> DataFrame:
    """match_id, eligible, reason: the identity of a cluster first, then the first fault of its offers in order of product."""
    bad = offers(products, ages, now, enforce).where("not eligible").groupBy("match_id").agg(F.min_by("reason", "product_id").alias("offer"))
    both = identity_of_clusters(products, enforce).join(bad, "match_id", "left").withColumn("why", F.coalesce("reason", "offer"))
    return both.select("match_id", F.col("why").isNull().alias("eligible"), F.col("why").alias("reason"))


def of_tenant(df: DataFrame, tenant_id: int) -> DataFrame:
    """Rows of one tenant; every tenant's query goes through here."""
    return df.where(F.col("tenant_id") == tenant_id)
