"""Which runs and observations money-facing results may rest on, and checks of the data's health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapter import NOW, SITES


def run_counts(obs: DataFrame) -> DataFrame:
    """Distinct products by run and site."""
    return obs.groupBy("run_id", "site").agg(F.countDistinct("product_id").alias("products"))


def baselines(obs: DataFrame, last: int = 5) -> DataFrame:
    """For each run and site the true median of the counts of up to five runs before, and the run's quality:
    failed without products, degraded below half of the baseline, else ok."""
    w = Window.partitionBy("site").orderBy("run_id").rowsBetween(-last, -1)
    df = run_counts(obs).withColumn("past", F.array_sort(F.collect_list("products").over(w))).withColumn("n", F.size("past"))
    twice = F.get("past", F.expr("int((n - 1) div 2)")) + F.get("past", F.expr("int(n div 2)"))
    df = df.withColumn("twice", F.when(F.col("n") > 0, twice))
    quality = F.when(F.col("products") == 0, "failed").when(F.col("products") * 4 < F.col("twice"), "degraded").otherwise("ok")
    return df.select("run_id", "site", "products", (F.col("twice") / 2).alias("baseline"), quality.alias("quality"))


def eligible_runs(obs: DataFrame, sites: int = len(SITES)) -> DataFrame:
    """Runs with so many sites present and none degraded."""
    a = baselines(obs).groupBy("run_id").agg(F.bool_and(F.col("quality") == "ok").alias("ok"), F.count("*").alias("n"))
    return a.where(F.col("ok") & (F.col("n") == sites)).select("run_id")


def trusted(obs: DataFrame) -> DataFrame:
    """Observations of eligible runs."""
    return obs.join(eligible_runs(obs), "run_id", "left_semi")


def coverage(obs: DataFrame, now: str = NOW) -> DataFrame:
    """By site: distinct products, those of discounts and those of the last year. One row a product is made first, with partial
    aggregates, so that no row is doubled for each count."""
    recent = F.col("captured_at") >= F.lit(now).cast("timestamp_ntz") - F.expr("interval 365 days")
    one = obs.where("product_id is not null").groupBy("site", "product_id").agg(F.bool_or(F.col("discount_cents").isNotNull()).alias("promoted"), F.bool_or(recent).alias("recent"))
    a = one.groupBy("site").agg(F.count("*").alias("products"), F.count_if("promoted").alias("promoted"), F.count_if("recent").alias("recent"))
    return a.withColumn("recent_pct", F.col("recent") * 100 / F.col("products"))


def freshness(obs: DataFrame, now: str = NOW) -> DataFrame:
    """By site: the last observation and whole days since."""
    days = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))) / 86400)
    return obs.groupBy("site").agg(F.max("captured_at").alias("last")).select("site", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), F.greatest(F.lit(0), days).cast("long").alias("days"))


def site_drop(obs: DataFrame, days: int = 60, now: str = NOW) -> DataFrame:
    """By site: products of the last days against those of as many days before; dropped below half."""
    age = F.datediff(F.lit(now).cast("date"), F.to_date("captured_at"))
    a = obs.groupBy("site").agg(F.countDistinct(F.when(age <= days, F.col("product_id"))).alias("now"), F.countDistinct(F.when((age > days) & (age <= 2 * days), F.col("product_id"))).alias("before"))
    return a.withColumn("dropped", F.col("now") * 2 < F.col("before"))


def low_price_share(obs: DataFrame, below: int = 95000, least: int = 10) -> DataFrame:
    """By run and site: the share of prices below a floor where there are enough of them; the zero-price check with its floor as a parameter."""
    a = obs.groupBy("run_id", "site").agg(F.count("*").alias("n"), F.count_if(F.col("price_cents") < below).alias("low")).where(F.col("n") >= least)
    return a.withColumn("suspect", F.col("low") * 2 >= F.col("n"))


def duplicate_keys(obs: DataFrame) -> DataFrame:
    """Products observed more than once at one moment."""
    return obs.groupBy("product_id", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("at")).agg(F.count("*").alias("n")).where("n > 1")
