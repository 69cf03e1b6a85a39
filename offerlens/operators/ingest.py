"""Ingest checks and merges: what a run adds to the catalogue, and whether it may."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prices import with_effective
from .trust import run_counts


def store_diff(obs: DataFrame, run_id: int, before: int) -> DataFrame:
    """product_id, site, state, old, new: products that are new, gone or of another price against an earlier run.

    A product's price in a run is that of its last observation. One aggregation over both runs serves as the
    full outer join."""
    last = lambda r: F.max_by("eff", F.when(F.col("run_id") == r, F.col("seq")))
    both = with_effective(obs).where(F.col("run_id").isin(run_id, before)).groupBy("product_id", "site")
    df = both.agg(F.max(F.col("run_id") == run_id).alias("is_new"), F.max(F.col("run_id") == before).alias("was"), last(before).alias("old"), last(run_id).alias("new"))
    state = F.when(~F.col("was"), "new").when(~F.col("is_new"), "gone").when(F.col("old") != F.col("new"), "price_changed")
    return df.select("product_id", "site", state.alias("state"), F.when(F.col("was"), F.col("old")).alias("old"), F.when(F.col("is_new"), F.col("new")).alias("new")).where("state is not null")


def smoke_test(obs: DataFrame, last: int = 5, least_history: int = 2) -> DataFrame:
    """run_id, site, products, mean, alarm: a count below half of the mean of up to five runs before, of which
    there must be two at least."""
    before = Window.partitionBy("site").orderBy("run_id").rowsBetween(-last, -1)
    df = run_counts(obs).withColumn("history", F.count("*").over(before)).withColumn("total", F.sum("products").over(before))
    return df.where(F.col("history") >= least_history).select("run_id", "site", "products", (F.col("total") / F.col("history")).alias("mean"), (2 * F.col("products") * F.col("history") < F.col("total")).alias("alarm"))


def merged(obs: DataFrame) -> DataFrame:
    """One row per product by the upsert policy: name, brand and category are the newest that are not empty,
    the discount the newest there ever was, first and last moments the extremes."""
    newest = lambda c: F.max_by(F.col(c), F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.col("seq")))
    named = [newest(c).alias(c) for c in ("name", "brand", "category")]
    # Dealt as they are: each of four newest values would carry an order of its own through the shuffle.
    dealt = obs.select("product_id", "site", "name", "brand", "category", "discount_cents", "run_id", "seq").repartition("product_id", "site")
    return dealt.groupBy("product_id", "site").agg(*named, newest("discount_cents").alias("last_discount"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; a null key has none."""
    return child.join(parent.select(F.col(parent_key).alias("_parent")).distinct(), F.col(key) == F.col("_parent"), "left_anti")


def null_shares(df: DataFrame, columns: list[str], most: float = 0.8) -> DataFrame:
    """field, nulls, n, too_many: one pass over all columns."""
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    rows = counts.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("nulls")) for c in columns))).alias("x"))
    return rows.select("x.field", "x.nulls", "n", (F.col("x.nulls") > most * F.col("n")).alias("too_many"))


def site_summary(obs: DataFrame) -> DataFrame:
    """By site: listing rows, distinct products, brands, the mean price and the number on sale."""
    a = with_effective(obs).groupBy("site")
    return a.agg(F.count("*").alias("listings"), F.countDistinct("product_id").alias("products"), F.countDistinct("brand").alias("brands"), F.avg("eff").alias("mean"), F.count("discount_cents").alias("on_sale"))


def confirmed_prices(obs: DataFrame) -> DataFrame:
    """product_id, price_cents, runs, promoted: prices seen in two different runs or more are promoted, others
    stay in quarantine."""
    seen = obs.groupBy("product_id", "price_cents").agg(F.countDistinct("run_id").alias("runs"))
    return seen.withColumn("promoted", F.col("runs") >= 2)
