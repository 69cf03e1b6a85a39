"""Where a product's price is going: a line through smoothed points, blended with the weekday's mean if weekdays matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trends(points: DataFrame, least: int = 3) -> DataFrame:
    """product_id, n, first, last, change_pct, direction, forecast, confidence from points (product_id, at, price > 0).

    Enough points: a least-squares line over prices smoothed with their neighbours (raw up to three points), seven days
    ahead, never below zero; with 14 points on five weekdays or more whose means vary by over five per cent, averaged
    with the mean of the weekday that lies ahead. Fewer: stable if there is one price, else a direction only."""
    by_time = Window.partitionBy("product_id").orderBy("at")
    whole = Window.partitionBy("product_id")
    df = points.where("price > 0").withColumns({"n": F.count("*").over(whole), "first_at": F.min("at").over(whole), "last_at": F.max("at").over(whole)})
    near = F.avg("price").over(by_time.rowsBetween(-1, 1))
    df = df.withColumn("y", F.when(F.col("n") > 3, near).otherwise(F.col("price").cast("double")))
    df = df.withColumn("x", (F.unix_seconds(F.col("at").cast("timestamp")) - F.unix_seconds(F.col("first_at").cast("timestamp"))) / 3600).withColumn("weekday", F.weekday("at"))
    by_day = df.groupBy("product_id", "weekday").agg(F.avg("price").alias("mean"))
    season = by_day.groupBy("product_id").agg(F.count("*").alias("weekdays"), F.avg("mean").alias("mean_of_days"), F.stddev_pop("mean").alias("spread_of_days"))
    a = df.groupBy("product_id").agg(
        F.count("*").alias("n"),
        F.min_by("price", F.struct("at", "price")).alias("first"),
        F.max_by("price", F.struct("at", "price")).alias("last"),
        F.countDistinct("price").alias("prices"),
        F.max("x").alias("last_x"),
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
        F.covar_pop("x", "y").alias("cov"),
        F.var_pop("x").alias("var"),
        F.avg(F.when(F.col("weekday") == F.weekday("last_at"), F.col("price"))).alias("ahead"),
    )
    a = a.join(season, "product_id")
    slope = F.when(F.col("var") > 0, F.col("cov") / F.col("var")).otherwise(0.0)
    line = F.greatest(F.lit(0.0), slope * (F.col("last_x") + 168) + F.col("my") - slope * F.col("mx"))
    seasonal = (F.col("n") >= 14) & (F.col("weekdays") >= 5) & (F.col("mean_of_days") > 0) & (F.col("spread_of_days") / F.col("mean_of_days") > 0.05)
    change = (F.col("last") - F.col("first")) * 100 / F.col("first")
    few, same = F.col("n") < least, F.col("prices") == 1
    forecast = F.when(few & same, F.col("last").cast("double")).when(few, F.lit(None).cast("double")).when(seasonal, (line + F.col("ahead")) / 2).otherwise(line)
    sure = F.when(few & same, "medium").when(few, "low").when(F.col("n") >= 14, "high").when(F.col("n") >= 7, "medium").otherwise("low")
    direction = F.when(F.abs(change) < 1.0, "stable").when(change > 0, "rising").otherwise("falling")
    return a.select("product_id", "n", "first", "last", change.alias("change_pct"), direction.alias("direction"), forecast.alias("forecast"), sure.alias("confidence"))


def with_still(found: DataFrame, products: DataFrame, since: str) -> DataFrame:
    """found, and products without a point that were seen since then: stable at their last price."""
    rest = products.where((F.col("last_seen_at") >= F.lit(since).cast("timestamp_ntz")) & (F.col("price_cents") > 0)).join(found.select("product_id"), "product_id", "left_anti")
    price = F.col("price_cents")
    still = rest.select("product_id", F.lit(0).cast("long").alias("n"), price.alias("first"), price.alias("last"), F.lit(0.0).alias("change_pct"), F.lit("stable").alias("direction"), price.cast("double").alias("forecast"), F.lit("medium").alias("confidence"))
    return found.unionByName(still)


def moves_ahead(found: DataFrame, products: DataFrame, client: str, top: int = 30) -> DataFrame:
    """match_id, site, last, change_pct, probability, forecast: rivals' products that fall by over five per cent, steepest first."""
    rivals = products.where(F.col("site") != client).select("product_id", "match_id", "site")
    falling = found.where("direction = 'falling' and change_pct < -5").join(rivals, "product_id")
    chance = F.when(F.col("change_pct") < -10, "high").otherwise("medium")
    return falling.select("match_id", "site", "last", "change_pct", chance.alias("probability"), "forecast").orderBy("change_pct", "match_id", "site").limit(top)


def seasonal_products(points: DataFrame) -> DataFrame:
    """product_id, weekdays, variation: products with 14 points on five weekdays or more whose means vary by over five per cent."""
    by_day = points.where("price > 0").groupBy("product_id", F.weekday("at").alias("weekday")).agg(F.sum("price").alias("total"), F.count("*").alias("n"))
    a = by_day.withColumn("mean", F.col("total") / F.col("n")).groupBy("product_id").agg(F.sum("n").alias("n"), F.count("*").alias("weekdays"), F.avg("mean").alias("m"), F.stddev_pop("mean").alias("s"))
    return a.where((F.col("n") >= 14) & (F.col("weekdays") >= 5) & (F.col("m") > 0) & (F.col("s") / F.col("m") > 0.05)).select("product_id", "weekdays", (F.col("s") / F.col("m")).alias("variation"))
