"""What changed between runs, and the alerts that follow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import prices


def undercuts(obs: DataFrame, more_than_bp: int = -1) -> DataFrame:
    """Rivals below the client, but not below a tenth of its price; bp is the difference in basis points."""
    pairs = prices.client_pairs(obs).where("rival < client and rival * 10 >= client")
    return pairs.withColumn("bp", F.expr("(client - rival) * 10000 div client")).where(F.col("bp") > more_than_bp)


def price_changes(obs: DataFrame, run_id: int) -> DataFrame:
    """Products of a run whose effective price moved by a cent or more."""
    both = prices.as_of_previous(obs, run_id).where("previous > 0 and abs(eff - previous) >= 1")
    return both.withColumn("bp", F.expr("(eff - previous) * 10000 div previous"))


def price_drops(obs: DataFrame, run_id: int, least_bp: int = 1000) -> DataFrame:
    """Drops of ten per cent or more; promo says that the regular price did not fall."""
    drops = price_changes(obs, run_id).where(F.col("bp") <= -least_bp)
    severity = F.when(F.col("bp") <= -2000, "critical").otherwise("warning")
    return drops.withColumn("severity", severity).withColumn("promo", F.expr("regular >= previous_regular"))


def new_products(obs: DataFrame, run_id: int) -> DataFrame:
    """Products whose first observation is of the run."""
    return obs.groupBy("product_id", "site").agg(F.min("run_id").alias("first_run")).where(F.col("first_run") == run_id)


def promotions(obs: DataFrame, title: str = "category") -> DataFrame:
    """run_id, site, title: a promotion is a category (or what another column names) with a discount."""
    return obs.where("discount_cents is not null").select("run_id", "site", F.col(title).alias("title")).distinct()


def promo_diff(obs: DataFrame, run_id: int, before: int, title: str = "category") -> DataFrame:
    """Promotions that started or ended between two runs: a full outer join of two sets."""
    promos = promotions(obs, title)
    now, old = (promos.where(F.col("run_id") == r).select("site", "title", F.lit(True).alias(n)) for r, n in ((run_id, "now"), (before, "old")))
    both = now.join(old, ["site", "title"], "full_outer").where("now is null or old is null")
    return both.select("site", "title", F.when(F.col("old").isNull(), "started").otherwise("ended").alias("change"))


def mass_moves(obs: DataFrame, run_id: int, least: int = 10) -> DataFrame:
    """By site: movers of a run, those in the commoner direction, and whether to collapse them to one alert."""
    moved = price_changes(obs, run_id).groupBy("site").agg(F.count("*").alias("movers"), F.count_if(F.col("bp") < 0).alias("down"))
    major = F.greatest("down", F.col("movers") - F.col("down"))
    return moved.withColumn("major", major).withColumn("collapse", (major >= least) & (major * 2 >= F.col("movers")))


def cooldown(events: DataFrame, keys: list[str], hours: int) -> DataFrame:
    """Events that pass a cooldown per key, which runs from the last event that passed: a chain.

    Events are sorted by key and time in each task and read in one pass over batches, which carries the last time that
    passed; no key's events are held together."""
    step = hours * 3600 * 1_000_000
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0
        for batch in batches:
            us = batch["us"].to_numpy()
            marks = list(zip(*(batch[k].to_pylist() for k in keys)))
            kept = []
            for i, (mark, t) in enumerate(zip(marks, us.tolist())):
                if mark != key or t - last >= step:
                    key, last = mark, t
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    rows = events.select(*keys, F.unix_micros("ts").alias("us")).repartition(*keys).sortWithinPartitions(*keys, "us")
    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", us long")


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group; the limit on the rank lets tasks drop the rest early."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)
