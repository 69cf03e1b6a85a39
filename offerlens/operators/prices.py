"""Latest, as-of and journal primitives over observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapter import CLIENT, SITES, effective


def with_effective(obs: DataFrame) -> DataFrame:
    return obs.withColumn("eff", effective(F.col("price_cents"), F.col("discount_cents")))


def latest(obs: DataFrame, by: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """The last observation of each key: one aggregation with partial maxima, which carries all columns of obs, so give it
    those that are needed."""
    rest = [c for c in obs.columns if c not in by]
    return obs.groupBy(*by).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*by, "r.*")


def latest_by_match(obs: DataFrame) -> DataFrame:
    """match_id, category, brand and the current effective price at each site (null where not listed)."""
    now = with_effective(latest(obs.select("product_id", "match_id", "site", "category", "brand", "price_cents", "discount_cents", "seq")))
    # Of several products of a site in a cluster the mean counts, in whole cents.
    mean = lambda s: F.expr(f"sum(if(site = '{s}', eff, null)) div count(if(site = '{s}', eff, null))")
    at = [mean(s).alias(s) for s in SITES]
    return now.groupBy("match_id").agg(F.first("category").alias("category"), F.first("brand").alias("brand"), *at)


def as_of_previous(obs: DataFrame, run_id: int) -> DataFrame:
    """For products seen in a run: the run's last price and the last one before the run."""
    df = with_effective(obs.where(F.col("run_id") <= run_id))
    current = F.col("run_id") == run_id
    both = df.groupBy("product_id", "site", "match_id").agg(
        F.max_by("eff", F.when(current, F.col("seq"))).alias("eff"),
        F.max_by("price_cents", F.when(current, F.col("seq"))).alias("regular"),
        F.max_by("eff", F.when(~current, F.col("seq"))).alias("previous"),
        F.max_by("price_cents", F.when(~current, F.col("seq"))).alias("previous_regular"),
    )
    return both.where("eff is not null")


def journal(obs: DataFrame) -> DataFrame:
    """Observations whose price or discount differs from the one before: what a change-only store keeps."""
    state = F.struct("price_cents", "discount_cents")
    before = F.lag(state).over(Window.partitionBy("product_id").orderBy("seq"))
    return obs.withColumn("before", before).where(F.col("before").isNull() | ~state.eqNullSafe(F.col("before"))).drop("before")


def daily_last(obs: DataFrame) -> DataFrame:
    """product_id, day, captured_at, eff: the last effective price of each product and day."""
    narrow = with_effective(obs).select("product_id", F.to_date("captured_at").alias("day"), "captured_at", "eff", "seq")
    return narrow.groupBy("product_id", "day").agg(F.max_by(F.struct("captured_at", "eff"), "seq").alias("r")).select("product_id", "day", "r.*")


def client_pairs(obs: DataFrame) -> DataFrame:
    """match_id, category, brand, site, client, rival: one row for each rival that lists what the client lists."""
    rivals = [s for s in SITES if s != CLIENT]
    m = latest_by_match(obs).where(F.col(CLIENT).isNotNull())
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("site"), F.col(s).alias("rival")) for s in rivals)))
    return m.select("match_id", "category", "brand", F.col(CLIENT).alias("client"), pairs.alias("p")).select("match_id", "category", "brand", "client", "p.*").where("rival is not null")
