"""Everything that a run changed, from one scan; and the kept list of recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def by_product(obs: DataFrame, run_id: int, before: int | None) -> DataFrame:
    """One row a product, from one scan up to the run: its last effective price in the run and before it, the first run, and
    whether it was on promotion in the run and in the one before.

    obs: product_id, match_id, site, category, eff, on_promo, run_id, seq."""
    now, old = F.col("run_id") == run_id, F.col("run_id") < run_id
    last = lambda cond, c: F.max_by(F.when(cond, F.col(c)), F.when(cond, F.col("seq")))
    return obs.where(F.col("run_id") <= run_id).groupBy("product_id", "match_id", "site", "category").agg(
        last(now, "eff").alias("eff"),
        last(old, "eff").alias("previous"),
        F.min("run_id").alias("first_run"),
        F.coalesce(F.max(now & F.col("on_promo")), F.lit(False)).alias("promo"),
        F.coalesce(F.max((F.col("run_id") == F.lit(before)) & F.col("on_promo")), F.lit(False)).alias("promo_before"),
    )


def analyse(obs: DataFrame, run_id: int, before: int | None, client: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Four tables (undercuts, price_changes, new_products, promo_changes) and one of their counts (what, n).

    Nothing is known before a first run (before is None): then only undercuts, and counts of products and promotions.
    The scan is done once; the counts of what it holds are observed while it is written."""
    seen = Observation("run")
    flags = by_product(obs, run_id, before)
    moved = F.expr("previous > 0 and abs(eff - previous) >= 1")
    watched = flags.observe(seen, F.count_if(moved).alias("price_changes"), F.count_if(F.col("first_run") == run_id).alias("new_products"), F.count_if(F.col("eff").isNotNull()).alias("products"))
    facts = stored(watched)
    current = facts.select("match_id", "site", F.coalesce("eff", "previous").alias("price"))
    own = current.where(F.col("site") == client).groupBy("match_id").agg(F.min("price").alias("client"))
    rivals = current.where(F.col("site") != client).groupBy("match_id", "site").agg(F.min("price").alias("rival"))
    undercuts = stored(own.join(rivals, "match_id").where("rival < client and rival * 10 >= client").select("match_id", "site", "client", "rival"))
    found = {"undercuts": undercuts}
    counts = {"undercuts": undercuts.count(), "products": seen.get["products"]}
    if before is None:
        counts["promotions"] = facts.where("promo").select("site", "category").distinct().count()
    else:
        titles = facts.groupBy("site", "category").agg(F.max("promo").alias("now"), F.max("promo_before").alias("old")).where("now <> old")
        found["price_changes"] = facts.where(moved).select("product_id", "site", "previous", "eff")
        found["new_products"] = facts.where(F.col("first_run") == run_id).select("product_id", "site")
        found["promo_changes"] = stored(titles.select("site", "category", F.when(F.col("now"), "started").otherwise("ended").alias("change")))
        counts |= {"price_changes": seen.get["price_changes"], "new_products": seen.get["new_products"], "promo_changes": found["promo_changes"].count()}
    return found, obs.sparkSession.createDataFrame([(k, int(n)) for k, n in counts.items()], "what string, n long")


#: A publication of a list: whose, what it rests on, its number, how many items it has, and one of them.
PUBLISHED = "tenant_id long, client_site string, epoch string, fingerprint string, run_id long, seq long, items long, at timestamp_ntz, place long, payload string"


def publish(items: DataFrame, folder: str, tenant_id: int, client: str, epoch: str | None, fingerprint: str, run_id: int, seq: int, at: str) -> None:
    """Adds a list (place, payload) to the table in the folder. The one before is superseded, not changed.

    Refused without an epoch. Each row says how many the list has, so a reader takes no list that is not there in full."""
    if epoch is None:
        raise ValueError("there is no trusted epoch to publish for")
    kept = stored(items.select(F.col("place").cast("long"), "payload"))
    n = kept.count()
    own = [F.lit(tenant_id).cast("long").alias("tenant_id"), F.lit(client).alias("client_site"), F.lit(epoch).alias("epoch"), F.lit(fingerprint).alias("fingerprint"), F.lit(run_id).cast("long").alias("run_id"), F.lit(seq).cast("long").alias("seq"), F.lit(n).cast("long").alias("items"), F.lit(at).cast("timestamp_ntz").alias("at")]
    # A list without items is one row without a place.
    body = kept if n else kept.sparkSession.createDataFrame([(None, None)], "place long, payload string")
    body.select(*own, "place", "payload").write.mode("append").partitionBy("tenant_id", "client_site").parquet(folder)


def publications(published: DataFrame) -> DataFrame:
    """tenant_id, client_site, seq, epoch, fingerprint, run_id, at, state: current, superseded or incomplete, of every list."""
    lists = published.groupBy("tenant_id", "client_site", "seq").agg(*(F.first(c).alias(c) for c in ("epoch", "fingerprint", "run_id", "at", "items")), F.count("place").alias("found"))
    whole = F.col("found") == F.col("items")
    newest = F.max(F.when(whole, F.col("seq"))).over(Window.partitionBy("tenant_id", "client_site"))
    state = F.when(~whole, "incomplete").when(F.col("seq") == newest, "current").otherwise("superseded")
    return lists.withColumn("state", state).drop("items", "found")


def current_items(published: DataFrame, tenant_id: int, client: str, epoch: str | None, fingerprint: str, now: str, hours: int) -> DataFrame:
    """place, payload of the current list, if it rests on this epoch and policy and is not older than so many hours; else nothing."""
    own = published.where((F.col("tenant_id") == tenant_id) & (F.col("client_site") == client))
    young = F.col("at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(hours)} hour")
    good = publications(own).where("state = 'current'").where(F.coalesce((F.col("epoch") == F.lit(epoch)) & (F.col("fingerprint") == fingerprint) & young, F.lit(False)))
    return own.join(good.select("seq"), "seq", "left_semi").where("place is not null").select("place", "payload")
