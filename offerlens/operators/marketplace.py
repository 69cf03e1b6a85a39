"""A marketplace's venues: items out of their pages, groups of one item across venues, and comparison rows with an owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..sources.shared import spread, stored
from . import guards

# Fixed value: prices of one group may differ by this factor at most.
MOST_RATIO = 3.0


def items(pages: DataFrame) -> DataFrame:
    """venue, item_id, name, price_cents, original_cents, in_stock from pages (venue, body) of JSON: prices come in minor units, a
    balance of zero or less is out of stock, and an item that several pages have counts once, as the first says."""
    schema = "items array<struct<id: string, name: string, price: bigint, original_price: bigint, purchasable_balance: bigint>>"
    raw = pages.select("venue", F.posexplode(F.from_json("body", schema)["items"]).alias("at", "i")).where("i.id is not null and i.name is not null and i.price > 0")
    one = raw.groupBy("venue", F.col("i.id").alias("item_id")).agg(F.min_by("i", F.struct("at", F.col("i.name"))).alias("i"))
    dear = F.when(F.col("i.original_price") > F.col("i.price"), F.col("i.original_price"))
    return one.select("venue", "item_id", F.trim(F.regexp_replace("i.name", r"\s+", " ")).alias("name"), F.col("i.price").alias("price_cents"), dear.alias("original_cents"), F.coalesce(F.col("i.purchasable_balance") > 0, F.lit(True)).alias("in_stock"))


def groups(found: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    """group, venue, item_id: items of one folded name, dose and pack, one a venue, in two venues or more.

    A venue with two items of one key has none. A group of which any two items are told apart by a rule is dropped; an
    optional venue (the owner) that is told apart only drops out itself."""
    # Names are read once each and written, however many venues spell one alike.
    key = F.xxhash64(names.fold(F.col("norm")), names.dosage(F.col("name")), names.pack_size(F.col("name")))
    spelt = stored(guards.features(spread(found.select("name"), "name").distinct()).where("norm <> ''").withColumn("group", key))
    f = found.select("venue", "item_id", "name").join(spelt.select("name", "group"), "name")
    f = f.withColumn("_n", F.count("*").over(Window.partitionBy("group", "venue"))).where("_n = 1").drop("_n")
    f = stored(f.withColumn("spare", F.col("venue").isin(*optional) if optional else F.lit(False)))
    # Names that rules tell apart, in either order, of those that are left: at most one a venue and group.
    left = spelt.join(f.select("name").distinct(), "name", "left_semi")
    a, b = guards.side(left, "a_"), guards.side(left, "b_")
    apart = stored(a.join(b, F.col("a_group") == F.col("b_group")).where(guards.conflict("a_", "b_")).select(F.col("a_group").alias("group"), "a_name", "b_name"))
    one, two = (f.select("group", *(F.col(c).alias(f"{x}_{c}") for c in ("name", "venue", "spare"))) for x in "ab")
    clash = stored(apart.join(one, ["group", "a_name"]).join(two, ["group", "b_name"]).where("a_venue < b_venue").select(F.col("group").alias("a_group"), "a_venue", "a_spare", "b_venue", "b_spare"))
    broken = clash.where("not a_spare and not b_spare").select(F.col("a_group").alias("group")).distinct()
    dropped = clash.where("a_spare or b_spare").select(F.col("a_group").alias("group"), F.when(F.col("a_spare"), F.col("a_venue")).otherwise(F.col("b_venue")).alias("venue")).distinct()
    kept = f.select("group", "venue", "item_id", "spare").join(broken, "group", "left_anti").join(dropped, ["group", "venue"], "left_anti")
    return kept.withColumn("n", F.count(F.when(~F.col("spare"), 1)).over(Window.partitionBy("group"))).where("n >= 2").select("group", "venue", "item_id")


def comparison(members: DataFrame, found: DataFrame, owner: str | None = None) -> DataFrame:
    """group, venues, low, high, cheapest, owner_price of groups whose dearest price is not over three times the cheapest; only items in
    stock count, and an owner's price is shown beside them."""
    p = members.join(found.select("venue", "item_id", "price_cents", "in_stock"), ["venue", "item_id"])
    rival = F.col("in_stock") & (F.lit(True) if owner is None else F.col("venue") != owner)
    a = p.groupBy("group").agg(F.count_if(rival).alias("venues"), F.min(F.when(rival, F.col("price_cents"))).alias("low"), F.max(F.when(rival, F.col("price_cents"))).alias("high"), F.min(F.when(rival, F.struct("price_cents", "venue"))).alias("c"), F.max(F.when(F.col("venue") == F.lit(owner), F.col("price_cents"))).alias("owner_price"))
    return a.where((F.col("venues") >= 2) & (F.col("high") <= MOST_RATIO * F.col("low"))).select("group", "venues", "low", "high", F.col("c.venue").alias("cheapest"), "owner_price")


def venue_status(scans: DataFrame, now: str) -> DataFrame:
    """venue, last_ok, interrupted, hours from scans (venue, started_at, finished_at, status): the last good scan, and scans that never ended."""
    a = scans.groupBy("venue").agg(F.max(F.when(F.col("status") == "ok", F.col("finished_at"))).alias("last_ok"), F.count_if(F.col("finished_at").isNull()).alias("interrupted"))
    return a.withColumn("hours", F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last_ok").cast("timestamp"))) / 3600))
