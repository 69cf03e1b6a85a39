"""Alert rules over what detectors find: thresholds, allowed kinds, cooldown, collapse of mass moves, and the inbox.

A detector is a function of observations and a run that returns rule_type, dedup_key, severity, site, subject and
size_bp; new ones are added to DETECTORS. Rules are few and broadcast; events are many and never leave the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import analytics, changes

COLUMNS = ("rule_type", "dedup_key", "severity", "site", "subject", "size_bp")
#: What a partial run may report: changes of the prices that it saw itself.
LOCAL = ("price_drop_pct", "price_change_pct")


def _events(df: DataFrame, rule_type: str, subject: str, size: Column, severity: Column) -> DataFrame:
    key = F.concat_ws(":", F.lit(rule_type), "site", F.col(subject).cast("string"))
    return df.select(F.lit(rule_type).alias("rule_type"), key.alias("dedup_key"), severity.alias("severity"), "site", F.col(subject).alias("subject"), size.cast("long").alias("size_bp"))


def drops(obs: DataFrame, run_id: int) -> DataFrame:
    return _events(changes.price_drops(obs, run_id), "price_drop_pct", "product_id", F.col("bp"), F.col("severity"))


def moves(obs: DataFrame, run_id: int, least_bp: int = 500, direction: str = "any") -> DataFrame:
    """Changes of so much in a direction (up, down, any)."""
    found = changes.price_changes(obs, run_id).where(F.abs("bp") >= least_bp)
    found = found if direction == "any" else found.where(F.col("bp") > 0 if direction == "up" else F.col("bp") < 0)
    return _events(found, "price_change_pct", "product_id", F.col("bp"), F.lit("info"))


def below_client(obs: DataFrame, run_id: int, least_bp: int = 500) -> DataFrame:
    found = changes.undercuts(obs.where(F.col("run_id") <= run_id), least_bp - 1)
    return _events(found, "undercut_threshold", "match_id", F.col("bp"), F.when(F.col("bp") >= 1000, "critical").otherwise("warning"))


def arrivals(obs: DataFrame, run_id: int) -> DataFrame:
    return _events(changes.new_products(obs.where(F.col("run_id") <= run_id), run_id), "new_product", "product_id", F.lit(0), F.lit("info"))


def raises(obs: DataFrame, run_id: int, least_bp: int = 700, most_bp: int = 8000) -> DataFrame:
    rival = analytics.cheapest_rival(obs.where(F.col("run_id") <= run_id)).where("rival > client").withColumn("bp", F.expr("(rival - client) * 10000 div client"))
    return _events(rival.where(F.col("bp").between(least_bp, most_bp - 1)), "price_raise_opportunity", "match_id", F.col("bp"), F.lit("opportunity"))


def promos(obs: DataFrame, run_id: int, before: int) -> DataFrame:
    """Promotions of a run that the run before did not have."""
    then = changes.promotions(obs).where(F.col("run_id") == before).select("site", "title")
    new = changes.promotions(obs).where(F.col("run_id") == run_id).join(then, ["site", "title"], "left_anti")
    return _events(new, "promo_started", "title", F.lit(0), F.lit("info")).withColumn("subject", F.xxhash64("subject"))


DETECTORS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "price_drop_pct": drops,
    "price_change_pct": moves,
    "undercut_threshold": below_client,
    "new_product": arrivals,
    "price_raise_opportunity": raises,
}


def allowed(eligible: bool, watchlist: bool) -> tuple[str, ...] | None:
    """Kinds of rules that a run may fire: all for an eligible one (None), local ones for a watchlist, else none."""
    return None if eligible else LOCAL if watchlist else ()


def candidates(obs: DataFrame, run_id: int, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """What the detectors of the allowed kinds find."""
    found = [f(obs, run_id).select(*COLUMNS) for kind, f in DETECTORS.items() if kinds is None or kind in kinds]
    if not found:
        return obs.sparkSession.createDataFrame([], "rule_type string, dedup_key string, severity string, site string, subject long, size_bp long")
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def fired(found: DataFrame, rules: DataFrame, log: DataFrame, now: str) -> DataFrame:
    """rule_id and the event: candidates over an active rule's threshold and of its site, of equal keys only that of the
    first rule, and none whose key is in the log within the rule's cooldown.

    rules: id, rule_type, least_bp, site, cooldown_hours, is_active. log: dedup_key, created_at."""
    active = rules.where("is_active").select(F.col("id").alias("rule_id"), F.col("rule_type").alias("kind"), "least_bp", F.col("site").alias("only"), "cooldown_hours")
    hit = found.join(F.broadcast(active), (F.col("rule_type") == F.col("kind")) & (F.abs("size_bp") >= F.col("least_bp")) & (F.col("only").isNull() | (F.col("only") == F.col("site"))))
    last = log.groupBy("dedup_key").agg(F.max("created_at").alias("last"))
    fresh = hit.join(last, "dedup_key", "left")
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    fresh = fresh.where(F.col("last").isNull() | (age >= F.col("cooldown_hours") * 3_600_000_000))
    first = F.row_number().over(Window.partitionBy("dedup_key").orderBy("rule_id"))
    return fresh.withColumn("first", first).where("first = 1").select("rule_id", *COLUMNS)


def collapsed(events: DataFrame, movers: DataFrame, kinds: tuple[str, ...] = LOCAL, least: int = 10, share: float = 0.5) -> DataFrame:
    """events with those of a mass move replaced by one summary each: so many events of one kind, site and direction that
    are so large a share of the site's movers (site, movers). n is the number of events that a row stands for."""
    way = F.when(F.col("rule_type").isin(*kinds), F.signum("size_bp").cast("int"))
    e = events.withColumn("way", way)
    groups = e.where("way is not null").groupBy("rule_type", "site", "way").agg(F.count("*").alias("n"), F.max("severity").alias("severity"), F.avg("size_bp").cast("long").alias("size_bp"))
    mass = groups.join(movers.select("site", "movers"), "site").where((F.col("n") >= least) & (F.col("n") >= share * F.col("movers")))
    gone = mass.select(F.col("rule_type").alias("_t"), F.col("site").alias("_s"), F.col("way").alias("_w"))
    kept = e.join(gone, (F.col("rule_type") == F.col("_t")) & (F.col("site") == F.col("_s")) & (F.col("way") == F.col("_w")), "left_anti")
    summary = mass.select("rule_type", F.concat_ws(":", F.lit("mass"), "rule_type", "site", F.col("way").cast("string")).alias("dedup_key"), "site", "n")
    return kept.select("rule_type", "dedup_key", "site", F.lit(1).cast("long").alias("n")).unionByName(summary)


def inbox(events: DataFrame, now: str, state: str = "unread", kind: str | None = None, path: str | None = None, value: str | None = None, page: int = 0, size: int = 50) -> DataFrame:
    """A page of the log: by state (unread, snoozed, read, all), kind and a value in the payload; the gravest and newest first."""
    at = F.lit(now).cast("timestamp")
    snoozed = F.coalesce(F.col("snoozed_until") > at, F.lit(False))
    states = {"unread": ~F.col("is_read") & ~snoozed, "snoozed": ~F.col("is_read") & snoozed, "read": F.col("is_read"), "all": F.lit(True)}
    df = events.where(states[state])
    df = df if kind is None else df.where(F.col("rule_type") == kind)
    df = df if path is None else df.where(F.get_json_object("payload", path) == value)
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in (("critical", 0), ("warning", 1), ("opportunity", 2), ("info", 3)) for x in pair)), F.col("severity"))
    return df.orderBy(F.coalesce(rank, F.lit(9)), F.desc("created_at"), "id").offset(page * size).limit(size)


def inbox_counts(events: DataFrame, now: str) -> DataFrame:
    """unread, snoozed and read in one pass."""
    snoozed = F.coalesce(F.col("snoozed_until") > F.lit(now).cast("timestamp"), F.lit(False))
    return events.agg(F.count_if(~F.col("is_read") & ~snoozed).alias("unread"), F.count_if(~F.col("is_read") & snoozed).alias("snoozed"), F.count_if(F.col("is_read")).alias("read"))


def marked(events: DataFrame, ids: DataFrame, read: bool | None = None, snooze_until: str | None = None) -> DataFrame:
    """The log with the events of ids (id) read or snoozed."""
    hit = events.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    out = hit if read is None else hit.withColumn("is_read", F.when(F.col("hit"), F.lit(read)).otherwise(F.col("is_read")))
    out = out if snooze_until is None else out.withColumn("snoozed_until", F.when(F.col("hit"), F.lit(snooze_until).cast("timestamp")).otherwise(F.col("snoozed_until")))
    return out.select(events.columns)


def destinations(events: DataFrame, products: DataFrame) -> DataFrame:
    """id and url: the page that an event is about: its own, that of its product, or that of its cluster at its site."""
    own = products.select(F.col("product_id").alias("_p"), F.col("url").alias("product_url"))
    cluster = products.groupBy(F.col("match_id").alias("_m"), F.col("site").alias("_s")).agg(F.min_by("url", "product_id").alias("cluster_url"))
    df = events.join(own, F.col("product_id") == F.col("_p"), "left").join(cluster, (F.col("match_id") == F.col("_m")) & (F.col("site") == F.col("_s")), "left")
    return df.select("id", F.coalesce(F.get_json_object("payload", "$.url"), "product_url", "cluster_url").alias("url"))


def error_key(*parts: str) -> Column:
    """One key for reports of one error: a digest of its parts with numbers made alike."""
    return F.sha2(F.regexp_replace(F.concat_ws("|", *parts), r"\d+", "#"), 256)
