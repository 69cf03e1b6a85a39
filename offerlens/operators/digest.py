"""Who gets which alerts, and what fits into a digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks of severities, rows of a kind and of a digest, and kinds in the order that digests name them.
RANKS = {"critical": 3, "warning": 2, "info": 1}
KIND_ROWS, DIGEST_ROWS = 30, 60
KINDS = ("undercut_threshold", "price_drop_pct", "price_change_pct", "promo_started", "site_drop_smoke", "price_raise_opportunity", "new_product")


def rank(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair)), severity), F.lit(0))


def passes(threshold: Column, severity: Column, default: str) -> Column:
    """Whether a severity is at least the threshold; 'off' lets nothing through, none stands for the default."""
    wanted = F.coalesce(F.nullif(threshold, F.lit("")), F.lit(default))
    return (wanted != "off") & (rank(severity) >= rank(wanted))


def is_quiet(hours: Column, now: Column) -> Column:
    """Whether now is in quiet hours 'HH-HH', which may go over midnight; anything else is never quiet."""
    start, end = (F.regexp_extract(hours, r"^(\d{1,2})-(\d{1,2})$", i).try_cast("int") for i in (1, 2))
    minutes = F.hour(now) * 60 + F.minute(now)
    inside = F.when(start < end, (minutes >= start * 60) & (minutes < end * 60)).otherwise((minutes >= start * 60) | (minutes < end * 60))
    return F.coalesce((start <= 23) & (end <= 23) & inside, F.lit(False))


def routed(events: DataFrame, users: DataFrame, now: str) -> DataFrame:
    """user_id, channel, events, critical: what goes to each user of a tenant, one message a channel.

    Mail goes from warning on, unless the user takes a daily digest; the messenger from critical on, outside quiet
    hours. Events that have gone out stay out."""
    # Events are counted before they meet the users, who tell only tenants and severities apart.
    counted = events.where(F.size(F.coalesce("channels_sent", F.array().cast("array<string>"))) == 0).groupBy("tenant_id", "severity").agg(F.count("*").alias("n"))
    met = counted.join(users.where("is_active"), "tenant_id")
    mail = ~F.col("daily_digest") & passes(F.col("email_min"), F.col("severity"), "warning")
    chat = F.col("chat_id").isNotNull() & ~is_quiet(F.col("quiet_hours"), F.lit(now).cast("timestamp")) & passes(F.col("chat_min"), F.col("severity"), "critical")
    channels = F.array_compact(F.array(F.when(mail, "email"), F.when(chat, "chat")))
    one = met.select("user_id", "severity", "n", F.explode(channels).alias("channel"))
    return one.groupBy("user_id", "channel").agg(F.sum("n").alias("events"), F.sum(F.when(F.col("severity") == "critical", F.col("n")).otherwise(0)).alias("critical"))


def bucket(severity: Column) -> Column:
    return F.when(severity.isin("critical", "warning"), severity).otherwise("info")


def quotas(counts: list[tuple[str, str, int, bool]]) -> dict[tuple[str, str], int]:
    """Rows of each (kind, bucket), from counts (kind, bucket, events, whether any has a size).

    Critical ones come first, then warnings, each shared out evenly with the smallest first; what is left goes to the
    others in order, whole or, if their sizes tell which matter, in part."""
    n = {(k, b): c for k, b, c, _ in counts}
    sized = {k for k, b, _, s in counts if b == "info" and s}
    worst = {k: min("critical warning info".split().index(b) for x, b, *_ in counts if x == k) for k, *_ in counts}
    kinds = sorted(worst, key=lambda k: (worst[k], KINDS.index(k) if k in KINDS else len(KINDS), k))
    used, left, out = dict.fromkeys(kinds, 0), DIGEST_ROWS, {}
    for b in ("critical", "warning"):
        wanted = {k: min(n.get((k, b), 0), KIND_ROWS - used[k]) for k in kinds}
        wanted = {k: w for k, w in wanted.items() if w > 0}
        for i, k in enumerate(sorted(wanted, key=wanted.__getitem__)):
            out[k, b] = min(wanted[k], -(-left // (len(wanted) - i)))
            used[k] += out[k, b]
            left -= out[k, b]
    for k in kinds:
        room = max(0, min(KIND_ROWS - used[k], left))
        events = n.get((k, "info"), 0)
        if events and (events <= room or k in sized):
            out[k, "info"] = min(events, room)
            left -= out[k, "info"]
    return out


def selected(events: DataFrame) -> DataFrame:
    """events (rule_type, severity, size_bp, id) that a digest names, the largest of each kind and severity first.

    Only counts by kind and severity, which are few, are decided on in the driver."""
    e = events.withColumn("bucket", bucket(F.col("severity"))).withColumn("size", F.abs(F.coalesce("size_bp", F.lit(0))))
    counts = e.groupBy("rule_type", "bucket").agg(F.count("*").alias("n"), F.max(F.col("size") > 0).alias("sized")).collect()
    plan = [(k, b, q) for (k, b), q in quotas([tuple(r) for r in counts]).items()]
    room = events.sparkSession.createDataFrame(plan, "_kind string, _bucket string, quota int")
    place = F.row_number().over(Window.partitionBy("rule_type", "bucket").orderBy(F.desc("size"), "id"))
    met = e.join(room, (F.col("rule_type") == F.col("_kind")) & (F.col("bucket") == F.col("_bucket"))).withColumn("place", place)
    return met.where(F.col("place") <= F.col("quota")).select("id", "rule_type", "bucket", "place")


def summary(events: DataFrame) -> DataFrame:
    """By kind: events of each bucket and of each site, for the heading of a digest."""
    b = bucket(F.col("severity"))
    return events.groupBy("rule_type", "site").agg(*(F.count_if(b == x).alias(x) for x in ("critical", "warning", "info")))


def top_events(events: DataFrame, n: int = 20) -> DataFrame:
    """The gravest and largest events."""
    return events.orderBy(F.desc(rank(F.col("severity"))), F.desc(F.abs("size_bp")), "id").limit(n)


def lineage_ok(events: DataFrame, runs: DataFrame, eligible: DataFrame) -> DataFrame:
    """Events whose source run may be told about: eligible ones, or local price changes of a good partial run."""
    whole = events.join(eligible.select(F.col("id").alias("source_run_id")), "source_run_id", "left_semi")
    local = events.where(F.col("rule_type").isin("price_drop_pct", "price_change_pct")).join(runs.select(F.col("id").alias("source_run_id")), "source_run_id", "left_semi")
    return whole.unionByName(local).dropDuplicates(["id"])


def overdue(latest: DataFrame, hours: dict[str, int], now: str) -> DataFrame:
    """site, age_hours, overdue from the start of each site's latest run (site, started_at)."""
    limits = latest.sparkSession.createDataFrame(list(hours.items()), "site string, hours int")
    age = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))) / 3600)
    df = F.broadcast(limits).join(latest.select("site", "started_at"), "site", "left")
    return df.select("site", age.cast("long").alias("age_hours"), F.coalesce(age > F.col("hours"), F.lit(True)).alias("overdue"))
