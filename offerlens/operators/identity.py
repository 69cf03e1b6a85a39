"""Two names for one product at a site, an address and a number: which row gets the number, told in a ledger.

A pass of collection says which address has which number. Where that is one to one, the ledger adopts: the best of the rows
that either name stands for takes the number, the others are retired to it. Where it is not, the names are isolated. Entries
are ranked and complete, so a ledger replays to one state, and a pass that says nothing new adds no entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

ENTRIES = ("seq", "site", "product_id", "kind", "before", "after", "into")


def disputed(observed: DataFrame) -> DataFrame:
    """site, slug, number, fault of observations (site, slug, number) in which an address has several numbers or a number several addresses."""
    seen = observed.select("site", "slug", "number").where("site is not null and slug is not null and number is not null").distinct()
    n = seen.groupBy("site", "slug").agg(F.count("*").alias("numbers"))
    s = seen.groupBy("site", "number").agg(F.count("*").alias("slugs"))
    both = seen.join(n, ["site", "slug"]).join(s, ["site", "number"])
    fault = F.when((F.col("numbers") > 1) & (F.col("slugs") > 1), "both").when(F.col("numbers") > 1, "several_numbers").when(F.col("slugs") > 1, "several_addresses")
    return both.select("site", "slug", "number", fault.alias("fault")).where("fault is not null")


def proposals(state: DataFrame, observed: DataFrame, seq: int) -> DataFrame:
    """The entries of pass `seq`: seq, site, product_id, kind, before, after (numbers), into (the row that a retired one goes to).

    state: product_id, site, slug, number, retired, matched, last_seen_at. Of the rows of an address or its number, the best is
    that which has the number, then a matched one, then the last seen, then the oldest. Names that are disputed adopt
    nothing; their rows that have another number than the one seen are isolated."""
    seen = stored(observed.select("site", "slug", "number").where("site is not null and slug is not null and number is not null").distinct())
    bad = stored(disputed(seen))
    sound = seen.join(bad, ["site", "slug", "number"], "left_anti")
    live = state.where("not retired")
    by_slug = sound.join(live.drop("number"), ["site", "slug"]).select("site", F.col("number").alias("wanted"), "product_id")
    by_number = sound.select("site", "number").join(live.drop("slug"), ["site", "number"]).select("site", F.col("number").alias("wanted"), "product_id")
    rows = stored(by_slug.union(by_number).distinct().join(live.select("product_id", "number", "matched", "last_seen_at"), "product_id"))
    # A row that another number stands for is no candidate: an address may be given to another product.
    other = F.coalesce(F.col("number") != F.col("wanted"), F.lit(False))
    order = [F.coalesce(F.col("number") == F.col("wanted"), F.lit(False)).desc(), F.col("matched").desc(), F.col("last_seen_at").desc_nulls_last(), F.col("product_id").asc()]
    ranked = rows.where(~other).withColumn("rank", F.row_number().over(Window.partitionBy("site", "wanted").orderBy(*order)))
    best = ranked.where("rank = 1").select("site", "wanted", F.col("product_id").alias("best"))
    judged = ranked.join(best, ["site", "wanted"])
    kind = F.when((F.col("rank") == 1) & F.col("number").isNull(), "adopt").when(F.col("rank") > 1, "retire")
    told = stored(judged.select("site", "product_id", kind.alias("kind"), F.col("number").alias("before"), F.when(F.col("rank") == 1, F.col("wanted")).alias("after"), F.when(F.col("rank") > 1, F.col("best")).alias("into")).where("kind is not null"))
    moved = rows.where(other).select("site", "product_id", F.lit("isolate").alias("kind"), F.col("number").alias("before"), F.col("number").alias("after"), F.lit(None).cast("long").alias("into"))
    unclear = bad.select("site", "slug").distinct().join(live, ["site", "slug"]).select("site", "product_id", F.lit("isolate").alias("kind"), F.col("number").alias("before"), F.col("number").alias("after"), F.lit(None).cast("long").alias("into"))
    every = told.unionByName(moved.unionByName(unclear).distinct().join(told.select("product_id"), "product_id", "left_anti").select(told.columns))
    isolated = state.where("isolated").select("product_id", F.lit("isolate").alias("kind"))
    return every.join(isolated, ["product_id", "kind"], "left_anti").select(F.lit(seq).cast("long").alias("seq"), *ENTRIES[1:])


def replayed(start: DataFrame, ledger: DataFrame) -> DataFrame:
    """The state that the entries lead to. The last word on a row counts; a retired row stays so; adoption ends an isolation."""
    last = ledger.groupBy("product_id").agg(F.max_by(F.struct("kind", "after", "into"), "seq").alias("e"), F.max(F.col("kind") == "retire").alias("r"), F.max_by("into", F.when(F.col("kind") == "retire", F.col("seq"))).alias("into"))
    both = start.withColumnRenamed("into", "was_into").join(last, "product_id", "left")
    told = F.col("e").isNotNull()
    return both.withColumns({
        "into": F.coalesce("into", "was_into"),
        "number": F.when(told, F.col("e.after")).otherwise(F.col("number")),
        "retired": F.col("retired") | F.coalesce("r", F.lit(False)),
        "isolated": F.when(told, F.col("e.kind") == "isolate").otherwise(F.col("isolated")),
    }).select(*start.columns)


def ledger_faults(start: DataFrame, ledger: DataFrame) -> DataFrame:
    """product_id, fault: entries that do not follow from those before them, or that leave a number with two rows."""
    w = Window.partitionBy("product_id").orderBy("seq")
    chain = ledger.join(start.select("product_id", "number", F.lit(True).alias("known")), "product_id", "left").withColumn("previous", F.when(F.row_number().over(w) == 1, F.col("number")).otherwise(F.lag("after").over(w)))
    unknown = chain.where("known is null").select("product_id", F.lit("no such row").alias("fault"))
    broken = chain.where("known").where(~F.col("before").eqNullSafe(F.col("previous"))).select("product_id", F.lit("does not follow").alias("fault"))
    twice = ledger.groupBy("product_id", "seq").agg(F.count("*").alias("n")).where("n > 1").select("product_id", F.lit("two entries of one pass").alias("fault"))
    late = ledger.join(ledger.where("kind = 'retire'").select("product_id", F.col("seq").alias("gone")), "product_id").where("seq > gone").select("product_id", F.lit("after retirement").alias("fault"))
    end = replayed(start, ledger).where("not retired and number is not null")
    shared = end.withColumn("n", F.count("*").over(Window.partitionBy("site", "number"))).where("n > 1").select("product_id", F.lit("number twice").alias("fault"))
    return unknown.union(broken).union(twice).union(late).union(shared).distinct()


def final_rows(state: DataFrame) -> DataFrame:
    """product_id, final: for every retired row the live one at the end of its chain of retirements, however long."""
    ways = state.where("retired and into is not null").select("product_id", F.col("into").alias("final"))
    retired = ways.select(F.col("product_id").alias("final"), F.col("final").alias("next"))
    while not (more := ways.join(retired, "final")).isEmpty():
        ways = stored(ways.join(retired, "final", "left_anti").select("product_id", "final").union(more.select("product_id", F.col("next").alias("final"))))
    return ways
