"""The comparison of a cluster's prices across sites: what is compared, on which basis, and what the rows add up to.

A cluster has an entry a site at most, so its entries are one small array, and all that follows are expressions over
it in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lineage

# Prices below this part of the median (or above its inverse) are misread; from this spread on a row wants a look.
OUTLIER, REVIEW = 0.12, 50.0


def age_days(seen: Column, now: str) -> Column:
    """Whole days since a moment; never below 0, null if there is none."""
    return F.greatest(F.lit(0), F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(seen.cast("timestamp"))) / 86400)).cast("long")


def _ends(of: Column, field: str) -> tuple[Column, Column]:
    values = F.transform(of, lambda x: x[field])
    return F.array_min(values), F.array_max(values)


def _spread(of: Column, field: str) -> Column:
    low, high = _ends(of, field)
    return (high - low) / high * 100


def entries(products: DataFrame, sites: tuple[str, ...], ages: dict[str, int], now: str, stale_days: int) -> DataFrame:
    """One row an offer that counts: match_id, site, at (the site's place in order), product_id, price, unit, pack, sure, age, stale, out.

    Of several products of a site in a cluster the newest counts. Products that are sold out are entries with out set,
    unless the site sells another one of the cluster or has not shown it for long."""
    state = lineage.offers(products, ages, now).where(F.col("site").isin(*sites) & F.col("match_id").isNotNull())
    age = age_days(F.col("last_seen_at"), now)
    state = state.withColumns({"age": age, "stale": F.coalesce(age > stale_days, F.lit(False))})
    selling = F.col("eligible")
    ended = ~selling & (F.col("reason") == "out_of_stock") & ~F.col("stale")
    priced = F.col("price_cents") > 0
    chosen = F.struct("product_id", "price_cents", "pack", "age", "stale")
    a = state.groupBy("match_id", "site").agg(F.max_by(chosen, F.when(selling & priced, F.col("product_id"))).alias("on"), F.max(selling).alias("sells"), F.max_by(chosen, F.when(ended, F.col("product_id"))).alias("off"))
    a = a.withColumn("out", F.col("on").isNull()).where(F.col("on").isNotNull() | (F.col("off").isNotNull() & ~F.col("sells"))).withColumn("e", F.coalesce("on", "off"))
    at = F.array_position(F.array(*map(F.lit, sites)), F.col("site")).cast("int")
    price = F.when(F.col("e.price_cents") > 0, F.col("e.price_cents").cast("double"))
    return a.select("match_id", "site", at.alias("at"), F.col("e.product_id").alias("product_id"), price.alias("price"), (price / F.greatest("e.pack", F.lit(1))).alias("unit"), F.col("e.pack").alias("pack"), (F.col("e.pack") > 1).alias("sure"), F.col("e.age").alias("age"), (F.col("e.stale") & ~F.col("out")).alias("stale"), "out")


def compared(rows: DataFrame) -> DataFrame:
    """rows (a key and es, an array of entries in order of site) with basis, kept (the entries left), low, high, cheapest and spread.

    Only fresh offers count. Prices a unit are compared where packs differ twofold, one of them is certain and that makes
    the spread smaller. What is far from the median is dropped; with less than two prices left there is no spread."""
    df = rows.withColumn("fresh", F.filter("es", lambda e: ~e["stale"] & ~e["out"]))
    fewest, most = _ends(F.col("fresh"), "pack")
    by_unit = (F.size("fresh") >= 2) & F.exists("fresh", lambda e: e["sure"]) & (most >= 2 * fewest) & (_spread(F.col("fresh"), "unit") < _spread(F.col("fresh"), "price"))
    df = df.withColumn("basis", F.when(by_unit, "unit").otherwise("raw"))
    value = lambda e: F.when(F.col("basis") == "unit", e["unit"]).otherwise(e["price"])
    df = df.withColumn("median", F.get(F.array_sort(F.transform("fresh", value)), F.expr("int(size(fresh) div 2)")))
    near = lambda e: (F.size("fresh") < 2) | ((value(e) >= F.col("median") * OUTLIER) & (value(e) <= F.col("median") / OUTLIER))
    df = df.withColumn("kept", F.filter("es", lambda e: e["stale"] | e["out"] | near(e))).withColumn("live", F.filter("fresh", near))
    values = F.transform("live", value)
    enough = F.size("live") >= 2
    df = df.withColumns({"low": F.when(enough, F.array_min(values)), "high": F.when(enough, F.array_max(values))})
    df = df.withColumn("cheapest", F.get(F.transform(F.filter("live", lambda e: value(e) == F.col("low")), lambda e: e["site"]), F.lit(0)))
    return df.withColumn("spread", F.when(enough, (F.col("high") - F.col("low")) / F.col("high") * 100)).drop("fresh", "median", "live")


def comparison_rows(products: DataFrame, matches: DataFrame, sites: tuple[str, ...], ages: dict[str, int], now: str, stale_days: int = lineage.STALE_DAYS, least_sites: int = 2, least_confidence: float = 0.70, unavailable: bool = False, category: str | None = None) -> DataFrame:
    """One row a cluster: match_id, name, confidence, is_manual, entries, n_priced, basis, low, high, cheapest, spread, needs_review.

    The first of the sites is the client. Left out are clusters whose countries clash, whose client page is dead, that
    are too uncertain (unless made by hand), and those with too few sites."""
    client = sites[0]
    clear = lineage.identity_of_clusters(products).where("eligible").select("match_id")
    dead = products.where((F.col("site") == client) & F.col("dead")).select("match_id").distinct()
    found = entries(products, sites, ages, now, stale_days)
    found = found if unavailable else found.where("not out")
    grouped = found.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("at", "site", "product_id", "price", "unit", "pack", "sure", "age", "stale", "out"))).alias("es"))
    grouped = grouped.join(clear, "match_id", "left_semi").join(dead, "match_id", "left_anti")
    if category is not None:
        grouped = grouped.join(products.where((F.col("site") == client) & (F.col("category") == category)).select("match_id").distinct(), "match_id", "left_semi")
    df = compared(grouped).withColumn("n_priced", F.size(F.filter("kept", lambda e: ~e["out"])))
    df = df.where((F.col("n_priced") > 0) & (F.size("kept") >= least_sites))
    sure = matches.where(F.col("is_manual") | (F.coalesce("confidence", F.lit(1.0)) >= least_confidence))
    return df.join(sure, "match_id").select("match_id", "name", "confidence", "is_manual", F.col("kept").alias("entries"), "n_priced", "basis", "low", "high", "cheapest", "spread", (F.coalesce("spread", F.lit(0.0)) >= REVIEW).alias("needs_review"))


def ordered(rows: DataFrame) -> DataFrame:
    """The widest spread first; rows without one last."""
    return rows.orderBy(F.coalesce("spread", F.lit(-1.0)).desc(), "match_id")


def _value(e: Column) -> Column:
    return F.when(F.col("basis") == "unit", e["unit"]).otherwise(e["price"])


def _own(site: str) -> Column:
    return F.get(F.filter("entries", lambda e: (e["site"] == site) & ~e["stale"] & ~e["out"]), F.lit(0))


def position(client: str) -> Column:
    """equal, cheapest, priciest or middle; null where the client has no price that counts or there is nothing to compare."""
    own = _own(client)
    found = F.when(F.col("low") == F.col("high"), "equal").when(_value(own) == F.col("low"), "cheapest").when(_value(own) == F.col("high"), "priciest").otherwise("middle")
    return F.when(own.isNotNull() & F.col("low").isNotNull(), found)


def difference_counts(rows: DataFrame, client: str) -> DataFrame:
    """One row of the counts that a price report opens with; compared is differing + same_price + not_comparable."""
    at = position(client)
    differ = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    return rows.agg(
        F.count("*").alias("compared"),
        F.count_if(differ).alias("differing"),
        F.count_if(differ & at.isNotNull() & (at != "cheapest")).alias("competitor_cheaper"),
        F.count_if(differ & (at == "cheapest")).alias("client_cheapest"),
        F.count_if(differ & at.isNull()).alias("no_client_price"),
        F.count_if(F.col("low") == F.col("high")).alias("same_price"),
        F.count_if(F.col("low").isNull()).alias("not_comparable"),
    )


def pair_counts(rows: DataFrame, sites: tuple[str, ...]) -> DataFrame:
    """a, b, common, same_price, a_cheaper, b_cheaper for each pair of sites, on each row's basis."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _value(_own(a)).alias("x"), _value(_own(b)).alias("y")) for i, a in enumerate(sites) for b in sites[i + 1 :]))
    p = rows.select(F.explode(pairs).alias("p")).select("p.*").where("x is not null and y is not null")
    return p.groupBy("a", "b").agg(F.count("*").alias("common"), F.count_if(F.expr("x = y")).alias("same_price"), F.count_if(F.expr("x < y")).alias("a_cheaper"), F.count_if(F.expr("y < x")).alias("b_cheaper"))


def by_stock(rows: DataFrame, mode: str, client: str) -> DataFrame:
    """rival: the client sells what some rival has run out of; own: the other way round."""
    own = F.get(F.filter("entries", lambda e: e["site"] == client), F.lit(0))
    rivals = F.filter("entries", lambda e: e["site"] != client)
    if mode == "rival":
        return rows.where(own.isNotNull() & ~own["out"] & F.exists(rivals, lambda e: e["out"]))
    if mode == "own":
        return rows.where(own.isNotNull() & own["out"] & F.exists(rivals, lambda e: ~e["out"]))
    raise ValueError(f"unknown stock filter {mode!r}")


def notes(rows: DataFrame) -> DataFrame:
    """match_id, cheapest_sites and note: every site at the least price, and remarks on basis, old and ended offers."""
    at_low = F.filter("entries", lambda e: ~e["stale"] & ~e["out"] & (_value(e) == F.col("low")))
    remarks = F.concat(
        F.when(F.col("basis") == "unit", F.array(F.lit("per unit"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter("entries", lambda e: e["stale"]), lambda e: F.concat(e["site"], F.lit(": "), e["age"].cast("string"), F.lit(" days old"))),
        F.transform(F.filter("entries", lambda e: e["out"]), lambda e: F.concat(e["site"], F.lit(": out of stock"))),
        F.when(F.col("needs_review"), F.array(F.lit("check the match"))).otherwise(F.array().cast("array<string>")),
    )
    return rows.select("match_id", F.when(F.col("low").isNotNull(), F.array_join(F.transform(at_low, lambda e: e["site"]), ", ")).otherwise("").alias("cheapest_sites"), F.array_join(remarks, ". ").alias("note"))


def feed(rows: DataFrame) -> DataFrame:
    """match_id and a JSON object of prices by site, for other systems."""
    return rows.select("match_id", F.to_json(F.map_from_entries(F.transform("entries", lambda e: F.struct(e["site"], e["price"].cast("long"))))).alias("prices"))
