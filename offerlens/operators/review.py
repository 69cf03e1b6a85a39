"""What people decide about clusters: what they are shown, what they pin, and what they change by hand.

Edits are moves as in `curation`, so they are applied, logged and undone like those of any other step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suggestions(matches: DataFrame, members: DataFrame, below: float = 0.85, flagged_only: bool = False, top: int = 100) -> DataFrame:
    """match_id, name, confidence, needs_review, spread_bp, products: clusters to look at, those first that are flagged, then those
    of wide prices, then the least sure; at most `top` of them.

    matches: match_id, name, confidence, is_manual, needs_review. members: match_id, product_id, price_cents. spread_bp is how
    far the cheapest is below the dearest, in basis points; null with fewer than two prices."""
    open_ones = matches.where(~F.col("is_manual") & (F.col("confidence") < below))
    if flagged_only:
        open_ones = open_ones.where("needs_review")
    good = F.when(F.col("price_cents") > 0, F.col("price_cents"))
    prices = members.groupBy("match_id").agg(F.min(good).alias("low"), F.max(good).alias("high"), F.count(good).alias("n"), F.count("*").alias("products"))
    spread = F.when(F.col("n") >= 2, F.expr("(high - low) * 10000 div high"))
    both = open_ones.join(prices, "match_id", "left").withColumn("spread_bp", spread)
    order = [F.desc("needs_review"), F.coalesce("spread_bp", F.lit(0)).desc(), F.asc("confidence"), F.asc("match_id")]
    return both.orderBy(*order).limit(top).select("match_id", "name", "confidence", "needs_review", "spread_bp", F.coalesce("products", F.lit(0)).alias("products"))


def address_key(url: Column) -> tuple[Column, Column]:
    """The number that the last part of an address is, else its name; without query, mark and strokes at the end."""
    last = F.element_at(F.split(F.rtrim(F.regexp_replace(url, r"[?#].*$", ""), F.lit("/")), "/"), -1)
    number = F.when(last.rlike(r"^\d{1,18}$"), last)
    return number, F.when(number.isNull(), F.nullif(F.lower(last), F.lit("")))


def at_addresses(products: DataFrame, addresses: DataFrame) -> DataFrame:
    """url, site, product_id, found: the products that each address (site, url) means, and how many there are of them.

    A number names one product (external_id); a name may be that of several (slug), of which none is picked."""
    number, slug = address_key(F.col("url"))
    asked = addresses.select("site", "url").distinct().select("site", "url", number.alias("_number"), slug.alias("_slug"))
    by_number = asked.join(products.select("site", F.col("external_id").alias("_number"), "product_id"), ["site", "_number"]).select("url", "site", "product_id")
    by_slug = asked.join(products.select("site", F.lower("slug").alias("_slug"), "product_id"), ["site", "_slug"]).select("url", "site", "product_id")
    found = by_number.union(by_slug).distinct()
    return found.withColumn("found", F.count("*").over(Window.partitionBy("site", "url")))


def pinned_moves(pins: DataFrame, state: DataFrame) -> DataFrame:
    """Moves that put pinned products into the clusters that pins (match_id, site, url, made by hand) name.

    state: product_id, site, url, match_id, dead, country_code, in_stock. A pin takes effect if its address is that of exactly one
    living product at the site, which is in stock; if the living members of the cluster from other sites and the other pinned products are of
    no other known country; and if it is the first pin of the cluster for its site. A product pinned twice goes to the first cluster."""
    asked = pins.where("url is not null and url <> ''").select("site", "url", F.col("match_id").alias("target"))
    exact = asked.join(state.where("not dead"), ["site", "url"]).select("target", "site", "url", "product_id", F.col("match_id").alias("before"), "country_code", "in_stock")
    exact = exact.withColumn("n", F.count("*").over(Window.partitionBy("target", "site", "url"))).where("n = 1 and in_stock")
    exact = exact.withColumn("turn", F.row_number().over(Window.partitionBy("target", "site").orderBy("product_id"))).where("turn = 1")
    exact = exact.withColumn("turn", F.row_number().over(Window.partitionBy("product_id").orderBy("target"))).where("turn = 1")
    inside = state.where("match_id is not null and not dead").select(F.col("match_id").alias("target"), F.col("site").alias("o_site"), F.col("country_code").alias("o_country"))
    every = inside.union(exact.select("target", "site", "country_code"))
    clash = exact.join(every, "target").where("site <> o_site and country_code <> o_country").select("product_id").distinct()
    sound = exact.join(clash, "product_id", "left_anti").where("before is null or before <> target")
    return sound.select("product_id", "before", F.col("target").alias("after"), F.lit("pinned").alias("reason"))


def edit_moves(edits: DataFrame, state: DataFrame) -> DataFrame:
    """Moves that edits ask for, and edits that are refused: product_id, before, after, reason, refused.

    edits: seq, kind, product_id, match_id. `remove` takes a product from the cluster that it is in; `add` puts it into the cluster,
    which must have no other product of its site; `swap` puts it in the place of the product of its site. Of several edits of one
    product the last counts. state: product_id, site, match_id."""
    last = edits.groupBy("product_id").agg(F.max_by(F.struct("kind", F.col("match_id").alias("target")), "seq").alias("e")).select("product_id", "e.*")
    asked = last.join(state, "product_id", "left").withColumnRenamed("match_id", "before")
    leaving = asked.where("kind = 'remove'").select(F.col("product_id").alias("gone"))
    there = state.where("match_id is not null").join(leaving, F.col("product_id") == F.col("gone"), "left_anti").select(F.col("match_id").alias("target"), "site", F.col("product_id").alias("holder"))
    wanted = Window.partitionBy("target", "site")
    comes = asked.where("kind <> 'remove'").withColumn("first", F.col("product_id") == F.min("product_id").over(wanted)).join(there, ["target", "site"], "left")
    why = F.when(F.col("site").isNull(), "no such product").when(F.col("holder") == F.col("product_id"), "already there").when(~F.col("first"), "two edits for one place").when((F.col("kind") == "add") & F.col("holder").isNotNull(), "the site has a product there").when((F.col("kind") == "swap") & F.col("holder").isNull(), "nothing to swap")
    judged = comes.withColumn("refused", why)
    moves = judged.select("product_id", "before", F.when(F.col("refused").isNull(), F.col("target")).otherwise(F.col("before")).alias("after"), "kind", "refused")
    out = judged.where("refused is null and kind = 'swap'").select(F.col("holder").alias("product_id"), F.col("target").alias("before"), F.lit(None).cast("long").alias("after"), F.lit("swapped_out").alias("kind"), F.lit(None).cast("string").alias("refused"))
    out = out.join(moves.where("refused is null").select("product_id"), "product_id", "left_anti").select("product_id", "before", "after", "kind", "refused")
    removed = asked.where("kind = 'remove'").select("product_id", "before", F.lit(None).cast("long").alias("after"), "kind", F.when(F.col("before").isNull() | ~F.coalesce(F.col("before") == F.col("target"), F.lit(False)), "not in that cluster").alias("refused"))
    removed = removed.withColumn("after", F.when(F.col("refused").isNotNull(), F.col("before")))
    return moves.unionByName(out).unionByName(removed).withColumnRenamed("kind", "reason")


def watched_categories(products: DataFrame, watched: DataFrame, client: str, sites: tuple[str, ...]) -> DataFrame:
    """category, products, matched, compared and missing_<site> for each watched category, dead products left out.

    products: product_id, site, category, match_id, dead. compared counts the client's clusters that another site is in,
    missing_<site> those that the site is not in."""
    alive = products.where("not dead").join(watched.select("category").distinct(), "category")
    rivals = [s for s in sites if s != client]
    elsewhere = products.where("not dead and match_id is not null").groupBy("match_id").agg(*(F.max((F.col("site") == s).cast("int")).alias(f"at_{s}") for s in rivals))
    own = alive.where((F.col("site") == client) & F.col("match_id").isNotNull()).select("category", "match_id").distinct().join(elsewhere, "match_id")
    some = F.greatest(*(F.col(f"at_{s}") for s in rivals)) if len(rivals) > 1 else F.col(f"at_{rivals[0]}")
    mine = own.groupBy("category").agg(F.count_if(some == 1).alias("compared"), *(F.count_if(F.col(f"at_{s}") == 0).alias(f"missing_{s}") for s in rivals))
    counts = alive.groupBy("category").agg(F.count("*").alias("products"), F.count("match_id").alias("matched"))
    found = watched.select("category").distinct().join(counts, "category", "left").join(mine, "category", "left")
    return found.na.fill(0, ["products", "matched", "compared", *(f"missing_{s}" for s in rivals)])


def match_statistics(products: DataFrame, matches: DataFrame) -> DataFrame:
    """what, n: products, those matched, those whose cluster needs review, and clusters by whether they were made by hand or need review."""
    both = products.select("product_id", "match_id").join(matches.select("match_id", "is_manual", "needs_review"), "match_id", "left")
    p = both.agg(F.count("*").alias("products"), F.count("match_id").alias("matched_products"), F.count_if("needs_review").alias("products_to_review"))
    m = matches.agg(F.count_if(~F.col("is_manual")).alias("auto"), F.count_if("is_manual").alias("manual"), F.count_if("needs_review").alias("matches_to_review"))
    long = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in df.columns))).alias("x")).select("x.*")
    return long(p).unionByName(long(m))


def counted_passes(passes: DataFrame) -> DataFrame:
    """passes with complete: the source said how many there are, all could be read, and that many different ones came.

    passes: expected, raw, failures, different."""
    whole = F.col("expected").isNotNull() & (F.col("failures") == 0) & (F.col("raw") == F.col("expected")) & (F.col("different") == F.col("expected"))
    return passes.withColumn("complete", F.coalesce(whole, F.lit(False)))
