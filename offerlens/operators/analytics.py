"""Comparisons, indexes, shares, recommendations, margins and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapter import CLIENT, NOW, SITES
from . import prices

RIVALS = [s for s in SITES if s != CLIENT]


def brand_share(obs: DataFrame, days: int = 400, now: str = NOW) -> DataFrame:
    """Products of each brand seen in so many days, by site; exclusive if one site has them all."""
    seen = obs.groupBy("product_id", "brand", "site").agg(F.max("captured_at").alias("last")).where(F.col("last") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
    counts = seen.groupBy("brand").pivot("site", list(SITES)).count().na.fill(0)
    listed = sum((F.col(s) > 0).cast("int") for s in SITES)
    return counts.withColumn("total", sum(F.col(s) for s in SITES)).withColumn("exclusive", listed == 1)


def assortment_overlap(obs: DataFrame) -> DataFrame:
    """Clusters by the set of sites that list them."""
    sets = obs.groupBy("match_id").agg(F.array_join(F.array_sort(F.collect_set("site")), "+").alias("sites"))
    return sets.groupBy("sites").agg(F.count("*").alias("clusters"))


def match_quality(obs: DataFrame) -> DataFrame:
    """Clusters by number of sites, and how many of them spread by half or more between cheapest and dearest."""
    m = prices.latest_by_match(obs)
    n = sum(F.col(s).isNotNull().cast("int") for s in SITES)
    wide = F.greatest(*SITES) * 2 >= F.least(*SITES) * 3
    return m.groupBy(n.alias("n_sites")).agg(F.count("*").alias("clusters"), F.count_if(wide).alias("suspected"))


def price_index(obs: DataFrame) -> DataFrame:
    """By category: the client's mean price over the rivals', times 100, over clusters that both list."""
    m = prices.latest_by_match(obs).where(F.col(CLIENT).isNotNull() & F.coalesce(*RIVALS).isNotNull())
    rival = sum(F.coalesce(F.col(s), F.lit(0)) for s in RIVALS)
    n = sum(F.col(s).isNotNull().cast("long") for s in RIVALS)
    sums = m.groupBy("category").agg(F.count("*").alias("clusters"), F.sum(CLIENT).alias("c"), F.sum(rival).alias("r"), F.sum(n).alias("n"))
    return sums.select("category", "clusters", (F.col("c") * F.col("n") * 100 / (F.col("r") * F.col("clusters"))).alias("index"))


def category_comparison(obs: DataFrame) -> DataFrame:
    """By category: clusters where the client is cheaper, dearer or within half a per cent (a cent at least) of the cheapest rival."""
    m = prices.latest_by_match(obs).where(F.col(CLIENT).isNotNull() & F.coalesce(*RIVALS).isNotNull()).withColumn("best", F.least(*RIVALS))
    gap = F.col(CLIENT) - F.col("best")
    parity = F.abs(gap) * 200 <= F.greatest(F.col("best"), F.lit(200))
    return m.groupBy("category").agg(F.count("*").alias("clusters"), F.count_if(~parity & (gap < 0)).alias("win"), F.count_if(~parity & (gap > 0)).alias("lose"), F.count_if(parity).alias("parity"), *(F.avg(s).alias(f"avg_{s}") for s in SITES))


def comparison_spread(obs: DataFrame, least_sites: int = 2) -> DataFrame:
    """By cluster: least, greatest and upper-median price of the sites, spread in basis points, cheapest sites."""
    listed = F.array_compact(F.array(*(F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("v"), F.lit(s).alias("s"))) for s in SITES)))
    m = prices.latest_by_match(obs).withColumn("listed", F.array_sort(listed)).withColumn("n", F.size("listed")).where(F.col("n") >= least_sites)
    m = m.withColumn("low", F.get("listed", F.lit(0))["v"]).withColumn("high", F.get("listed", F.col("n") - 1)["v"]).withColumn("median", F.get("listed", F.expr("int(n div 2)"))["v"])
    cheapest = F.array_join(F.transform(F.filter("listed", lambda x: x["v"] == F.col("low")), lambda x: x["s"]), ",")
    return m.select("match_id", F.col("n").cast("long").alias("n"), "low", "high", "median", F.expr("(high - low) * 10000 div low").alias("spread_bp"), cheapest.alias("cheapest"))


def pair_summary(obs: DataFrame) -> DataFrame:
    """For each pair of sites: clusters that both list, and at which one is cheaper."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("pa"), F.col(b).alias("pb")) for i, a in enumerate(SITES) for b in SITES[i + 1 :])))
    p = prices.latest_by_match(obs).select(pairs.alias("p")).select("p.*").where("pa is not null and pb is not null")
    return p.groupBy("a", "b").agg(F.count("*").alias("both"), F.count_if(F.expr("pa < pb")).alias("a_cheaper"), F.count_if(F.expr("pb < pa")).alias("b_cheaper"), F.count_if(F.expr("pa = pb")).alias("equal"))


def client_position(obs: DataFrame) -> DataFrame:
    """Clusters by where the client's price stands among the sites that list them."""
    m = prices.latest_by_match(obs).where(F.col(CLIENT).isNotNull() & F.coalesce(*RIVALS).isNotNull())
    low, high = F.least(*RIVALS), F.greatest(*RIVALS)
    position = F.when(F.col(CLIENT) < low, "cheapest").when(F.col(CLIENT) == low, "tied").when(F.col(CLIENT) > high, "dearest").otherwise("between")
    return m.groupBy(position.alias("position")).agg(F.count("*").alias("clusters"))


def cheapest_rival(obs: DataFrame) -> DataFrame:
    """match_id, client, rival, site: the cheapest rival, of equals the first by name."""
    return prices.client_pairs(obs).groupBy("match_id", "client").agg(F.min(F.struct("rival", "site")).alias("r")).select("match_id", "client", "r.rival", "r.site")


def price_raises(obs: DataFrame, stock: DataFrame, least_bp: int = 500, most_bp: int = 8000) -> DataFrame:
    """Where even the cheapest rival is dearer by so much: the target is two per cent below it, but at least a
    cent above the client's price; in stock only."""
    df = cheapest_rival(obs).where("rival > client").withColumn("gap_bp", F.expr("(rival - client) * 10000 div client")).where(F.col("gap_bp").between(least_bp, most_bp - 1))
    target = F.when(F.expr("rival * 98 div 100 > client"), F.expr("rival * 98 div 100")).otherwise(F.col("rival") - 1)
    return df.join(stock.where("in_stock"), "match_id").select("match_id", "site", "client", "rival", "gap_bp", target.alias("target"))


def undercut_responses(obs: DataFrame, stock: DataFrame, least_bp: int = 300, most_bp: int = 8000, margin: int = 10) -> DataFrame:
    """Where a rival undercuts: the target is a cent below it unless that leaves less than the margin."""
    df = cheapest_rival(obs).where("rival < client").withColumn("gap_bp", F.expr("(client - rival) * 10000 div client")).where(F.col("gap_bp").between(least_bp, most_bp - 1))
    df = df.join(stock, "match_id", "left").withColumn("target", F.col("rival") - 1)
    feasible = F.col("cost_cents").isNull() | (F.col("target") * 100 >= F.col("cost_cents") * (100 + margin))
    return df.select("match_id", "site", "client", "rival", "gap_bp", "target", F.when(F.col("gap_bp") >= 1000, "critical").otherwise("warning").alias("severity"), feasible.alias("feasible"))


def assortment_gaps(obs: DataFrame, top: int = 50) -> DataFrame:
    """Clusters that rivals list and the client doesn't; the dearest first."""
    m = prices.latest_by_match(obs).where(F.col(CLIENT).isNull()).withColumn("price", F.greatest(*RIVALS))
    return m.select("match_id", "category", "price").orderBy(F.desc("price"), "match_id").limit(top)


def margin_report(obs: DataFrame, stock: DataFrame, run_id: int) -> DataFrame:
    """The client's margin as of a run: effective price against the least purchase price."""
    now = prices.with_effective(prices.latest(obs.where((F.col("site") == CLIENT) & (F.col("run_id") <= run_id))))
    return now.join(stock, "match_id").select("match_id", "eff", "cost_cents", "in_stock", F.expr("(eff - cost_cents) * 10000 div eff").alias("margin_bp"))


def linear_trend(obs: DataFrame, least: int = 3) -> DataFrame:
    """Least-squares slope (cents a day) of daily last prices; 0 where all days are one. Sums are whole numbers."""
    d = prices.daily_last(obs).withColumn("x", F.datediff("day", F.lit("1995-01-01").cast("date")).cast("long"))
    s = d.groupBy("product_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("eff").alias("sy"), F.sum(F.col("x") * F.col("eff")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx")).where(F.col("n") >= least)
    across = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(across == 0, F.lit(0.0)).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / across)
    return s.select("product_id", "n", slope.alias("slope"))


def moving_average(obs: DataFrame) -> DataFrame:
    """Daily prices smoothed over a day and its neighbours; raw where a product has three days or fewer."""
    d = prices.daily_last(obs)
    w = Window.partitionBy("product_id").orderBy("day")
    mean = F.avg("eff").over(w.rowsBetween(-1, 1))
    many = F.count("*").over(Window.partitionBy("product_id")) > 3
    return d.select("product_id", F.col("day").cast("string").alias("day"), F.when(many, mean).otherwise(F.col("eff").cast("double")).alias("smooth"))


def weekly_profile(obs: DataFrame) -> DataFrame:
    """Mean effective price by site and weekday (Monday 0)."""
    return prices.with_effective(obs).groupBy("site", F.weekday("captured_at").cast("long").alias("weekday")).agg(F.count("*").alias("n"), F.avg("eff").alias("mean"))


def top_movers(obs: DataFrame, since: str, least_bp: int = 500, most_bp: int = 9500, top: int = 500) -> DataFrame:
    """First to last price of a window, the first being the last one before it if there is any."""
    df = prices.with_effective(obs)
    inside = F.col("captured_at") >= F.lit(since).cast("timestamp_ntz")
    a = df.groupBy("product_id").agg(
        F.max_by("eff", F.when(~inside, F.col("seq"))).alias("anchor"),
        F.min_by("eff", F.when(inside, F.col("seq"))).alias("first"),
        F.max_by("eff", F.when(inside, F.col("seq"))).alias("last"),
    )
    a = a.where("last is not null").withColumn("start", F.coalesce("anchor", "first")).withColumn("bp", F.expr("(last - start) * 10000 div start"))
    return a.where(F.abs("bp").between(least_bp, most_bp)).select("product_id", "start", "last", "bp").orderBy(F.abs("bp").desc(), "product_id").limit(top)


def volatile_categories(obs: DataFrame, top: int = 10) -> DataFrame:
    """Categories with most journal rows."""
    return prices.journal(obs).groupBy("category").agg(F.count("*").alias("changes")).orderBy(F.desc("changes"), "category").limit(top)


def brand_overlap(obs: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of categories at two sites by the brands that they share: a self-join on the brand."""
    x = obs.where(F.col("site").isin("client", "rival_a")).select("site", "brand", "category").distinct()
    a = x.where("site = 'client'").select("brand", F.col("category").alias("client_category"))
    b = x.where("site = 'rival_a'").select("brand", F.col("category").alias("rival_category"))
    return a.join(b, "brand").groupBy("client_category", "rival_category").agg(F.countDistinct("brand").alias("brands")).where(F.col("brands") >= least)


def missing_at(obs: DataFrame, site: str) -> DataFrame:
    """Clusters that a site doesn't list."""
    everything = obs.select("match_id", "category").distinct()
    return everything.join(obs.where(F.col("site") == site).select("match_id").distinct(), "match_id", "left_anti")


def offer_rank(obs: DataFrame) -> DataFrame:
    """Rank, dense rank and row number of each site's price in its cluster."""
    w = Window.partitionBy("match_id").orderBy("eff")
    now = prices.with_effective(prices.latest(obs.select("product_id", "match_id", "site", "price_cents", "discount_cents", "seq")))
    return now.select("match_id", "site", "eff", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.row_number().over(w.orderBy("eff", "site")).cast("long").alias("number"))


def rollup_counts(obs: DataFrame) -> DataFrame:
    """Observations and distinct products by site and category, with subtotals.

    Observations are counted by product first, so that products and not observations are repeated for the subtotals."""
    each = obs.groupBy("site", "category", "product_id").agg(F.count("*").alias("n"))
    return each.rollup("site", "category").agg(F.sum("n").alias("n"), F.countDistinct("product_id").alias("products"))


def facets(obs: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The commonest values of a column by products."""
    return obs.select("product_id", column).distinct().groupBy(F.col(column).alias("value")).agg(F.count("*").alias("products")).orderBy(F.desc("products"), "value").limit(top)
