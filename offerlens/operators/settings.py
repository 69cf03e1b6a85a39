"""What people set up: sections to visit, categories given by hand, thresholds of tenants, and how far a tenant has come."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of a tenant that has set none, in basis points and rows.
DEFAULTS = {"raise_bp": 500, "undercut_bp": 300, "spread_bp": 8000, "margin_bp": 1000, "per_type": 10}
#: The most rows of a type that a tenant may ask for.
MOST_ROWS = 200


def sections_to_visit(categories: DataFrame, routes: DataFrame, sites: tuple[str, ...], broad: dict[str, tuple[str, ...]], only: int | None = None) -> DataFrame:
    """site, slug, rank, id of every active section; a site's turn goes by rank and id.

    categories (id, is_active and <site>_slug) hold the sites' sections; routes (id, site, slug, is_active) those of sites without
    such a column, which belong to no category, so that one category alone (`only`) has none of them. At sites of `broad` those slugs,
    and filters with an equals sign, go first, so that the narrower sections have the last word. Empty slugs are left out."""
    own = [s for s in sites if f"{s}_slug" in categories.columns]
    active = categories.where("is_active").where(F.lit(True) if only is None else F.col("id") == only)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("site"), F.col(f"{s}_slug").alias("slug")) for s in own)))
    found = active.select("id", each.alias("x")).select("x.site", "x.slug", "id")
    if only is None:
        found = found.unionByName(routes.where(F.col("is_active") & F.col("site").isin([s for s in sites if s not in own])).select("site", "slug", "id"))
    wide = F.col("slug").contains("=")
    first = reduce(lambda w, s: w.when((F.col("site") == s) & (wide | F.col("slug").isin(*broad[s])), 0), broad, F.when(F.lit(False), 0)).otherwise(1)
    return found.where("slug <> ''").select("site", "slug", first.alias("rank"), "id")


def suggested_products(products: DataFrame, term: str, client: str, tenant_id: int = 1, limit: int = 12) -> DataFrame:
    """product_id, name, category, manual_key: the client's live products with a term in their names, first by name, then by id; at
    least one and at most thirty. Nothing comes for a term under two characters; % and _ in it stand for any characters."""
    term = term.strip()
    live = products.where((F.col("tenant_id") == tenant_id) & (F.col("site") == client) & ~F.col("dead") & F.lit(len(term) >= 2))
    return live.where(F.col("name").ilike(f"%{term}%")).orderBy("name", "product_id").limit(max(1, min(limit, 30))).select("product_id", "name", "category", "manual_key")


def category_edits(products: DataFrame, edits: DataFrame, canonical: DataFrame, client: str) -> DataFrame:
    """edits (seq, tenant_id, product_id, category_key) with outcome: set, cleared (a null key), unknown_category or no_product.

    A key is known if it is canonical (a column key), or a category that the tenant's client already lists."""
    own = products.where(F.col("site") == client)
    listed = own.where("category <> ''").select("tenant_id", F.col("category").alias("category_key")).distinct().withColumn("_listed", F.lit(True))
    fixed = canonical.select(F.col("key").alias("category_key")).distinct().withColumn("_fixed", F.lit(True))
    there = own.select("tenant_id", "product_id").distinct().withColumn("_there", F.lit(True))
    df = edits.join(fixed, "category_key", "left").join(listed, ["tenant_id", "category_key"], "left").join(there, ["tenant_id", "product_id"], "left")
    df = df.withColumn("_known", F.coalesce("_fixed", "_listed"))
    outcome = F.when(F.col("category_key").isNotNull() & F.col("_known").isNull(), "unknown_category").when(F.col("_there").isNull(), "no_product").when(F.col("category_key").isNull(), "cleared").otherwise("set")
    return df.select(*edits.columns, outcome.alias("outcome"))


def categorized(products: DataFrame, done: DataFrame, client: str) -> DataFrame:
    """products after edits of `category_edits`: the last that went through decides manual_key."""
    last = done.where(F.col("outcome").isin("set", "cleared")).groupBy("tenant_id", "product_id").agg(F.max_by(F.struct("category_key"), F.struct("seq", "category_key")).alias("_last"))
    df = products.join(last.withColumn("site", F.lit(client)), ["tenant_id", "product_id", "site"], "left")
    return df.select(*(F.when(F.col("_last").isNotNull(), F.col("_last.category_key")).otherwise(F.col(c)).alias(c) if c == "manual_key" else F.col(c) for c in products.columns))


def thresholds(configs: DataFrame, tenants: DataFrame) -> DataFrame:
    """tenant_id and the thresholds of every tenant, the defaults where it has none or left one open."""
    df = tenants.select("tenant_id").distinct().join(configs, "tenant_id", "left")
    return df.select("tenant_id", *(F.coalesce(c, F.lit(v).cast("long")).alias(c) for c, v in DEFAULTS.items()))


def reconfigured(configs: DataFrame, edits: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Thresholds after edits (seq, tenant_id and all thresholds; the last of a tenant counts whole), and the kept lists that still
    hold: none of a tenant that set new ones."""
    last = edits.groupBy("tenant_id").agg(F.max_by(F.struct(*DEFAULTS), F.struct("seq", *DEFAULTS)).alias("r")).select("tenant_id", "r.*")
    rest = configs.join(last, "tenant_id", "left_anti").select("tenant_id", *DEFAULTS)
    return rest.unionByName(last), cache.join(last, "tenant_id", "left_anti")


def within_thresholds(gaps: DataFrame, limits: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """tenant_id, type, rank, match_id, gap_bp: what each tenant's own thresholds call for, the widest gaps first, per_type of a type.

    gaps: tenant_id, match_id, client and the cheapest rival. Gaps as wide as spread_bp are taken for faults. `most` is the largest
    per_type that a tenant may set: as a plain bound it lets tasks keep their first rows before the shuffle, so that of a tenant
    with very many rows only few travel."""
    up = F.col("rival") > F.col("client")
    bp = F.expr("abs(rival - client) * 10000 div client")
    df = gaps.where("client > 0 and rival > 0 and rival <> client").join(limits, "tenant_id").select("*", F.when(up, "price_raise").otherwise("undercut").alias("type"), bp.alias("gap_bp"))
    df = df.where(F.col("gap_bp") >= F.when(up, F.col("raise_bp")).otherwise(F.col("undercut_bp"))).where("gap_bp < spread_bp")
    rank = F.row_number().over(Window.partitionBy("tenant_id", "type").orderBy(F.desc("gap_bp"), "match_id"))
    return df.withColumn("rank", rank).where(F.col("rank") <= most).where("rank <= per_type").select("tenant_id", "type", "rank", "match_id", "gap_bp")


def onboarding(tenants: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """tenant_id, has_<part> and state of each tenant: empty_db, need_categories, need_recipients or ready.

    parts: runs, categories, recipients (active ones count), products and tracked, each with tenant_id."""
    names = ("runs", "categories", "recipients", "products", "tracked")
    active = lambda n, df: df.where("is_active") if n == "recipients" else df
    # Each part is brought down to its tenants before the shuffle of all.
    what = [active(n, parts[n]).select("tenant_id").distinct().withColumn("what", F.lit(n)) for n in names]
    has = lambda n: F.coalesce(F.bool_or(F.col("what") == n), F.lit(False)).alias(f"has_{n}")
    df = tenants.select("tenant_id").distinct().join(reduce(DataFrame.unionByName, what), "tenant_id", "left").groupBy("tenant_id").agg(*(has(n) for n in names))
    return df.withColumn("state", _state())


def _state() -> Column:
    runs, categories, recipients, products, tracked = (F.col(f"has_{n}") for n in ("runs", "categories", "recipients", "products", "tracked"))
    return F.when(~(runs | categories | products), "empty_db").when(~(categories | tracked), "need_categories").when(~recipients, "need_recipients").otherwise("ready")


def queues(requests: DataFrame) -> DataFrame:
    """tenant_id, pending, running and the oldest pending request of each tenant's queue (id, tenant_id, status, requested_at)."""
    waits = F.col("status") == "pending"
    return requests.groupBy("tenant_id").agg(F.count_if(waits).alias("pending"), F.count_if(F.col("status") == "running").alias("running"), F.min(F.when(waits, F.struct("requested_at", "id"))).alias("o")).select("tenant_id", "pending", "running", F.col("o.id").alias("oldest_id"), F.col("o.requested_at").alias("oldest_at"))
