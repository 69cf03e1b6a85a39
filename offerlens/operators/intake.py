"""What a collection run brings in: whether it is complete, what it adds to the stored catalogue, and what it may change."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares below which a run or a file is not trusted, and runs after which a new country is believed.
BASELINE_SHARE, SHRINK_SHARE, MOST_DEAD, MOST_GONE, SEEN_RUNS = 0.5, 0.5, 0.15, 0.20, 2
PRICE_FIELDS = ("price", "discount", "percent", "on_sale", "promo")


def persisted(batch: DataFrame, stored: DataFrame, fields: tuple[str, ...] = PRICE_FIELDS) -> DataFrame:
    """Rows of a batch (product_id, seq and fields) that differ from the one before in any field: the one before in the batch,
    or what is stored of the product (product_id and fields) for its first."""
    old = stored.select("product_id", F.struct(*fields).alias("_old"))
    new = batch.withColumn("_new", F.struct(*fields))
    before = F.lag("_new").over(Window.partitionBy("product_id").orderBy("seq"))
    joined = new.withColumn("_before", before).join(old, "product_id", "left")
    return joined.where(~F.col("_new").eqNullSafe(F.coalesce("_before", "_old"))).select(batch.columns)


def upserted(stored: DataFrame, batch: DataFrame, key: list[str], always: list[str], if_given: list[str], if_empty: list[str]) -> DataFrame:
    """stored with a batch (one row a key) merged in: some columns always from the batch, some where it gives a value, some only
    where nothing is stored. Rows of the batch without a counterpart are added."""
    b = batch.select(*(F.col(k).alias(f"_{k}") for k in key), *(F.col(c).alias(f"_{c}") for c in always + if_given + if_empty))
    on = [stored[k].eqNullSafe(F.col(f"_{k}")) for k in key]
    both = stored.withColumn("_old", F.lit(True)).join(b.withColumn("_new", F.lit(True)), on, "full_outer")
    given = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    made = {k: F.coalesce(k, f"_{k}") for k in key}
    made |= {c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in always}
    made |= {c: F.coalesce(given(f"_{c}"), F.col(c)) for c in if_given}
    made |= {c: F.coalesce(given(c), F.col(f"_{c}")) for c in if_empty}
    return both.select(*(made.get(c, F.col(c)).alias(c) for c in stored.columns))


def countries(observations: DataFrame) -> DataFrame:
    """product_id, code, status, candidate, seen after all observations (product_id, seq, run_id, code; code null if unresolved).

    The first country stays; another one has to be seen in two different runs, one after the other, before it takes over,
    and leaves the product ambiguous meanwhile. Rows are sorted by product and time in each task and read in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = state = None

        def out(rows: list) -> pa.RecordBatch:
            names = ("product_id", "code", "status", "candidate", "seen")
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([("product_id", pa.int64()), ("code", pa.string()), ("status", pa.string()), ("candidate", pa.string()), ("seen", pa.int32())]))

        for batch in batches:
            done = []
            for pid, run_id, code in zip(*(batch[c].to_pylist() for c in ("product_id", "run_id", "code"))):
                if pid != product:
                    if product is not None:
                        done.append((product, *state[:4]))
                    product, state = pid, [None, "unknown", None, 0, None]
                if code is None:
                    continue
                if state[0] is None or state[0] == code:
                    state = [code, "resolved", None, 0, None]
                    continue
                if state[2] != code:
                    state[2], state[3] = code, 1
                elif state[4] != run_id:
                    state[3] += 1
                state[1], state[4] = "ambiguous", run_id
                if state[3] >= SEEN_RUNS:
                    state = [code, "resolved", None, 0, None]
            if done:
                yield out(done)
        if product is not None:
            yield out([(product, *state[:4])])

    rows = observations.select("product_id", "seq", "run_id", "code").repartition("product_id").sortWithinPartitions("product_id", "seq")
    return rows.select("product_id", "run_id", "code").mapInArrow(run, "product_id long, code string, status string, candidate string, seen int")


def stock_states(observations: DataFrame) -> DataFrame:
    """product_id, status, observed_at: the newest explicit word on stock; 'unknown' never overwrites one."""
    said = F.when(F.col("status").isin("in_stock", "out_of_stock"), F.col("seq"))
    a = observations.groupBy("product_id").agg(F.max_by("status", said).alias("status"), F.max_by("observed_at", said).alias("observed_at"))
    return a.withColumn("status", F.coalesce("status", F.lit("unknown")))


def stock_of_quantity(raw: Column) -> Column:
    """status and quantity of a count as text: missing, unreadable or negative counts are unknown, not sold out."""
    n = raw.try_cast("double")
    n = F.when(n >= 0, n)
    return F.struct(F.when(n > 0, "in_stock").when(n == 0, "out_of_stock").otherwise("unknown").alias("status"), n.alias("quantity"))


def stock_of_flag(raw: Column) -> Column:
    """Only true and false say something about stock."""
    return F.when(raw, "in_stock").when(~raw, "out_of_stock").otherwise("unknown")


def site_quality(results: DataFrame, requested: DataFrame, baselines: DataFrame, enforce: bool = True) -> DataFrame:
    """site, status, reasons, fraction of each requested site (site) from its result (site, fatal, expected, completed, failed,
    products, errors) and baseline (site, baseline)."""
    df = requested.select("site").join(results.withColumn("_got", F.lit(True)), "site", "left").join(baselines, "site", "left")
    expected, completed, failed = (F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in ("expected", "completed", "failed"))
    below = F.lit(enforce) & F.coalesce((F.col("baseline") > 0) & (F.col("products") < F.col("baseline") * BASELINE_SHARE), F.lit(False))
    fatal = F.when(F.col("_got").isNull(), "missing_site_result").when(F.coalesce("fatal", F.lit(False)), "site_fatal").when(expected == 0, "no_items_requested").when(F.col("products") == 0, "zero_products")
    weak = F.array_compact(F.array(F.when((failed > 0) | (completed < expected), "incomplete_items"), F.when(F.coalesce("errors", F.lit(0)) > 0, "scraper_errors"), F.when(below, "below_baseline")))
    status = F.when(fatal.isNotNull(), "failed").when(F.size(weak) > 0, "degraded").otherwise("ok")
    reasons = F.when(fatal.isNotNull(), F.array(fatal)).otherwise(weak)
    return df.select("site", status.alias("status"), F.array_join(reasons, "+").alias("reasons"), F.when(F.col("baseline") > 0, F.col("products") / F.col("baseline")).alias("fraction"))


def run_quality(sites: DataFrame) -> DataFrame:
    """status of a run: failed if all its sites are, ok if all are, else degraded."""
    a = sites.agg(F.bool_and(F.col("status") == "failed").alias("f"), F.bool_and(F.col("status") == "ok").alias("o"))
    return a.select(F.when(F.col("o"), "ok").when(F.col("f"), "failed").otherwise("degraded").alias("status"))


def route_causes() -> Column:
    """Why a route (complete, skipped, failures, expected, raw, parsed, abort_reason) is incomplete: every cause, the scraper's own
    first; empty if it is complete."""
    mismatch = F.coalesce(F.col("expected").isNotNull() & ((F.col("raw") != F.col("expected")) | (F.col("parsed") != F.col("expected"))), F.lit(False))
    fails = F.col("complete").isNull() | ~F.col("complete") | (F.col("skipped") > 0) | (F.col("failures") > 0) | mismatch
    causes = F.array_compact(F.array(F.when(F.col("complete").isNull(), "missing_route_status"), F.col("abort_reason"), F.when(F.col("failures") > 0, "item_parse_failures"), F.when(F.col("skipped") > 0, "pages_skipped"), F.when(mismatch, "item_count_mismatch")))
    return F.when(~fails, F.array().cast("array<string>")).when(F.size(causes) > 0, causes).otherwise(F.array(F.lit("incomplete")))


def verified_catalogue(expected: DataFrame, routes: DataFrame, results: DataFrame, baselines: DataFrame, least: float = 0.9) -> DataFrame:
    """site, verified, zero_routes, incomplete, causes of a full scan.

    expected: site, slug. routes: site, slug, products and what route_causes reads. Every expected route must be complete
    and have products (or be known to be empty), a site must have no errors and enough products against its baseline."""
    df = expected.join(routes, ["site", "slug"], "left").withColumn("causes", route_causes())
    empty = F.coalesce(F.col("complete") & (F.col("expected") == 0), F.lit(False))
    a = df.groupBy("site").agg(F.count_if((F.coalesce("products", F.lit(0)) == 0) & ~empty).alias("zero_routes"), F.count_if(F.size("causes") > 0).alias("incomplete"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("causes")))), "+").alias("causes"))
    s = results.select("site", F.col("products").alias("total"), "errors")
    a = a.join(s, "site", "left").join(baselines, "site", "left")
    good = (F.coalesce("total", F.lit(0)) > 0) & (F.coalesce("errors", F.lit(0)) == 0) & (F.col("total") >= least * F.coalesce("baseline", F.lit(0)))
    return a.select("site", (good & (F.col("zero_routes") == 0) & (F.col("incomplete") == 0)).alias("verified"), "zero_routes", "incomplete", "causes")


def breakdown(products: DataFrame) -> DataFrame:
    """site and a map of products by category."""
    n = products.groupBy("site", F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("n"))
    return n.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))


def latest_ok_baseline(counts: DataFrame) -> DataFrame:
    """site, baseline from counts (site, run_id, products, status): that of the newest good run."""
    return counts.where("status = 'ok' and products > 0").groupBy("site").agg(F.max_by("products", "run_id").alias("baseline"))


def route_sync(known: DataFrame, found: DataFrame) -> DataFrame:
    """site, slug, change (added, returned, missing, unchanged) from known (site, slug, is_active) and found (site, slug)."""
    f = found.select("site", F.trim("slug").alias("slug")).where("slug <> ''").distinct().withColumn("now", F.lit(True))
    both = known.join(f, ["site", "slug"], "full_outer")
    change = F.when(F.col("is_active").isNull(), "added").when(F.col("now") & ~F.col("is_active"), "returned").when(F.col("now"), "unchanged").when(F.col("is_active"), "missing")
    return both.select("site", "slug", change.alias("change")).where("change is not null")


def refused_syncs(plan: DataFrame) -> DataFrame:
    """site, reason: syncs that must not be written, as nothing was found or too much has gone."""
    a = plan.groupBy("site").agg(F.count_if(F.col("change") != "missing").alias("found"), F.count_if(F.col("change") == "missing").alias("gone"), F.count_if(F.col("change").isin("missing", "unchanged")).alias("before"))
    reason = F.when(F.col("found") == 0, "nothing found").when(F.col("gone") > MOST_GONE * F.col("before"), "too much has gone")
    return a.select("site", reason.alias("reason")).where("reason is not null")


def store_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """item_id, change (new, price_changed, gone, back), before, after of a marketplace from stored items (item_id, price, is_gone) and
    a scan (item_id, price)."""
    both = old.withColumn("_old", F.lit(True)).withColumnRenamed("price", "before").join(new.withColumn("_new", F.lit(True)).withColumnRenamed("price", "after"), "item_id", "full_outer")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull() & ~F.col("is_gone"), "gone").when(F.col("_new") & F.col("is_gone"), "back").when(~F.col("before").eqNullSafe(F.col("after")) & F.col("_new"), "price_changed")
    return both.select("item_id", change.alias("change"), "before", "after").where("change is not null")


def has_shrunk(old: DataFrame, new: DataFrame) -> bool:
    """Whether a scan has so much less than what is stored that it must be refused."""
    before, after = old.where("not is_gone").count(), new.count()
    return before > 0 and after < SHRINK_SHARE * before


def reaped(runs: DataFrame, now: str, hours: int = 12) -> DataFrame:
    """runs with those that never finished closed: failed at their start, and not to be relied on."""
    old = (F.col("status") == "running") & (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp")) > hours * 3600)
    return runs.withColumns({"finished_at": F.when(old, F.col("started_at")).otherwise(F.col("finished_at")), "eligible_flag": F.when(old, False).otherwise(F.col("eligible_flag")), "status": F.when(old, "failed").otherwise(F.col("status"))})


def without_pending(batch: DataFrame, pending: DataFrame) -> DataFrame:
    """Rows of a batch (external_id, url) that no pending identity (external_id, url) names, by id or by address."""
    address = F.lower(F.regexp_replace("url", r"[?#].*$|/+$", ""))
    by_id = pending.where("external_id is not null").select("external_id").distinct()
    by_url = pending.where("url is not null").select(address.alias("_address")).distinct()
    rest = batch.join(by_id, "external_id", "left_anti").withColumn("_address", address)
    return rest.join(by_url, "_address", "left_anti").select(batch.columns)


def link_states(products: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """products with dead set by checks (product_id, http_status), and one row (checked, newly_dead, anomaly): gone pages are dead, good
    ones alive, errors change nothing; if too many die at once it is an anomaly, not the pages."""
    state = F.when(F.col("http_status").isin(404, 410), True).when(F.col("http_status").between(200, 399), False)
    both = products.join(checks.select("product_id", state.alias("_dead"), F.lit(True).alias("_checked")), "product_id", "left")
    sums = both.agg(F.count("_checked").alias("checked"), F.count_if(F.col("_dead") & ~F.col("dead")).alias("newly_dead"))
    sums = sums.withColumn("anomaly", F.col("newly_dead") > MOST_DEAD * F.col("checked"))
    changed = both.crossJoin(F.broadcast(sums.select("anomaly"))).withColumn("dead", F.when(F.col("anomaly"), F.col("dead")).otherwise(F.coalesce("_dead", "dead")))
    return changed.select(products.columns), sums


def needs_fallback(products: int, baseline: int, ratio: float = 0.5, least: int = 100) -> bool:
    """Whether a yield is so low against a baseline worth the name that a second source is asked."""
    return baseline >= least and products < ratio * baseline


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "external_id") -> DataFrame:
    """Both sources; of a product that both have, the first one's row."""
    return primary.unionByName(fallback.join(primary.select(key), key, "left_anti").select(primary.columns))


def in_scope(routes: DataFrame, sites: tuple[str, ...]) -> DataFrame:
    """Active routes of the sites that a run is for."""
    return routes.where(F.col("is_active") & F.col("site").isin(*sites))


def isolated(associations: DataFrame, conflicts: DataFrame, stored, most: int = 25) -> DataFrame:
    """node, reached: products and external ids (as 'p:1', 'e:x') connected with a conflict (node) by associations (product, external).

    Grows the set along associations until nothing is added; a set over the bound is returned as it is, for the caller
    to refuse. stored writes each round."""
    edges = associations.select(F.concat(F.lit("p:"), F.col("product").cast("string")).alias("a"), F.concat(F.lit("e:"), "external").alias("b")).distinct()
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    reached = stored(conflicts.select("node").distinct())
    n = reached.count()
    while True:
        grown = stored(reached.unionByName(both.join(reached.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"))).distinct())
        now = grown.count()
        if now == n or n > most:
            return grown
        reached, n = grown, now


def country_dictionary(known: DataFrame, found: DataFrame) -> DataFrame:
    """tenant_id, country_id, country_code, country_raw, source_url, sample_count, version, changed: a dictionary of a site's own
    country ids (known) after verified discoveries (found: the same without version, and seq).

    Discoveries without a code, a name as written or an address are passed over. One that says what is known changes nothing, its
    address and count included; any other takes over and raises the version, several in a row by one each. Rows of one seq go by
    their values."""
    key, said = ["tenant_id", "country_id"], ["country_code", "country_raw", "source_url", "sample_count"]
    blank = F.lit(" \t\r\n\f\x0b")
    good = found.select(*key, "seq", F.lower("country_code").alias("country_code"), *(F.btrim(c, blank).alias(c) for c in ("country_raw", "source_url")), F.coalesce(F.nullif("sample_count", F.lit(0)), F.lit(1)).cast("long").alias("sample_count"))
    good = good.where("country_code <> '' and country_raw <> '' and source_url <> ''").withColumn("version", F.lit(None).cast("long"))
    every = known.select(*key, F.lit(None).cast("long").alias("seq"), *said, F.col("version").cast("long").alias("version")).unionByName(good)
    order = F.struct("seq", *said)
    value = F.struct("country_code", "country_raw")
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("seq"), *said))
    new = F.col("seq").isNotNull() & ~value.eqNullSafe(before)
    steps = every.withColumn("new", new).where(F.col("new") | F.col("seq").isNull())
    last = steps.groupBy(*key).agg(F.max_by(F.struct(*said), order).alias("r"), (F.coalesce(F.max("version"), F.lit(0)) + F.count_if("new")).alias("version"), F.bool_or("new").alias("changed"))
    return last.select(*key, "r.*", "version", "changed")


def continuity_faults(batch: DataFrame, known: DataFrame, tenant_id: int, native: str = ".") -> DataFrame:
    """external_id, url, fault: why a partial batch (external_id, url) may not be written before a full catalogue has been seen.

    Faults: ambiguous (no address, or an id or address that comes with several of the other), rebound (the id is known with another
    address, or to another tenant) and taken (another id or tenant has the address). known: external_id, url, tenant_id. Only ids like
    `native` take part, and known rows without an address bind none. A batch is written whole if there is no fault."""
    b = batch.where(F.col("external_id").rlike(native)).select("external_id", "url").distinct()
    k = known.where(F.col("external_id").rlike(native)).select("external_id", "url", "tenant_id").distinct()
    several = lambda c: b.where("url is not null").groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(c)
    fault = lambda df, name: df.select("external_id", "url", F.lit(name).alias("fault"))
    stranger = F.col("tenant_id") != tenant_id
    by_id = b.join(k.select("external_id", F.col("url").alias("_url"), "tenant_id"), "external_id").where(stranger | (F.col("_url") != F.col("url")))
    by_url = b.join(k.select("url", F.col("external_id").alias("_id"), "tenant_id"), "url").where(stranger | (F.col("_id") != F.col("external_id")))
    return (
        fault(b.where("url is null"), "ambiguous").union(fault(b.join(several("external_id"), "external_id", "left_semi"), "ambiguous"))
        .union(fault(b.join(several("url"), "url", "left_semi"), "ambiguous")).union(fault(by_id, "rebound")).union(fault(by_url, "taken")).distinct()
    )
