"""Source categories in one taxonomy, by rules that collect: every rule that matches counts, whatever their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import strip_accents
from ..sources.shared import stored

# Sections that are too broad or only name a form, as they read after folding.
FORM_SLUGS = ("inyeksiyalar", "inyeksiyalar ve infuziyalar", "infuziyalar", "samlar", "xarici vasiteler", "xarici vasiteler ve inyeksiyalar", "yerli vasiteler", "peroral vasiteler tabletler kapsullar", "tabletler", "kapsullar", "mehlullar", "guclu tesiredici vasiteler")
# Codes of countries and the names that sources use for them.
COUNTRY_NAMES = {
    "az": "azerbaycan azerbaijan азербайджан aze", "tr": "turkiye turkey turkiyə турция tur", "ru": "rusiya russia россия rus", "de": "almaniya germany германия deu", "fr": "fransa france франция fra",
    "it": "italiya italy италия ita", "es": "ispaniya spain испания esp", "pl": "polsa poland польша pol", "ua": "ukrayna ukraine украина ukr", "in": "hindistan india индия ind", "jp": "yaponiya japan япония jpn",
    "cn": "cin china китай chn", "us": "abs usa сша amerika", "gb": "ingiltere england великобритания gbr", "ch": "isvecre switzerland швейцария che", "ge": "gurcustan georgia грузия geo", "ir": "iran иран irn",
}


def folded(*texts: Column) -> Column:
    """Texts as one line of plain words, both spellings of a sound as one."""
    x = F.lower(strip_accents(F.concat_ws(" ", *texts)))
    for old, new in (("sh", "s"), ("ch", "c"), ("gh", "g")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(x, "[^a-z0-9а-яё]+", " "))


def classified(categories: DataFrame, rules: DataFrame, broad: DataFrame, segment: str) -> DataFrame:
    """site, slug, key, reason from categories (site, slug, label_ru, label_az).

    rules: id, key, signal, mode (prefix: some word starts with the signal; word: it stands as such), supersedes (ids,
    comma-separated) and segment_override. broad: site and slug of sections that say nothing. All rules that match the slug
    or a label count, but for those that others supersede. One key left is the answer; of several the segment, if a rule
    of it says so; else none, as with sections that are broad or name a form."""
    c = categories.withColumns({"_slug": folded("slug"), "_ru": folded("label_ru"), "_az": folded("label_az")}).withColumn("_bare", F.regexp_replace("_slug", r"\s+\d+$", ""))
    b = broad.select("site", folded("slug").alias("_bare"), F.lit(True).alias("_broad"))
    c = c.join(b, ["site", "_bare"], "left")
    blocked = F.when(F.coalesce("slug", F.lit("")) == "", "no_slug").when(F.col("_broad"), "blocked_broad_bucket").when(F.col("_bare").isin(*FORM_SLUGS), "blocked_dosage_form")
    c = c.withColumn("_blocked", blocked)
    distinct = c.where("_blocked is null").select("_slug", "_ru", "_az").distinct()
    r = rules.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("signal").alias("_signal"), F.col("mode").alias("_mode"), F.filter(F.split(F.coalesce("supersedes", F.lit("")), ","), lambda x: x != "").alias("_over"), F.col("segment_override").alias("_seg"))
    padded = lambda f: F.concat(F.lit(" "), F.col(f), F.lit(" "))
    hit = lambda f: F.when(F.col("_mode") == "word", F.contains(padded(f), F.concat(F.lit(" "), F.col("_signal"), F.lit(" ")))).otherwise(F.contains(padded(f), F.concat(F.lit(" "), F.col("_signal"))))
    # A few hundred rules against the different sections, of which a site has hundreds too.
    met = distinct.join(F.broadcast(r), hit("_slug") | hit("_ru") | hit("_az"))
    g = met.groupBy("_slug", "_ru", "_az").agg(F.collect_list(F.struct("_id", "_key", "_seg")).alias("_all"), F.flatten(F.collect_list("_over")).alias("_gone"))
    g = g.withColumn("_live", F.filter("_all", lambda x: ~F.array_contains("_gone", x["_id"]))).withColumn("_keys", F.array_distinct(F.transform("_live", lambda x: x["_key"])))
    key = F.when(F.size("_keys") == 1, F.get("_keys", F.lit(0))).when(F.exists("_live", lambda x: x["_seg"]), F.lit(segment))
    why = F.when(F.size("_live") == 0, "superseded_out").when(F.size("_keys") == 1, "matched").when(F.exists("_live", lambda x: x["_seg"]), "segment_policy").otherwise("ambiguous")
    out = c.join(g.select("_slug", "_ru", "_az", F.when(F.size("_live") > 0, key).alias("key"), why.alias("why")), ["_slug", "_ru", "_az"], "left")
    return out.select("site", "slug", F.when(F.col("_blocked").isNull(), F.col("key")).alias("key"), F.coalesce("_blocked", "why", F.lit("no_signal")).alias("reason"))


def in_circles(over: DataFrame) -> DataFrame:
    """id of every rule that supersedes itself, directly or by others (over: id, other).

    Ways are doubled in length until no new ones come, so that the rounds go with the logarithm of the longest."""
    ways, n = stored(over.select("id", "other").distinct()), -1
    while (more := ways.count()) > n:
        n = more
        longer = ways.select("id", F.col("other").alias("by")).join(ways.select(F.col("id").alias("by"), "other"), "by").select("id", "other")
        ways = stored(ways.union(longer).distinct())
    return ways.where("id = other").select("id")


def rule_faults(rules: DataFrame) -> DataFrame:
    """id, fault: rules of one id or signal twice, signals that folding changes, and supersedes that name no rule or go in a circle."""
    same = lambda c, fault: rules.withColumn("n", F.count("*").over(Window.partitionBy(c))).where("n > 1").select("id", F.lit(fault).alias("fault"))
    over = rules.select("id", F.explode(F.filter(F.split(F.coalesce("supersedes", F.lit("")), ","), lambda x: x != "")).alias("other"))
    unknown = over.join(rules.select(F.col("id").alias("other")), "other", "left_anti").select("id", F.lit("supersedes no rule").alias("fault"))
    circle = in_circles(over).withColumn("fault", F.lit("circle"))
    unfolded = rules.where(folded(F.col("signal")) != F.col("signal")).select("id", F.lit("signal is not folded").alias("fault"))
    return same("id", "id twice").union(same("signal", "signal twice")).union(unknown).union(circle).union(unfolded).distinct()


def labels(categories: DataFrame, sites: dict[str, str]) -> DataFrame:
    """site, slug, label_ru, label_az: of several rows with a slug the source's own, then an active one, then the newest.

    categories: id, key, is_active, labels and a column <site>_slug for each site; sites gives the prefix of its own keys."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("site"), F.col(f"{s}_slug").alias("slug"), F.lit(p).alias("prefix")) for s, p in sites.items())))
    rows = categories.select("id", "key", "is_active", "label_ru", "label_az", each.alias("x")).where("x.slug is not null and x.slug <> ''")
    order = F.struct((F.col("key") == F.concat_ws("_", "x.prefix", "x.slug")).alias("own"), "is_active", "id")
    return rows.groupBy("x.site", "x.slug").agg(F.max_by(F.struct("label_ru", "label_az"), order).alias("l")).select("site", "slug", "l.*")


def country(raw: Column) -> Column:
    """code and status of a country as written: resolved, unknown (nothing said), ambiguous (a number) or invalid."""
    pairs = [(n, code) for code, words in COUNTRY_NAMES.items() for n in {code, *words.split()}]
    table = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    plain = F.trim(F.regexp_replace(F.lower(strip_accents(raw)), "[-\\s]+", " "))
    code = F.element_at(table, plain)
    empty = F.coalesce(F.trim(raw), F.lit("")) == ""
    status = F.when(empty, "unknown").when(code.isNotNull(), "resolved").when(F.trim(raw).rlike(r"^\d+$"), "ambiguous").otherwise("invalid")
    return F.struct(F.when(~empty, code).alias("code"), status.alias("status"))


def coverage(products: DataFrame, mapped: DataFrame) -> DataFrame:
    """site, products, mapped: how many products lie in sections that have a key (mapped: site, slug, key)."""
    df = products.join(mapped.where("key is not null").select("site", F.col("slug").alias("category"), F.lit(1).alias("k")).distinct(), ["site", "category"], "left")
    return df.groupBy("site").agg(F.count("*").alias("products"), F.count("k").alias("mapped"))
