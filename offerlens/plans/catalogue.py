"""Queries of search, categories, countries, marketplaces and electronics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import fold_sql
from ..operators import catalogue_search as search
from ..operators import electronics, marketplace, taxonomy
from ..sources import lineage as source
from ..sources.adapter import NOW
from ..sources.shared import shared_folder, stored
from .literal import rows, values
from .registry import query

PRODUCTS = source.PRODUCTS_SQL


def found(spark, d, text: str):
    return search.search(source.products(spark, d), text)


@query("SELECT product_id, site, name, 0 AS rank FROM products WHERE name = 'red widget'", PRODUCTS)
def search_two_words(spark, d):
    return found(spark, d, "Red wid")


@query("SELECT product_id, site, name, 2 AS rank FROM products WHERE name = 'red widget'", PRODUCTS)
def search_words_turned(spark, d):
    return found(spark, d, "wid RED")


@query("SELECT product_id, site, name, 4 AS rank FROM products WHERE contains(name, ' bolt')", PRODUCTS)
def search_misspelt(spark, d):
    return found(spark, d, "bult")


@query("SELECT product_id, site, name, 1 AS rank FROM products WHERE contains(name, ' gear')", PRODUCTS)
def search_one_word(spark, d):
    return found(spark, d, "gear")


# Queries of which every second word is one of a brand, turned, misspelt or inside of words; the oracle works ranks out from plain names.
ASKED = ("widget", "gear red", "bult", "idge", "brand", "red gear", "zzzz", "co wi")
ANSWERS = """asked(query, first, second, brand) AS (VALUES ('widget', 'widget', NULL, 0), ('gear red', 'gear', 'red', 0), ('bult', 'bolt', NULL, 4), ('brand', 'brand', NULL, 3), ('red gear', 'red', 'gear', 0), ('co wi', 'co', 'wi', 0)),
worded AS (SELECT product_id, site, name, ' ' || name || ' ' || lower(replace(brand, '#', ' ')) AS every FROM products),
hits AS (SELECT query, product_id, CASE WHEN brand > 0 THEN brand WHEN starts_with(name, concat_ws(' ', first, second)) THEN 0 WHEN contains(' ' || name, ' ' || concat_ws(' ', first, second)) THEN 1 ELSE 2 END AS rank FROM worded JOIN asked ON contains(every, ' ' || first) AND (second IS NULL OR contains(every, ' ' || second)))"""


@query("SELECT query, rank, count(*) AS products, sum(product_id) AS ids FROM hits GROUP BY ALL UNION ALL SELECT 'idge', 5, count(*), sum(product_id) FROM products WHERE contains(name, 'idge') HAVING count(*) > 0", f"{PRODUCTS}, {ANSWERS}")
def search_kept_index(spark, d):
    """Several queries from one stored index."""
    made = search.keep(source.products(spark, d), source.runs(spark, d), f"{shared_folder(spark)}/offerlens-search-{uuid.uuid4().hex}")
    every = [search.search_kept(made, q).select(F.lit(q).alias("query"), "rank", "product_id") for q in ASKED]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out.groupBy("query", "rank").agg(F.count("*").alias("products"), F.sum("product_id").alias("ids"))


@query(f"SELECT word, count(*) AS products FROM (SELECT product_id, unnest(list_distinct(string_split({fold_sql("name || ' ' || brand")}, ' '))) AS word FROM products) GROUP BY word", PRODUCTS)
def search_vocabulary(spark, d):
    return search.vocabulary(search.index(source.products(spark, d)))


@query("SELECT replace(name, 'w', 'v') AS head, count(*) AS products FROM products WHERE starts_with(name, 'red') GROUP BY name UNION ALL SELECT 'red', count(*) FROM products WHERE starts_with(name, 'red ') ORDER BY (head <> 'red'), products DESC, length(head), head LIMIT 6", PRODUCTS)
def search_completions(spark, d):
    return search.completions(source.products(spark, d), "red", top=6)


CLUSTERS = "hits AS (SELECT product_id, CASE WHEN product_id % 4 <> 0 THEN match_id END AS match_id, last_seen_at, row_number() OVER (ORDER BY product_id) AS i FROM products WHERE contains(name, ' gear'))"


@query(f"SELECT DISTINCT match_id, CAST(NULL AS BIGINT) AS product_id FROM (SELECT match_id FROM hits WHERE match_id IS NOT NULL UNION SELECT match_id FROM matches WHERE contains(name, 'gear')) UNION ALL (SELECT CAST(NULL AS BIGINT), product_id FROM hits WHERE match_id IS NULL AND epoch(TIMESTAMP '{NOW}') - epoch(last_seen_at) <= 200 * 86400 ORDER BY product_id LIMIT 30)", f"{PRODUCTS}, {source.MATCHES_SQL}, {CLUSTERS}")
def search_with_clusters(spark, d):
    # Written once, for the search and for what is looked up beside it.
    p = stored(source.products(spark, d).select("product_id", "site", "name", "brand", F.when(F.expr("product_id % 4 <> 0"), F.col("match_id")).alias("match_id"), "last_seen_at"))
    return search.with_cluster_names(search.search(p, "gear"), p, source.matches(spark, d), "gear", NOW, days=200, top=30)


@query("SELECT product_id, name FROM products WHERE site = 'client' AND availability = 'in_stock' ORDER BY name, product_id LIMIT 50 OFFSET 50", PRODUCTS)
def product_listing(spark, d):
    p = source.products(spark, d).where("availability = 'in_stock'")
    return search.listing(p, site="client", page=1).select("product_id", "name")


RULES = [("e1", "eye", "goz xest", "prefix", None, False), ("o1", "oral", "dis mecun", "prefix", None, False), ("b1", "baby", "usaq", "prefix", None, True), ("v1", "vitamins", "vitamin", "prefix", None, False), ("d1", "diabetes", "seker", "prefix", "f1", False), ("f1", "food", "seker", "word", None, False), ("h1", "baby", "hamile", "prefix", None, False)]
SECTIONS = [("a", "goz-xestelikleri", None, None), ("a", "x1", "Uşaq vitaminləri", None), ("a", "dish-mecunu-2", None, None), ("a", "tabletler", None, None), ("a", "seker-xestesi", None, None), ("b", "dermanlar", None, None), ("a", "dermanlar", None, "Vitaminlər"), ("b", "hamile-vitamin", None, None), ("b", "other", None, None), ("b", "", None, None)]
KEYS = [("a", "goz-xestelikleri", "eye", "matched"), ("a", "x1", "baby", "segment_policy"), ("a", "dish-mecunu-2", "oral", "matched"), ("a", "tabletler", None, "blocked_dosage_form"), ("a", "seker-xestesi", "diabetes", "matched"), ("b", "dermanlar", None, "blocked_broad_bucket"), ("a", "dermanlar", "vitamins", "matched"), ("b", "hamile-vitamin", None, "ambiguous"), ("b", "other", None, "no_signal"), ("b", "", None, "no_slug")]


def rules(spark):
    return rows(spark, RULES, "id string, key string, signal string, mode string, supersedes string, segment_override boolean")


@query(f"SELECT * FROM {values(KEYS, 'site, slug, key, reason')}", prelude=False)
def category_taxonomy(spark, d):
    sections = rows(spark, SECTIONS, "site string, slug string, label_ru string, label_az string")
    return taxonomy.classified(sections, rules(spark), rows(spark, [("b", "dermanlar")], "site string, slug string"), "baby")


FAULTS = [("d1", "signal twice"), ("f1", "signal twice")]


@query(f"SELECT * FROM {values(FAULTS, 'id, fault')}", prelude=False)
def taxonomy_faults(spark, d):
    return taxonomy.rule_faults(rules(spark))


NAMED = [(1, "x", True, "r1", "z1", "s1", None), (2, "pa_s1", False, "r2", "z2", "s1", None), (3, "y", True, "r3", "z3", None, "t1"), (4, "z", False, "r4", "z4", None, "t1"), (5, "w", True, "r5", "z5", None, "t1")]
CHOSEN = [("one", "s1", "r2", "z2"), ("two", "t1", "r5", "z5")]


@query(f"SELECT * FROM {values(CHOSEN, 'site, slug, label_ru, label_az')}", prelude=False)
def category_labels(spark, d):
    made = rows(spark, NAMED, "id int, key string, is_active boolean, label_ru string, label_az string, one_slug string, two_slug string")
    return taxonomy.labels(made, {"one": "pa", "two": "pb"})


WRITTEN = [("Almaniya", "de", "resolved"), ("TR", "tr", "resolved"), ("Türkiyə", "tr", "resolved"), ("rus", "ru", "resolved"), ("17", None, "ambiguous"), ("", None, "unknown"), (None, None, "unknown"), ("Atlantis", None, "invalid"), ("Германия", "de", "resolved")]


@query(f"SELECT * FROM {values(WRITTEN, 'raw, code, status')}", prelude=False)
def country_codes(spark, d):
    return rows(spark, [r[:1] for r in WRITTEN], "raw string").select("raw", taxonomy.country(F.col("raw")).alias("c")).select("raw", "c.*")


@query("SELECT site, count(*) AS products, count(*) FILTER (length(category) % 3 = 0) AS mapped FROM products GROUP BY site", PRODUCTS)
def category_coverage(spark, d):
    p = source.products(spark, d)
    mapped = p.select("site", F.col("category").alias("slug")).distinct().withColumn("key", F.when(F.length("slug") % 3 == 0, "k"))
    return taxonomy.coverage(p, mapped)


BODY = '{"items": [{"id": "a", "name": "Lorem  500 mq N20", "price": 250, "original_price": 300, "purchasable_balance": 3}, {"id": "b", "name": "Ipsum", "price": 0}, {"id": "c", "name": "Dolor", "price": 90, "purchasable_balance": 0}]}'
PAGES = [("v1", BODY), ("v1", '{"items": [{"id": "c", "name": "Dolor", "price": 95}]}'), ("v2", '{"items": [{"id": "d", "name": "Sit", "price": 5}]}'), ("v3", "no json")]
PARSED = [("v1", "a", "Lorem 500 mq N20", 250, 300, True), ("v1", "c", "Dolor", 95, None, True), ("v2", "d", "Sit", 5, None, True)]


@query(f"SELECT * FROM {values(PARSED, 'venue, item_id, name, price_cents, original_cents, in_stock')}", prelude=False)
def marketplace_items(spark, d):
    return marketplace.items(rows(spark, PAGES, "venue string, body string"))


OFFERED = [
    ("v1", "1", "Loremol 500 mq N20", 500, True), ("v2", "2", "Loremol 500mq №20", 450, True), ("own", "3", "LOREMOL 500 mq N20 tabletlər", 470, True), ("v1", "4", "Ipsum krem 20 q", 100, True), ("v2", "5", "Ipsum məlhəm 20 q", 100, True),
    ("v1", "6", "Dolor N5", 100, True), ("v1", "7", "Dolor N5", 110, True), ("v2", "8", "Dolor N5", 120, True), ("v1", "9", "Amet gel", 100, True), ("v2", "10", "Amet gel", 400, True), ("v1", "11", "Elit sirop", 300, True), ("v2", "12", "Elit sirop", 310, False), ("v3", "13", "Elit sirop", 290, True),
]
COMPARED = [(2, 450, 500, "v2", 470), (2, 290, 300, "v3", None)]


@query(f"SELECT * FROM {values(COMPARED, 'venues, low, high, cheapest, owner_price')}", prelude=False)
def marketplace_comparison(spark, d):
    made = rows(spark, OFFERED, "venue string, item_id string, name string, price_cents long, in_stock boolean")
    return marketplace.comparison(marketplace.groups(made, ("own",)), made, "own").drop("group")


SOLD = [
    (1, "a", "Samsun SM-A155F/128 6/128 GB Black", 50000), (2, "b", "Samsun Galaksi SM-A155F 128GB black", 52000), (3, "b", "Samsun SM-A255F 6/128 GB", 61000), (4, "a", "Appel Fone 15 Pro 256GB Black", 200000),
    (5, "b", "Appel Fone 15 Pro 256 GB Black", 210000), (6, "b", "Appel Fone 15 Pro 256 GB White", 210000), (7, "a", "Boss WAT28 pralka", 90000), (8, "b", "Boss WAT28 pralka", 190000),
]
JOINED = [(1, 2, "code"), (4, 5, "series")]


@query(f"SELECT * FROM {values(JOINED, 'a, b, strategy')}", prelude=False)
def electronics_pairs(spark, d):
    return electronics.pairs(rows(spark, SOLD, "product_id long, site string, name string, price_cents long"))


@query("SELECT max(product_id) AS newest, count(*) AS products, strftime((SELECT max(finished_at) FROM runs), '%Y-%m-%d') AS finished FROM products", f"{source.RUNS_SQL},{PRODUCTS}")
def search_stamp(spark, d):
    s = search.stamp(source.products(spark, d), source.runs(spark, d))
    return s.withColumn("finished", F.date_format("finished", "yyyy-MM-dd"))
