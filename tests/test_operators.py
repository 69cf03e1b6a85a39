"""Operators on rows made for them: cases that the generated tables do not hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import names
from offerlens.operators import analytics, changes, ingest, matching, resolution
from offerlens.sources import files
from offerlens.streaming import twins

SCHEMA = "product_id long, match_id long, site string, price_cents long, discount_cents long, captured_at string, run_id long, seq struct<l_shipdate: string, l_orderkey: long>, category string, brand string, name string"


def observations(spark, rows):
    made = [(p, m, site, price, sale, f"1998-{run % 100:02}-01 00:00:00", run, (f"{run}", i), cat, brand, name) for i, (p, m, site, price, sale, run, cat, brand, name) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA).withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))


def sample(spark):
    return observations(spark, [
        (1, 1, "client", 1000, None, 199805, "milk", "Ada", "Milk 1 l"), (1, 1, "client", 900, 850, 199806, "milk", "Ada", "Milk 1 l"),
        (2, 1, "rival_a", 950, 940, 199805, "milk", "Ada", "milk 1 l"), (2, 1, "rival_a", 950, None, 199806, "milk", "", "milk 1 l"),
        (3, 2, "rival_a", 700, None, 199806, "tea", "Bo", "Tea 20 pcs"), (4, 2, "rival_b", 800, None, 199805, "tea", "Bo", "Tea 40 pcs"),
    ])


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_promotions_start_and_end(spark):
    assert rows(changes.promo_diff(sample(spark), 199806, 199805), "site", "title", "change") == [("client", "milk", "started"), ("rival_a", "milk", "ended")]


def test_gaps_are_clusters_without_the_client(spark):
    assert rows(analytics.assortment_gaps(sample(spark)), "match_id", "price") == [(2, 800)]
    assert rows(analytics.missing_at(sample(spark), "rival_b"), "match_id") == [(1,)]


def test_new_products_and_exclusive_brands(spark):
    assert rows(changes.new_products(sample(spark), 199806), "product_id") == [(3,)]
    recent = sample(spark).withColumn("captured_at", F.lit("2001-11-01 00:00:00").cast("timestamp_ntz"))
    only = recent.where("product_id in (1, 2, 3)")
    assert rows(analytics.brand_share(only).where("brand <> ''"), "brand", "total", "exclusive") == [("Ada", 2, False), ("Bo", 1, True)]


def test_store_diff(spark):
    assert rows(ingest.store_diff(sample(spark), 199806, 199805), "product_id", "state", "old", "new") == [(1, "price_changed", 1000, 850), (2, "price_changed", 940, 950), (3, "new", None, 700), (4, "gone", 800, None)]


def test_merge_keeps_what_is_not_empty(spark):
    assert rows(ingest.merged(sample(spark)).where("product_id < 3"), "product_id", "brand", "last_discount", "first_run", "last_run") == [(1, "Ada", 850, 199805, 199806), (2, "Ada", 940, 199805, 199806)]


def test_orphans_include_null_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "p long")
    assert rows(ingest.orphans(child, "k", parent, "p"), "k") == [(2,), (None,)]


def test_same_names_make_groups_and_packs_keep_apart(spark):
    products = sample(spark).select("product_id", "site", "name").distinct()
    assert rows(matching.same_key_groups(products), "sites", "cluster") == [(2, 1)]
    found = resolution.resolved(products, ("client", "rival_a", "rival_b"))
    assert rows(found, "product_id", "cluster") == [(1, 1), (2, 1)]


def test_crowded_blocks_lose_no_pairs(spark, monkeypatch):
    """However many names a block has, every pair in it is compared, against a plain version of the ratio."""
    def ratio(a, b):
        a, b = set(a.lower().split()), set(b.lower().split())
        both, x, y = (" ".join(sorted(s)) for s in (a & b, a - b, b - a))
        table = [[0] * (len(y) + 1)]
        for c in x:
            row = [0]
            for j, d in enumerate(y):
                row.append(max(row[-1], table[-1][j + 1], table[-1][j] + (c == d)))
            table.append(row)
        k, blank = len(both), bool(both)
        found = [1 - (len(x) + len(y) - 2 * table[-1][-1]) / (2 * (k + blank) + len(x) + len(y))]
        found += [1 - (blank + len(r)) / (2 * k + blank + len(r)) for r in (x, y)] * blank
        return 100.0 if blank and not (x and y) else 100 * max(found)

    monkeypatch.setattr(resolution, "CROWDED", 3)
    named = [f"melo {a}{b}ra {c}" for a in ("ta", "te") for b in ("ni", "no", "na") for c in ("dol", "dal", "bed")]
    df = spark.createDataFrame([(n, "Melo") for n in named], "name string, brand string")
    got = {(r.a, r.b): r.score for r in resolution.links_in(resolution.blocks(df), ("brand_word",), 80.0, ()).collect()}
    want = {(a, b): s for a in named for b in named if a < b and (s := ratio(a, b)) >= 80}
    assert set(got) == set(want) and all(abs(got[p] - s) < 1e-9 for p, s in want.items())


def test_products_are_resolved_one_a_site(spark):
    made = [
        (1, "a", "Loremol 500 mq №20", "Lor", "40000001"), (2, "b", "Loremol 500mg N20 tabletlər", "Lor", "40000001"), (3, "a", "Altay sampun malina 200 ml", "Altay", None),
        (4, "b", "Altay şampun limon 200 ml", "Altay", None), (5, "c", "Altay shampun malina 200ml", "Altay", None), (6, "b", "Altay malina sampun 200 ml", "Altay", None),
        (7, "a", "Same", "X", None), (8, "a", "Same", "X", None), (9, "b", "Same", "X", None), (10, "c", "Same", "X", None), (11, "c", "Same", "X", None), (12, "b", None, "X", None),
    ]
    df = spark.createDataFrame(made, "product_id long, site string, name string, brand string, barcode string")
    found = resolution.resolved(df, ("a", "b", "c")).collect()
    again = resolution.resolved(df.orderBy(F.desc("product_id")).repartition(3), ("a", "b", "c")).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    groups = {}
    for r in found:
        groups.setdefault(r.cluster, []).append(r)
    assert {frozenset(r.product_id for r in g) for g in groups.values() if g[0].strategy != "same_name"} == {frozenset({1, 2}), frozenset({3, 5, 6})}
    same = [r.product_id for g in groups.values() if g[0].strategy == "same_name" for r in g]
    assert sorted(same) == [7, 8, 9, 10, 11]
    assert all(len({r.site for r in g}) == len(g) > 1 for g in groups.values())


def test_search_ranks_whole_names_first(spark):
    products = sample(spark).select("product_id", "site", "name").distinct()
    assert rows(matching.search(products, "milk 1"), "product_id", "rank") == [(1, 1), (2, 1)]
    assert matching.search(products, "coffee").count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([("2 x 10", "3,50 €"), (None, None)], "name string, price string")
    assert rows(df, names.pack_count(F.lit(""), F.col("name"))["count"], names.price_cents(F.col("price"))) == [(1, None), (20, 350)]
    assert rows(spark.createDataFrame([("=1+1",), ("ok",), (None,)], "c string"), files.safe_cell(F.col("c"))) == [("'=1+1",), ("ok",), (None,)]
    assert rows(spark.createDataFrame([(404,), (200,), (500,)], "s int"), "s", files.link_state(F.col("s"))) == [(200, "alive"), (404, "dead"), (500, "error")]


def test_streamed_journal_keeps_changes_only(spark, tmp_path):
    made = [(1, 100, None, "2020-01-01 00:00:00"), (1, 100, None, "2020-01-02 00:00:00"), (1, 90, None, "2020-01-03 00:00:00"), (1, 90, 80, "2020-01-04 00:00:00"), (2, 5, None, "2020-01-01 00:00:00")]
    spark.createDataFrame(made, "product_id long, price_cents long, discount_cents long, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = twins.stream(spark, str(tmp_path / "in"), "product_id long, price_cents long, discount_cents long, at timestamp", files=1000)
    got = twins.drained(twins.journal(stream))
    assert rows(got, "product_id", "price_cents", "discount_cents") == [(1, 100, -1), (1, 90, -1), (1, 90, 80), (2, 5, -1)]


def test_nearest_by_facts_against_all_candidates(spark):
    """Few rows stand for all pairs: the first of them is the first of all, and products alike do not multiply."""
    import random

    from pyspark.sql import functions as F

    from offerlens.operators import near

    rng = random.Random(8)
    mine = [(p, rng.choice("xyz"), rng.randrange(3), rng.choice([None, "de", "fr"])) for p in range(60)]
    other = [(1000 + q, rng.choice("xyzuv"), rng.choice("ab"), rng.random() < 0.3, rng.randrange(4), rng.choice([None, "de", "fr"])) for q in range(90)]
    links = [(n, o, s, rng.randrange(3)) for n in "xyz" for o in "xyzuvw" for s in "ab" if rng.random() < 0.5]
    want = {}
    for p, name, price, country in mine:
        for n, o, s, gap in links:
            for q, on, os, current, q_price, q_country in other:
                if n == name and (on, os) == (o, s):
                    key = (gap, not current, not (price == q_price and (country is None or country == q_country)), q)
                    want[p, s] = min(want.get((p, s), key), key)
    m = spark.createDataFrame(mine, "p long, name string, p_price long, p_country string")
    o = spark.createDataFrame(other, "q long, other string, q_site string, current boolean, q_price long, q_country string")
    found = near.nearest_by_facts(m, o, spark.createDataFrame(links, "name string, other string, q_site string, gap long"))
    assert found.groupBy("p", "q_site").count().where("count > 2").count() == 0
    judged = found.withColumns({"together": F.lit(False), "same_price": F.col("p_price") == F.col("q_price"), "same_country": F.col("p_country").isNull() | F.col("p_country").eqNullSafe(F.col("q_country"))})
    assert want and {(r.p, r.q_site): (r.gap, r.q) for r in near.closest_first(judged).collect()} == {k: (v[0], v[3]) for k, v in want.items()}
