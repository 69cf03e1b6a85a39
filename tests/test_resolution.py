"""Entity resolution against plain versions: one link after another, and every pair of names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.operators import guards, near, resolution

SITES = ("a", "b", "c")
SCHEMA = "product_id long, site string, name string, brand string, country_code string"


def made(n: int, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    heads, tails = ["Lorem", "Ipsum", "Dolor", "Amet", "Elit"], ["", "", "krem", "gel", "malina", "limon", "forte", "Nova", "Altay"]
    names = [f"{rng.choice(heads)} {rng.choice(tails)} {rng.choice(tails)} {rng.choice(['', '100 mq', '200 mq', '5 mq/10 mq', '10 mq/5 mq'])} {rng.choice(['', 'N10', 'N20'])}" for _ in range(n)]
    names = [" ".join(x.split()) for x in names]
    return [(i + 1, rng.choice(SITES), rng.choice([x, x.upper(), x]), rng.choice([None, None, "Nova"]), rng.choice([None, None, "de", "tr"])) for i, x in enumerate(names)]


def greedy(products: list[tuple], links: dict) -> list[tuple]:
    """The best link of all is taken, then the next, site by site; clusters as sorted kinds of their members."""
    clusters = [(k,) for _, site, k in products if site == SITES[0]]
    for site in SITES[1:]:
        free = sorted(k for _, s, k in products if s == site)
        open_clusters, grown = sorted(clusters), []
        while True:
            best = min(((max(links[c, r][0] for c in l), -min(links[c, r][1] for c in l), r, l) for l in set(open_clusters) for r in set(free) if all((c, r) in links for c in l)), default=None)
            if best is None:
                break
            *_, r, l = best
            free.remove(r)
            open_clusters.remove(l)
            grown.append(tuple(sorted({*l, r})))
        clusters = open_clusters + grown + [(r,) for r in free]
    return sorted(c for c in clusters if len(c) > 1)


@pytest.mark.parametrize("seed", [1])
def test_clusters_are_those_of_one_link_after_another(spark, seed):
    df = spark.createDataFrame(made(90, seed), SCHEMA)
    kinds = df.withColumn("kind", resolution.kind("site", "name", "country_code"))
    links = {(r.a, r.b): (r["pass"], r.score) for r in resolution.kind_links(kinds, crowd=1000).collect()}
    assert len(links) > 20 and all((b, a) in links for a, b in links)
    of = {r.product_id: r.kind for r in kinds.collect()}
    found: dict[int, list] = {}
    for r in resolution.resolved(df, SITES, crowd=1000).collect():
        found.setdefault(r.cluster, []).append(of[r.product_id])
    assert sorted(tuple(sorted(set(g))) for g in found.values()) == greedy([(r.product_id, r.site, r.kind) for r in kinds.collect()], links)


def test_links_against_all_pairs(spark):
    """Every pair of one block that no rule tells apart and that is like enough, none of names that fit several."""
    df = spark.createDataFrame(made(70, 5), SCHEMA).withColumn("kind", resolution.kind("site", "name", "country_code"))
    f = resolution.blocks(df).dropDuplicates(["name"])
    both = guards.side(f, "a_").crossJoin(guards.side(f, "b_")).where("a_name <> b_name").where(~guards.conflict("a_", "b_"))
    like = both.select("a_name", "b_name", text.token_set_ratio(F.col("a_key"), F.col("b_key")).alias("s")).where("s >= 75")
    want = {(r.a_name, r.b_name) for r in like.collect()}
    links = resolution.kind_links(df, crowd=1000).collect()
    names = lambda k: k.split("\x01")[1]
    assert links and all(names(r.a) == names(r.b) or (names(r.a), names(r.b)) in want for r in links)
    countries = lambda k: k.split("\x01")[2]
    assert all(r.a[0] != r.b[0] and (not countries(r.a) or not countries(r.b) or countries(r.a) == countries(r.b)) for r in links)


def test_what_else_is_listed_speaks_against_a_pair(spark):
    """Crowded first words, names that fit several, siblings of a form, and orders of doses that mean something; one group each."""
    listed = [
        ("a", "Spris 5 ml"), ("b", "Spris 5 ml Braun"), ("a", "Spris 2 ml Braun"), ("b", "Spris Braun 2 ml"), ("c", "Spris 20 ml Nova"),
        ("a", "Caytikani yagi 100ml"), ("b", "Caytikani yagi Altay 100ml"), ("b", "Caytikani yagi Mirola 100ml"), ("c", "Caytikani yagi Altay 100 ml"),
        ("a", "Ukra 100 mq"), ("b", "Ukra 100 mq şam"), ("a", "Ukra 100 mq şam"),
        ("b", "Pres 5 mq/10 mq"), ("a", "Pres 10 mq/5 mq"), ("a", "Pres 5 mq/10 mq"), ("b", "Ram 5 mq/10 mq"), ("a", "Ram 10 mq/5 mq"),
    ]
    df = spark.createDataFrame([(i, s, n, None, None) for i, (s, n) in enumerate(listed, 1)], SCHEMA)
    groups: dict[int, set] = {}
    for r in resolution.resolved(df, SITES, crowd=5).collect():
        groups.setdefault(r.cluster, set()).add(r.product_id)
    assert sorted(map(sorted, groups.values())) == [[3, 4], [7, 9], [11, 12], [13, 15], [16, 17]]


@pytest.mark.parametrize("most, cell", [(1, 250), (2, 3), (3, 2)])
def test_near_names_against_all_pairs(spark, monkeypatch, most, cell):
    monkeypatch.setattr(near, "CROWDED", cell)
    rng = random.Random(8)
    words = ["bar", "ber", "bor", "dan", "den", "don", "mal", "mel"]
    named = {f"{i} " + " ".join(rng.sample(words, rng.randrange(1, 6))) for i in range(60)} | {"bar", "ber", "solo"}
    rows = [(n, sorted(set(n.split()) - {n.split()[0]} if n[0].isdigit() else set(n.split()))) for n in named]
    want = {(a, b): len(set(x) ^ set(y)) for a, x in rows for b, y in rows if a < b and set(x) & set(y) and len(set(x) ^ set(y)) <= most}
    found = near.near_names(spark.createDataFrame([r for r in rows if r[1]], "name string, key array<string>"), most).collect()
    assert len(found) == len(want) and {(r.a, r.b): r.gap for r in found} == want


def test_products_are_worked_out_once(spark):
    """What comes out reads written rows only, not the products again."""
    rows = spark.createDataFrame([(1, "a", "altai krem 100 mq", "123456789"), (2, "b", "krem altai 100 mq", "123456789")], "product_id long, site string, name string, barcode string").repartition(2)
    found = resolution.resolved(rows, ("a", "b"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert sorted((r.product_id, r.cluster, r.strategy) for r in found.collect()) == [(1, 1, "barcode"), (2, 1, "barcode")]
