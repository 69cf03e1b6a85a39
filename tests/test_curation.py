"""Upkeep of clusters against plain versions, and what holds after it: reruns find nothing, the log undoes it."""

from __future__ import annotations

import random
from datetime import datetime
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from offerlens.operators import curation
from offerlens.sources.shared import stored

NOW = "2020-02-01 00:00:00"
NEW, OLD = datetime(2020, 1, 31), datetime(2019, 12, 1)
SCHEMA = "product_id long, site string, match_id long, is_manual boolean, dead boolean, matchable boolean, norm string, dose string, pack long, strengths array<long>, block string, url string, country_code string, last_seen_at timestamp_ntz, price_cents long"


def row(i, site, match_id, *, manual=False, dead=False, ok=True, name="n", url=None, country=None, seen=NEW, price=100, pack=1):
    return (i, site, match_id, manual, dead, ok, name, "d", pack, [1], "k", url, country, seen, price)


def clash(a, b):
    x, y = F.col(a + "product_id"), F.col(b + "product_id")
    return ((x + y) % 7 == 0) & (x != y)


def no_clash(a, b):
    return F.lit(False)


def no_gap(a, b):
    return F.lit(0)


def fresh(spark, rows):
    return stored(curation.with_freshness(spark.createDataFrame(rows, SCHEMA), NOW))


def moves(df):
    return sorted(((r.product_id, r.before, r.after) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_splits_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    members, conflicts, want = [], [], {}
    for m in range(60):
        lot = [(m, m * 10 + i, rng.choice("abc"), m % 9 == 0, rng.random() < 0.08) for i in range(rng.randrange(1, 7))]
        members += lot
        mine = {(x[1], y[1]): rng.choice(["spec", "country"]) for x, y in combinations(lot, 2) if x[2] != y[2] and rng.random() < 0.25}
        conflicts += [(m, a, b, kind) for (a, b), kind in mine.items()]
        if m % 9 == 0 or not (mine or any(x[4] for x in lot)):
            continue
        groups: list[list] = []
        for x in (x for x in lot if not x[4]):
            for g in groups:
                if all((y[1], x[1]) not in mine for y in g):
                    g.append(x)
                    break
            else:
                groups.append([x])
        good = sorted((g for g in groups if len({x[2] for x in g}) > 1), key=len, reverse=True)
        kind = "offer" if any(x[4] for x in lot) else "country" if "country" in mine.values() else "spec"
        want[m] = (kind + ("_repartition" if good else "_dissolve"), [[x[1] for x in g] for g in good], sorted({x[1] for x in lot} - {x[1] for g in good for x in g}))
    df = spark.createDataFrame(members, "match_id long, product_id long, site string, is_manual boolean, out_of_stock boolean")
    pairs = spark.createDataFrame(conflicts, "match_id long, a long, b long, kind string")
    audits = curation.splits(df, pairs).cache()
    assert {r.match_id: (r.action, r.groups, sorted(r.unmatched)) for r in audits.collect()} == want
    after = curation.applied(df, curation.split_moves(audits)).where("match_id is not null")
    left = pairs.select("a", "b", "kind").join(after.select(F.col("product_id").alias("a"), "match_id"), "a").join(after.select(F.col("product_id").alias("b"), "match_id"), ["b", "match_id"]).select("match_id", "a", "b", "kind")
    assert curation.splits(after, left).count() == 0
    assert curation.split_rejections(audits, pairs).count() == sum(c[0] in want for c in conflicts)


def test_dead_members_are_replaced_in_order_of_clusters(spark):
    rng = random.Random(4)
    state, places = [], []
    for m in range(12):
        state += [row(m * 10, "a", m), row(m * 10 + 1, "b", m, dead=True, manual=m == 3)]
        places.append((m, m * 10 + 1, m * 10))
    frees = [row(1000 + i, "b", None, dead=i == 2, price=rng.randrange(70, 100)) for i in range(9)]
    state += frees + [row(2000, "b", None, price=99, pack=2), row(2001, "a", None, price=99)]
    taken, want = set(), []
    for m, dead, anchor in places:
        fit = [(-f[-1], f[0]) for f in frees if f[-1] >= 80 and not f[4] and f[0] not in taken and (f[0] + anchor) % 7]
        if m != 3 and fit:
            new = min(fit)[1]
            taken.add(new)
            want += [(dead, m, None), (new, None, m)]
    score = lambda a, b: F.col(b + "price_cents").cast("double")
    df = spark.createDataFrame(state, SCHEMA)
    found = stored(curation.dead_moves(df, clash, score))
    assert want and moves(found) == sorted(want, key=repr)
    assert moves(curation.dead_moves(stored(curation.applied(df, found)), clash, score)) == []


def test_lost_rows_hand_over_to_their_only_twin(spark):
    state = [
        row(1, "a", 1, seen=OLD), row(2, "b", 1), row(3, "a", None),  # handed over
        row(11, "a", 2, seen=OLD, name="two", url="u"), row(12, "b", 2), row(13, "a", None, name="two", url="u"), row(14, "a", None, name="two"),  # by address
        row(21, "a", 3, seen=OLD, name="three"), row(22, "a", None, name="three"), row(23, "a", None, name="three"),  # two twins
        row(31, "a", 4, seen=OLD, name="four", country="de"), row(32, "a", None, name="four"),  # knows less
        row(41, "a", 5, seen=OLD, name="five", manual=True), row(42, "a", None, name="five"),
        row(51, "a", 6, seen=OLD, name="six"), row(53, "b", 6), row(52, "a", None, name="six"),  # 52 + 53 = 105 clash
        row(61, "c", 7, seen=OLD, name="seven"), row(62, "c", 8, seen=OLD), row(63, "c", None, name="seven"), row(64, "c", 8, seen=OLD),  # site not seen
    ]
    df = fresh(spark, state + [row(100 + i, "a", None, name=f"x{i}") for i in range(9)])
    assert {r.product_id for r in df.where("unknown").collect()} == {61, 62, 64}
    found = stored(curation.lost_moves(df, clash))
    assert moves(found) == sorted([(1, 1, None), (3, None, 1), (11, 2, None), (13, None, 2)], key=repr)
    assert moves(curation.lost_moves(stored(curation.applied(df, found)), clash)) == []


def test_clusters_of_a_lost_row_and_its_twin_are_joined(spark):
    state = [
        row(1, "a", 1), row(2, "b", 1, seen=OLD, name="x"), row(3, "b", 2, name="x"), row(4, "c", 2),  # the larger stays
        row(11, "a", 3), row(12, "b", 3, seen=OLD, name="y"), row(13, "b", 4, name="y"), row(14, "a", 4),  # a site on both sides
        row(21, "a", 5), row(22, "b", 5, seen=OLD, name="z"), row(23, "b", 6, name="z"), row(24, "c", 6), row(25, "d", 6), row(26, "b", None, name="w"),
        row(31, "a", 7), row(32, "b", 7, seen=OLD, name="v"), row(33, "b", 8, name="v", manual=True),
        row(40, "a", 9), row(42, "b", 9, seen=OLD, name="t"), row(43, "b", 10, name="t"), row(44, "c", 10), row(45, "b", None, name="t"),  # another twin, free
    ]
    df = fresh(spark, state + [row(100 + i, "b", None, name=f"q{i}") for i in range(9)])
    found = stored(curation.merge_moves(df, no_clash))
    assert moves(found) == sorted([(2, 1, None), (1, 1, 2), (22, 5, None), (21, 5, 6)], key=repr)
    after = stored(curation.applied(df, found))
    assert moves(curation.merge_moves(after, no_clash)) == []
    assert curation.rollback_faults(after, curation.logged(found, 1), 0).count() == 0


def test_price_strangers_are_replaced(spark):
    state = [
        row(1, "a", 1), row(2, "b", 1, price=100), row(3, "c", 1, price=150), row(4, "c", None, price=100),  # replaced
        row(11, "a", 2, price=300), row(12, "b", 2, price=390), row(13, "b", None, price=300), row(14, "b", None, price=300),  # two could
        row(21, "a", 3, price=500), row(22, "b", 3, price=590), row(23, "b", None, price=500),  # agreed before
        row(31, "a", 4, price=700), row(32, "b", 4, price=790, country="de"), row(33, "b", None, price=700),  # knows less
        row(41, "a", 5, price=900), row(42, "b", 5, price=990, manual=True), row(43, "b", None, price=900),
    ]
    df = fresh(spark, state)
    journal = df.select("product_id", "price_cents").union(spark.createDataFrame([(22, 500)], "product_id long, price_cents long"))
    found = stored(curation.stranger_moves(df, journal, no_clash, no_gap))
    assert moves(found) == sorted([(3, 1, None), (4, None, 1)], key=repr)
    assert moves(curation.stranger_moves(stored(curation.applied(df, found)), journal, no_clash, no_gap)) == []


def test_rollback_refuses_what_the_log_does_not_tell(spark):
    state = spark.createDataFrame([(1, 10), (2, None), (3, 20), (4, 30)], "product_id long, match_id long")
    log = spark.createDataFrame([(1, 1, None, 5, "x"), (2, 1, 5, 10, "x"), (2, 2, 9, None, "x"), (3, 3, 7, 20, "spec_repartition")], "seq long, product_id long, before long, after long, reason string")
    assert {(r.product_id, r.match_id) for r in curation.rolled_back(state, log, 0).collect()} == {(1, None), (2, 9), (3, 7), (4, 30)}
    assert {(r.product_id, r.match_id) for r in curation.rolled_back(state, log, 1).collect()} == {(1, 5), (2, 9), (3, 7), (4, 30)}
    faults = lambda s, entries: {(r.product_id, r.fault) for r in curation.rollback_faults(s, entries, 0).collect()}
    moved = state.withColumn("match_id", F.when(F.col("product_id") == 4, 20).when(F.col("product_id") == 2, 9).otherwise(F.col("match_id"))).where("product_id <> 3")
    assert faults(moved, log) == {(2, "moved since"), (3, "product is gone"), (4, "joined since")}
    assert faults(state, log.where("seq <> 1").union(log.where("seq = 1").withColumn("after", F.lit(6)))) == {(1, "gap in the log")}
    with pytest.raises(ValueError):
        curation.rolled_back(moved, log, 0)


def test_first_come(spark):
    rng = random.Random(6)
    edges = [(a, a % 5, b, rng.randrange(4)) for a in range(15) for b in range(8) if rng.random() < 0.5]
    taken: dict[int, int] = {}
    for a in sorted({e[0] for e in edges}, key=lambda a: (a % 5, a)):
        free = [(w, b) for x, _, b, w in edges if x == a and b not in taken.values()]
        if free:
            taken[a] = min(free)[1]
    found = curation.first_come(spark.createDataFrame(edges, "a long, turn long, b long, wish long"))
    assert {r.a: r.b for r in found.collect()} == taken
