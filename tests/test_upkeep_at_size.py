"""Upkeep of clusters where many rows are alike: the same moves as one after another, without all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from offerlens.operators import curation
from offerlens.plans import curation as plans
from offerlens.sources.shared import stored

from .test_curation import NOW, OLD, SCHEMA, clash, fresh, moves, no_gap, row


def test_dead_members_of_a_kind_share_a_list(spark):
    """Windows about each turn, rows that clash with whole windows, and lists that end give what turns one by one give."""
    rng = random.Random(9)
    state, places = [], []
    for m in range(160):
        name = rng.choice(["n", "n", "o"])
        state += [row(m * 10, "a", m), row(m * 10 + 1, "b", m, dead=True, name=name)]
        places.append((m, m * 10 + 1, m * 10, name))
    frees = [row(7000 + i, "b", None, name=rng.choice(["n", "o", "p"])) for i in range(150)]
    points = {("n", "n"): 100, ("o", "o"): 100, ("n", "o"): 90, ("o", "n"): 90}
    hard = lambda m, c: m % 30 == 0 and c % 9 != 0 or (m + c) % 7 == 0
    taken, want = set(), []
    for m, dead, anchor, name in places:
        fit = [(-points[name, f[6]], f[0]) for f in frees if (name, f[6]) in points and f[0] not in taken and not hard(anchor, f[0])]
        if fit:
            new = min(fit)[1]
            taken.add(new)
            want += [(dead, m, None), (new, None, m)]
    conflict = lambda a, b: F.expr(f"{a}product_id % 30 = 0 and {b}product_id % 9 <> 0 or ({a}product_id + {b}product_id) % 7 = 0")
    score = lambda a, b: F.when(F.col(a + "norm") == F.col(b + "norm"), F.when(F.col(a + "norm") != "p", 100)).when((F.col(a + "norm") != "p") & (F.col(b + "norm") != "p"), 90)
    assert len(taken) < len(places)
    assert moves(curation.dead_moves(spark.createDataFrame(state + frees, SCHEMA), conflict, score, alike=("norm",))) == sorted(want, key=repr)


def test_strangers_are_looked_at_until_a_second_row_fits(spark):
    """Of 300 rows alike one fits a member, two another, none a third: only the first is replaced."""
    state = []
    for m, sites in enumerate("xyz", 1):
        state += [row(m * 10, "a", m), row(m * 10 + 1, "b", m, price=150, name=sites)]
    frees = [row(1000 + i, "b", None) for i in range(300)]
    fits = {10: {1290}, 20: {1003, 1295}, 30: set()}
    conflict = lambda a, b: ~F.expr(" or ".join([f"{a}product_id = {o} and {b}product_id = {c}" for o, cs in fits.items() for c in cs]))
    state += [row(m * 10 + 2, "c", m) for m in (1, 2, 3)]
    both = lambda a, b: F.when(F.col(a + "site") == "a", conflict(a, b)).otherwise(False)
    df = fresh(spark, state + frees)
    found = curation.stranger_moves(df, df.select("product_id", "price_cents"), both, no_gap, alike=("norm",))
    assert moves(found) == sorted([(11, 1, None), (1290, None, 1)], key=repr)


def shape(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lost_rows_meet_no_twins_but_the_only_one(spark):
    lost = [row(i, "a", i, seen=OLD, url=f"u{i}") for i in range(20)]
    df = fresh(spark, lost + [row(100 + i, "a", None, url=f"u{i % 30}") for i in range(40)])
    found = curation.lost_moves(df, clash)
    assert "Window" not in shape(found)
    # Twins 100 to 109 share their addresses with 130 to 139; of the others each has its own.
    assert moves(stored(found)) == sorted([m for i in range(10, 20) if (2 * i + 100) % 7 for m in ((i, i, None), (100 + i, None, i))], key=repr)


def test_merges_meet_no_twins_but_the_only_one(spark):
    state = [row(1, "a", 1), row(2, "b", 1, seen=OLD, name="x"), row(3, "b", 2, name="x"), row(4, "c", 2)]
    crowd = [row(100 + i, "b", 100 + i, name="y", seen=OLD if i % 3 == 0 else row(0, "b", 0)[13]) for i in range(30)]
    found = curation.merge_moves(fresh(spark, state + crowd), clash)
    assert "count(1) windowspecdefinition" not in shape(found).lower() and "l_product_id#" not in "".join(x for x in shape(found).splitlines() if "Window [" in x)
    assert moves(stored(found)) == sorted([(2, 1, None), (1, 1, 2)], key=repr)


def test_freshness_does_not_deal_rows_by_site(spark):
    """Sites are few: rows dealt by site would be as many tasks, whatever their number."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = curation.with_freshness(spark.createDataFrame([row(1, "a", 1)], SCHEMA), NOW)
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_name_is_folded_once_and_the_last_line_is_one_maximum(spark):
    """The state reads stored rows, its keys are those of its different names, and the last line is no pair of maxima."""
    from offerlens.plans.curation import state_of
    from offerlens.sources.adapter import latest_observations

    d = "/root/testdata/sf0.001"
    plan = shape(state_of(spark, d))
    assert "regexp_replace" not in plan and "Aggregate" not in plan
    assert "max_by" not in shape(latest_observations(spark, d))


def test_no_step_of_the_rollback_collects_rows_at_the_driver(spark, monkeypatch):
    """what grows with the tables is never broadcast, however few bytes its files have; kinds of a block and price are few."""
    found, start = [], plans.fresh(spark, "/root/testdata/sf0.001")

    def seen(df):
        found.append(df._jdf.queryExecution().sparkPlan().toString())
        return df

    faults = curation.rollback_faults
    monkeypatch.setattr(plans, "fresh", lambda *_: start)
    monkeypatch.setattr(curation, "rollback_faults", lambda *x: seen(faults(*x)))
    for module in (curation, plans):
        monkeypatch.setattr(module, "stored", lambda df: stored(seen(df)))
    back = seen(plans.rolled_back_topology(spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in "".join(found)
    assert not [x for plan in found for x in plan.splitlines() if "BroadcastHashJoin" in x and "c_block" not in x]
    assert back.exceptAll(start.select("product_id", "match_id")).isEmpty() and back.count() == start.count()
