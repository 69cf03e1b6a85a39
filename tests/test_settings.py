"""Settings, seeds and standing, on rows made for their rules."""

from __future__ import annotations

import pytest

from offerlens.operators import health, intake, settings, trust
from offerlens.sources import seeds

CONFIG = "tenant_id long, raise_bp long, undercut_bp long, spread_bp long, margin_bp long, per_type long"
RUN = "id long, tenant_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string, scope string, verified boolean, mode string, eligible_flag boolean, full_sites string, site_products map<string,long>, site_status map<string,string>, partition struct<complete: boolean, total: long, trusted: long, isolated: long, excluded: long>"
PRODUCT = "product_id long, tenant_id long, site string, name string, dead boolean, category string, manual_key string, conflicted boolean, last_seen_at timestamp_ntz"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def day(n):
    from datetime import datetime

    return datetime(2001, 1, n)


def test_seed_files(spark, tmp_path):
    text = """
    # outside
other:
  a:
    label_ru: no
categories:
    a:   # a block
        label_ru: "A: one # two"
        rival: x#1 # said
        empty:
    b: plain
    'c':
        label_ru:
        label_az: ~
        client: 'it'
        client: last
    a:
        label_ru: again
    d:
end: 1
"""
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "s.yaml").write_text(text)
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "two.yaml").write_bytes(b"categories:\r\n  a:\r\n    label_az: z\r\n")
    found = seeds.category_seeds(spark, str(tmp_path), ("client", "rival"))
    assert rows(found, "key", "label_ru", "label_az", "client_slug", "rival_slug") == sorted([("a", "again", None, None, None), ("c", "c", None, "last", None), ("a", "a", "z", None, None)], key=repr)
    one = tmp_path / "first.yaml"
    one.write_text(text.replace("    a:\n        label_ru: again\n", ""))
    assert rows(seeds.category_seeds(spark, str(one), ("client", "rival")).where("key = 'a'"), "label_ru", "rival_slug") == [("A: one # two", "x#1")]


def test_sections(spark):
    made = spark.createDataFrame([(1, True, "b", "narrow"), (2, True, "", "wide"), (3, True, None, "k=v"), (4, False, "d", "wide")], "id long, is_active boolean, client_slug string, rival_slug string")
    routes = spark.createDataFrame([(9, "third", "z", True), (8, "third", "y", False), (7, "client", "x", True)], "id long, site string, slug string, is_active boolean")
    sites, broad = ("client", "rival", "third"), {"rival": ("wide",)}
    assert rows(settings.sections_to_visit(made, routes, sites, broad)) == [("client", "b", 1, 1), ("rival", "k=v", 0, 3), ("rival", "narrow", 1, 1), ("rival", "wide", 0, 2), ("third", "z", 1, 9)]
    assert rows(settings.sections_to_visit(made, routes, sites, {}, only=2)) == [("rival", "wide", 1, 2)]


def test_categories_by_hand(spark):
    p = spark.createDataFrame([(1, 1, "client", "Krem", False, "own", "old", False, None), (2, 1, "client", "50% krem", True, None, None, False, None), (3, 2, "client", "a", False, "theirs", "old", False, None), (1, 1, "rival", "Krem", False, "own", "rival's", False, None)], PRODUCT)
    edits = spark.createDataFrame([(1, 1, 1, "own"), (2, 1, 1, "fixed"), (3, 1, 1, "theirs"), (4, 1, 2, "fixed"), (5, 1, 2, None), (6, 2, 3, "fixed"), (7, 1, 3, None), (8, 1, None, "fixed")], "seq long, tenant_id long, product_id long, category_key string")
    canonical = spark.createDataFrame([("fixed",), ("fixed",)], "key string")
    done = settings.category_edits(p, edits, canonical, "client")
    assert [r[1] for r in rows(done, "seq", "outcome")] == ["set", "set", "unknown_category", "set", "cleared", "set", "no_product", "no_product"]
    assert rows(settings.categorized(p, done, "client"), "tenant_id", "product_id", "site", "manual_key") == [(1, 1, "client", "fixed"), (1, 1, "rival", "rival's"), (1, 2, "client", None), (2, 3, "client", "fixed")]
    assert [r.product_id for r in settings.suggested_products(p, " KR ", "client").collect()] == [1]
    assert not settings.suggested_products(p, "k", "client").count()
    assert settings.suggested_products(p, "kr_m", "client", limit=0).count() == 1


def test_thresholds(spark):
    tenants = spark.createDataFrame([(1,), (2,), (2,)], "tenant_id long")
    configs = spark.createDataFrame([(1, 100, None, 9000, 0, 1)], CONFIG)
    limits = settings.thresholds(configs, tenants)
    assert rows(limits) == [(1, 100, 300, 9000, 0, 1), (2, 500, 300, 8000, 1000, 10)]
    gaps = spark.createDataFrame([(1, 1, 10000, 10100), (1, 2, 10000, 10200), (1, 3, 10000, 10200), (2, 4, 10000, 10400), (2, 5, 10000, 9700), (2, 6, 10000, 1000), (2, 7, None, 5), (2, 8, 0, 5), (3, 9, 10000, 20)], "tenant_id long, match_id long, client long, rival long")
    assert rows(settings.within_thresholds(gaps, limits)) == [(1, "price_raise", 1, 2, 200), (2, "undercut", 1, 5, 300)]
    edits = spark.createDataFrame([(1, 2, 2, 2, 2, 2, 2), (1, 1, 1, 1, 1, 1, 1)], "tenant_id long, seq long, raise_bp long, undercut_bp long, spread_bp long, margin_bp long, per_type long")
    now, kept = settings.reconfigured(configs, edits, tenants)
    assert rows(now) == [(1, 2, 2, 2, 2, 2)] and rows(kept) == [(2,), (2,)]


def test_onboarding(spark):
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "tenant_id long")
    people = spark.createDataFrame([(3, True), (4, False)], "tenant_id long, is_active boolean")
    found = settings.onboarding(ids(1, 2, 3, 4, 4, 5), {"runs": ids(2, 2), "categories": ids(3, 4), "recipients": people, "products": ids(9), "tracked": ids(5)})
    assert rows(found, "tenant_id", "state") == [(1, "empty_db"), (2, "need_categories"), (3, "ready"), (4, "need_recipients"), (5, "empty_db")]


def test_queues(spark):
    asked = spark.createDataFrame([(1, 1, "pending", day(2)), (2, 1, "pending", day(1)), (3, 1, "running", day(1)), (4, 1, None, None), (5, 2, "done", day(1))], "id long, tenant_id long, status string, requested_at timestamp_ntz")
    assert rows(settings.queues(asked), "tenant_id", "pending", "running", "oldest_id") == [(1, 2, 1, 2), (2, 0, 0, None)]


def a_run(n, status="ok", verified=True, sites="a,b", went=("ok", "ok"), scope="full"):
    return (n, 1, day(n), day(n), status, scope, verified, "scan", True, sites, {"a": 1, "b": 1}, {"a": went[0], "b": went[1]}, None)


@pytest.mark.parametrize(
    ("runs", "want"),
    [
        ([], ("degraded", None, "missing", False, False)),
        ([a_run(1)], ("up", "ok", "ok", True, True)),
        ([a_run(1, sites="a")], ("degraded", "ok", "degraded", False, False)),
        ([a_run(1), a_run(2, "failed", sites="b")], ("degraded", "failed", "failed", False, False)),
        ([a_run(1, went=("ok", "failed"))], ("degraded", "ok", "degraded", False, True)),
        ([a_run(1), a_run(2, "degraded", scope="partial")], ("degraded", "degraded", "ok", True, True)),
        ([a_run(1), a_run(2, scope="partial")], ("up", "ok", "ok", True, True)),
    ],
)
def test_health(spark, runs, want):
    p = spark.createDataFrame([(1, 1, "a", "n", False, None, None, False, day(3)), (2, 1, "b", "n", False, None, None, True, day(3)), (3, 2, "b", "n", False, None, None, True, None)], PRODUCT)
    now = "2001-01-04 00:00:00"
    found = health.snapshot(spark.createDataFrame(runs, RUN), p, ("a", "b"), {"a": 24}, now)
    assert rows(found, "status", "last_run_status", "full_status", "verified", "source_complete", "apart", "trusted") == [(*want, 1, 1)]
    assert rows(health.staleness(p, {"a": 23}, now), "site", "seconds", "hours", "stale") == [("a", 86400, 23, True), ("b", 86400, 30, False)]


def test_country_dictionary(spark):
    known = spark.createDataFrame([(1, "7", "de", "Germany", "u", 3, 4), (1, "8", "tr", "Turkey", "u", 1, 1)], "tenant_id long, country_id string, country_code string, country_raw string, source_url string, sample_count long, version long")
    found = spark.createDataFrame([(1, "7", 1, "DE", " Germany ", "new", 9), (1, "8", 1, "fr", "France", "f", None), (1, "8", 2, "tr", "Turkey", "t", 2), (1, "8", 3, "", "x", "x", 1), (2, "7", 1, "az", "AZ", "a", 0), (2, "9", 1, "az", "  ", "a", 1), (2, "9", 2, None, "x", "a", 1)], "tenant_id long, country_id string, seq long, country_code string, country_raw string, source_url string, sample_count long")
    assert rows(intake.country_dictionary(known, found)) == [(1, "7", "de", "Germany", "u", 3, 4, False), (1, "8", "tr", "Turkey", "t", 2, 3, True), (2, "7", "az", "AZ", "a", 1, 1, True)]
    assert rows(intake.country_dictionary(known, found.limit(0)), "version", "changed") == [(1, False), (4, False)]


def test_continuity(spark):
    known = spark.createDataFrame([("1", "u1", 1), ("2", "u2", 1), ("3", None, 1), ("4", "u4", 2), ("x", "u9", 1)], "external_id string, url string, tenant_id long")
    check = lambda *r: rows(intake.continuity_faults(spark.createDataFrame(list(r), "external_id string, url string"), known, 1, r"^\d+$"))
    assert check(("1", "u1"), ("1", "u1"), ("3", "u3"), ("5", "u5"), ("x", "u1"), (None, "u1"), ("6", "u9")) == []
    assert check(("1", "n")) == [("1", "n", "rebound")]
    assert check(("5", "u2")) == [("5", "u2", "taken")]
    assert check(("4", "u4")) == [("4", "u4", "rebound"), ("4", "u4", "taken")]
    assert check(("5", "a"), ("5", "b"), ("6", None), ("7", "c"), ("8", "c")) == [("5", "a", "ambiguous"), ("5", "b", "ambiguous"), ("6", None, "ambiguous"), ("7", "c", "ambiguous"), ("8", "c", "ambiguous")]


def test_coverage_counts_products_once(spark):
    obs = spark.createDataFrame([("a", 1, 5, day(1)), ("a", 1, None, day(2)), ("a", 2, None, None), ("a", None, 1, day(1))], "site string, product_id long, discount_cents long, captured_at timestamp_ntz")
    assert rows(trust.coverage(obs, "2001-02-01 00:00:00")) == [("a", 2, 1, 1, 50.0)]
    assert rows(trust.coverage(obs.limit(0))) == []
