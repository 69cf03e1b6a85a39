"""A kept index finds what a search of the names themselves does."""

from __future__ import annotations

import pytest

from offerlens.operators import catalogue_search as search

NAMES = [("Krem Nova 20 q", "Nova"), ("Nova krem", None), ("Ultrakrem gel", "Kremlin"), ("Vitamin C 500 mq", "Melo"), ("Sitrik C-vit", ""), ("", "Nova"), (None, None), ("Krem", "krem"), ("Doktor Melo sirop", "Doktor"), ("Кrem Нова", "x")]
QUERIES = ["krem", "KREM nova", "nova krem", "kren", "novv krem", "vitamin c", "melo", "rem", "trakr", "q", "", "!!", "zzzz", "sirop sirop", "do me si", "ac", "krem zzzz", "20"]


@pytest.fixture(scope="module")
def products(spark):
    made = [(i, "s", n, b) for i, (n, b) in enumerate(NAMES * 3)]
    return spark.createDataFrame(made, "product_id long, site string, name string, brand string")


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([("2001-01-01",)], "finished string").selectExpr("cast(finished as timestamp_ntz) as finished_at")


@pytest.fixture(scope="module")
def made(spark, products, runs, tmp_path_factory):
    return search.keep(products, runs, f"{tmp_path_factory.mktemp('search')}/one")


def of(df):
    return sorted((r.product_id, r.site, r.name or "", r["rank"]) for r in df.collect())


@pytest.mark.parametrize("query", QUERIES)
def test_kept_index_finds_the_same(products, made, query):
    assert of(search.search_kept(made, query)) == of(search.search(products, query))


def test_ranks(made):
    found = {r.product_id % 10: r["rank"] for r in search.search_kept(made, "krem").collect()}
    assert found == {0: 0, 1: 1, 2: 3, 7: 0, 9: 0}
    assert {r["rank"] for r in search.search_kept(made, "kren").collect()} == {4}
    assert [r["rank"] for r in search.search_kept(made, "trakr").collect()] == [5, 5, 5]


def test_beginnings_reach_the_scan(made):
    plan = search.search_kept(made, "nova krem")._jdf.queryExecution().toString()
    assert "StringStartsWith(word,nova)" in plan and "ReadSchema: struct<word:string,product_id:bigint>" in plan


def test_index_is_current_until_something_is_new(spark, products, runs, made):
    assert search.is_current(made, products, runs)
    assert not search.is_current(made, products.where("product_id < 5"), runs)
    assert not search.is_current(made, products, runs.limit(0))


def test_empty_catalogue(spark, products, runs, tmp_path):
    none = search.keep(products.limit(0), runs, f"{tmp_path}/none")
    assert of(search.search_kept(none, "krem nova")) == of(search.search_kept(none, "krem")) == []
