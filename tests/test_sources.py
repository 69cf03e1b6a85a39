"""Files, pages and links in; reports out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from offerlens.functions import registry
from offerlens.operators import alerts
from offerlens.sources import files, pages
from offerlens.streaming import twins


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def written(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_catalogue_file(spark, tmp_path):
    good = written(tmp_path / "a.csv", "﻿Məhsul;Link;Qiymət;Köhnə qiymət;Stok;Kod\nLorem  A;https://x.az/p/1;1 299,90;1500;var;k1\nLorem  A;https://x.az/p/1;1 299,90;1500;var;k1\nIpsum;https://x.az/p/2?v=1;5;;yoxdur;\n")
    found = files.catalogue(spark, good, "x")
    assert rows(found, "external_id", "name", "price_cents", "discount_cents", "availability", "copies") == [("k1", "Lorem A", 150000, 129990, "in_stock", 2), ("p/2?v=1", "Ipsum", 500, None, "out_of_stock", 1)]


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("name,url,price,cena price\na,https://x/1,1,2\n", "not known"),
        ("name,title,url,price\na,b,https://x/1,1\n", "two columns"),
        ("name,price\na,1\n", "not found"),
        ("name,url,price\na,https://x/1,free\n", "price can't be read"),
        ("name,url,price\na,nowhere,1\n", "address can't be read"),
        ("name,url,price\n,https://x/1,1\n", "no name or address"),
        ("name,url,price\na,https://x/1,1\na,https://x/1,2\n", "different rows"),
        (f"name,url,price\n{'a' * 501},https://x/1,1\n", "too long"),
    ],
)
def test_catalogue_files_that_are_refused(spark, tmp_path, text, said):
    with pytest.raises(files.BadFile, match=said):
        files.catalogue(spark, written(tmp_path / "a.csv", text), "x")


def test_shrunk():
    assert files.shrunk(89, 100) and not files.shrunk(90, 100) and not files.shrunk(1, 0)


def test_stock_and_costs(spark, tmp_path):
    stock = files.stock_file(spark, written(tmp_path / "s.csv", "sku,qty,name\na,\"1,5\",x\nb,none,y\nc,0,z\n"))
    assert rows(stock, "sku", "qty", "in_stock") == [("a", 1.5, True), ("b", 0.0, False), ("c", 0.0, False)]
    old = spark.createDataFrame([("z", 1.0, True, "erp"), ("y", 1.0, True, "hand")], "sku string, qty double, in_stock boolean, source string")
    assert rows(files.replaced(old, stock, "erp"), "sku", "source") == [("a", "erp"), ("b", "erp"), ("c", "erp"), ("y", "hand")]
    costs = files.supplier_prices(spark, written(tmp_path / "c.csv", "sku,supplier_name,purchase_price\na,S,10\na,S,\"12,5\"\nb,S,0\nc,S,x\n"))
    assert rows(costs, "sku", "cost_cents") == [("a", 1250)]
    now = spark.createDataFrame([("a", "S", 1000), ("d", "S", 5)], "sku string, supplier_name string, cost_cents long")
    plan = files.cost_plan(costs, now)
    assert rows(plan, "sku", "before", "after", "change") == [("a", 1000, 1250, "changed")]
    after = files.upserted_costs(now, costs)
    assert rows(after, "sku", "cost_cents") == [("a", 1250), ("d", 5)]
    assert rows(files.rolled_back(after, plan), "sku", "cost_cents") == [("a", 1000), ("d", 5)]
    with pytest.raises(ValueError):
        files.rolled_back(now, plan)
    batches = spark.createDataFrame([(1, False), (2, False), (3, True)], "batch_id int, rolled_back boolean")
    files.last_batch(batches, 2)
    with pytest.raises(ValueError):
        files.last_batch(batches, 1)
    raw = spark.createDataFrame([(1, "a", "S", "1"), (2, "a", "S", "2"), (3, "", "S", "1"), (4, "b", "S", "x"), (5, "c", "S", "0"), (6, "d", "S", "3")], "line int, sku string, supplier_name string, purchase_price string")
    assert rows(files.cost_faults(raw), "line", "fault") == [(1, "comes twice"), (2, "comes twice"), (3, "no sku"), (4, "price can't be read"), (5, "price is not above zero")]


def test_skus_are_bound_by_id_then_name(spark):
    products = spark.createDataFrame([(1, "own", "k1", "Lorem forte 20"), (2, "own", "k2", "Ipsum extra gel"), (3, "rival", "k3", "Ipsum extra gel")], "product_id long, site string, external_id string, name string")
    wanted = spark.createDataFrame([("k1", "anything"), ("q", "Ipsum gel extra"), ("r", "Dolor")], "sku string, name string")
    assert rows(files.bound_skus(wanted, products, "own"), "sku", "product_id", "how") == [("k1", 1, "id"), ("q", 2, "name")]


LD = '<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "Lorem", "gtin13": "4 000-00012345 6", "offers": {"price": "12.50", "availability": "https://schema.org/InStock"}}, {"@type": "Other"}]}</script>'


def test_pages(spark):
    two = LD + LD
    df = spark.createDataFrame([(1, LD), (2, two), (3, "<p>none</p>"), (4, None)], "page_id int, html string")
    found = {r.page_id: r.p for r in df.select("page_id", pages.ld_product(F.col("html")).alias("p")).collect()}
    assert tuple(found[1]) == ("Lorem", 1250, "4000000123456", True) and found[2] is None and found[3] is None
    marked = spark.createDataFrame([('<a data-price="1">',), ("x" * 30_000 + "data-price",), (None,)], "html string")
    assert [r[0] for r in marked.select(pages.looks_like_product(F.col("html"))).collect()] == [True, False, False]
    shop = '<ul><li class="product-card a"><a href="/p-1"><b class="name">Lorem</b></a><i class="price">1 200,50</i></li><li class="product-card out-of-stock"><a href="/p-2"><b class="name">Ipsum</b></a><i class="price">5</i></li></ul>'
    got = pages.cards(spark.createDataFrame([(1, shop), (2, "")], "page_id int, html string"))
    assert rows(got, "name", "url", "price_cents", "in_stock") == [("Ipsum", "/p-2", 500, False), ("Lorem", "/p-1", 120050, True)]
    body = '{"items": [{"id": 7, "title": "Lorem", "price": {"now": "3"}}, {"id": 8}]}'
    listed = pages.listed(spark.createDataFrame([(1, body)], "page_id int, body string"), {"external_id": "$.id", "name": "$.title", "price": "$.price.now"})
    assert rows(listed, "external_id", "name", "price") == [("7", "Lorem", "3"), ("8", None, None)]
    assert spark.createDataFrame([("<b>a</b>&nbsp;&amp; <script>x</script>b",)], "h string").select(pages.clean_text(F.col("h"))).first()[0] == "a & b"


def test_turbo_stream(spark):
    flat = '[{"_1": 2, "_3": 4}, "name", "Lorem", "tags", [2, 5, -1], 7]\nlater'
    out = [r[0] for r in spark.createDataFrame([(flat,), ("no json",), (None,)], "t string").select(pages.turbo_stream("t")).collect()]
    assert out == ['{"name": "Lorem", "tags": ["Lorem", 7, null]}', None, None]


def test_links_and_sitemaps(spark):
    lines = spark.createDataFrame(enumerate(["https://one.az/products?category=a-b", "https://two.az/cat/u%C5%9Faq/", "https://one.az/products?category=c", "what", " "]), "at int, line string")
    found = pages.category_links(lines, {"one": r"one\.az/products\?category=([^&#]+)", "two": r"two\.az/cat/([^?#]+)"})
    assert rows(found, "site", "slug") == sorted([("one", "c"), ("two", "uşaq"), (None, "what")], key=repr)
    maps = spark.createDataFrame([("<loc>u1</loc><loc> u2 </loc>",), ("<loc>u1</loc>",)], "body string")
    urls = pages.sitemap(maps)
    assert rows(urls, "url") == [("u1",), ("u2",)]
    with pytest.raises(ValueError):
        pages.sitemap(maps, most=1)
    assert tuple(pages.witnessed(urls, spark.createDataFrame([("u1",)], "url string"), most_missing=0).first()) == (2, 1, False)
    assert tuple(pages.witnessed(urls, urls).first()) == (2, 0, True)
    made = spark.createDataFrame([("https://www.X.az/a-b-12/?q=1",), ("http://x.az/a",)], "u string")
    assert rows(made, pages.slug_number(F.col("u")), pages.canonical_url(F.col("u"))) == [(12, "x.az/a-b-12"), (None, "x.az/a")]


def test_pushes_demo_and_reports(spark, tmp_path):
    body = '{"rows": [{"sku": "a", "qty": "1,5", "supplier_name": "S", "purchase_price": "10"}, {"qty": "3"}]}'
    batch = spark.createDataFrame([(body,)], "body string")
    assert rows(pages.pushed(batch, "stock"), "sku", "qty") == [("a", 1.5)] and rows(pages.pushed(batch, "prices"), "sku", "cost_cents") == [("a", 1000)]
    demo = pages.demo(spark)
    assert demo.count() == 2 * (40 * 3 - 10) and demo.where("discount_cents is not null").count() == 4 * 3 - 2
    listed = files.watchlist(spark, written(tmp_path / "w.csv", "name,one,two\nLorem,u1,\nIpsum,u2,u3\n"), ("one", "two"))
    assert rows(listed, "name", "site", "url") == [("Ipsum", "one", "u2"), ("Ipsum", "two", "u3"), ("Lorem", "one", "u1")]
    files.write_watchlist(listed, ("one", "two"), str(tmp_path / "wl"))
    assert rows(files.watchlist(spark, str(tmp_path / "wl"), ("one", "two")), "name", "url") == rows(listed, "name", "url")
    sheet = spark.createDataFrame([("=cmd", 1), ("ok", 2)], "name string, n int")
    files.run_report(sheet, sheet, sheet, sheet, str(tmp_path / "report"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "report/new")), "name") == [("'=cmd",), ("ok",)]
    assert "<td>&lt;b&gt;</td>" in files.as_html(spark.createDataFrame([("<b>",)], "x string"))


def test_registry(spark):
    registry.register(spark)
    assert spark.sql("select likeness('abcd', 'abxd')").first()[0] == 75.0
    with pytest.raises(ValueError):
        registry.detector("new_product")(lambda obs, run: obs)

    @registry.detector("test_only")
    def found(obs, run):
        return obs.select(F.lit("test_only").alias("rule_type"), F.lit("k").alias("dedup_key"), F.lit("info").alias("severity"), F.lit("s").alias("site"), F.lit(1).cast("long").alias("subject"), F.lit(5).cast("long").alias("size_bp"))

    try:
        assert rows(alerts.candidates(spark.range(1), 1, ("test_only",)), "rule_type", "size_bp") == [("test_only", 5)]
    finally:
        del alerts.DETECTORS["test_only"]


def stream_of(spark, folder, batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return twins.stream(spark, f"{folder}/*", schema)


def test_streamed_persistence_and_scopes(spark, tmp_path):
    schema = "product_id long, seq long, price long, scope string"
    made = [[(1, 1, 10, "full"), (1, 2, 10, "full"), (2, 1, 5, "partial")], [(1, 3, 10, "full"), (1, 4, 11, "partial"), (2, 2, 5, "full")]]
    s = stream_of(spark, tmp_path / "in", made, schema)
    twins.persist(s, str(tmp_path / "out"), str(tmp_path / "cp"), ("price",)).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "product_id", "seq", "price") == [(1, 1, 10), (1, 4, 11), (2, 1, 5)]
    twins.split_by_scope(s, str(tmp_path / "split"), str(tmp_path / "cp2")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "split/partial")), "product_id", "seq") == [(1, 4), (2, 1)]


def test_streamed_countries_agree_with_the_batch(spark, tmp_path):
    from offerlens.operators.intake import countries
    from offerlens.plans.intake import SEEN

    schema = "product_id long, seq long, run_id long, code string"
    s = stream_of(spark, tmp_path / "in", [SEEN], schema)
    q = twins.countries(s).writeStream.outputMode("update").format("memory").queryName("countries_test").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("countries_test"), "product_id", "code", "status") == rows(countries(spark.createDataFrame(SEEN, schema)), "product_id", "code", "status")
