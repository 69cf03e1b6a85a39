"""Identities, rotation, whole runs, kept lists, streams of pages and workbooks, on rows made for their rules."""

from __future__ import annotations

import json
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerlens.operators import analysis, identity, rotation, taxonomy
from offerlens.sources import files, flight, workbooks

STATE = "product_id long, site string, slug string, number long, retired boolean, isolated boolean, matched boolean, last_seen_at timestamp_ntz, into long"
DAY = datetime(2020, 1, 1)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_identities_are_adopted_retired_and_isolated(spark):
    made = [
        (1, "s", "a", None, False, False, False, DAY, None), (2, "s", "x", 10, False, False, False, DAY, None),  # the number's own row wins
        (3, "s", "b", None, False, False, True, DAY, None), (4, "s", "b", None, False, False, False, DAY + timedelta(1), None),  # the matched one wins
        (5, "s", "c", None, False, False, False, DAY, None), (6, "s", "c", None, False, False, False, DAY + timedelta(1), None),  # the last seen wins
        (7, "s", "d", None, False, False, False, DAY, None),  # two numbers
        (8, "s", "e", None, False, False, False, DAY, None), (9, "s", "f", None, False, False, False, DAY, None),  # one number for two
        (10, "s", "g", 99, False, False, False, DAY, None), (11, "s", "g", None, True, False, False, DAY, 3), (12, "t", "a", None, False, False, False, DAY, None),
    ]
    seen = [("s", "a", 10), ("s", "b", 20), ("s", "c", 30), ("s", "d", 40), ("s", "d", 41), ("s", "e", 50), ("s", "f", 50), ("s", "g", 60), ("s", None, 70), ("s", "h", 80)]
    state = spark.createDataFrame(made, STATE)
    observed = spark.createDataFrame(seen, "site string, slug string, number long")
    assert rows(identity.disputed(observed), "slug", "number", "fault") == [("d", 40, "several_numbers"), ("d", 41, "several_numbers"), ("e", 50, "several_addresses"), ("f", 50, "several_addresses")]
    ledger = identity.proposals(state, observed, 1).cache()
    assert rows(ledger, "product_id", "kind", "after", "into") == sorted([(1, "retire", None, 2), (3, "adopt", 20, None), (4, "retire", None, 3), (5, "retire", None, 6), (6, "adopt", 30, None), (7, "isolate", None, None), (8, "isolate", None, None), (9, "isolate", None, None), (10, "isolate", 99, None)], key=repr)
    after = identity.replayed(state, ledger).cache()
    assert identity.proposals(after, observed, 2).count() == 0 and identity.ledger_faults(state, ledger).count() == 0
    # A later pass with one number for the address ends the isolation.
    later = identity.proposals(after, spark.createDataFrame([("s", "d", 41)], observed.schema), 2)
    assert rows(later, "product_id", "kind", "after") == [(7, "adopt", 41)]
    both = ledger.unionByName(later)
    assert rows(identity.replayed(state, both).where("product_id = 7"), "number", "isolated") == [(41, False)]
    assert rows(identity.replayed(state, both), *state.columns) == rows(identity.replayed(after, later), *state.columns)


def test_faults_of_a_ledger(spark):
    state = spark.createDataFrame([(i, "s", f"x{i}", None, False, False, False, DAY, None) for i in range(1, 6)], STATE)
    entries = [(1, "s", 1, "adopt", None, 7, None), (1, "s", 2, "adopt", None, 7, None), (1, "s", 3, "adopt", 5, 8, None), (1, "s", 4, "retire", None, None, 1), (2, "s", 4, "adopt", None, 9, None), (1, "s", 99, "adopt", None, 1, None), (1, "s", 5, "adopt", None, 3, None), (1, "s", 5, "isolate", None, 3, None)]
    ledger = spark.createDataFrame(entries, "seq long, site string, product_id long, kind string, before long, after long, into long")
    assert {(1, "number twice"), (2, "number twice"), (3, "does not follow"), (4, "after retirement"), (99, "no such row"), (5, "two entries of one pass")} <= set(rows(identity.ledger_faults(state, ledger), "product_id", "fault"))


def test_chains_of_retirement_end_at_a_live_row(spark):
    made = [(i, "s", "x", None, i < 6, False, False, DAY, i + 1 if i < 6 else None) for i in range(1, 7)] + [(9, "s", "y", None, True, False, False, DAY, 8), (8, "s", "y", None, False, False, False, DAY, None)]
    assert rows(identity.final_rows(spark.createDataFrame(made, STATE)), "product_id", "final") == [(1, 6), (2, 6), (3, 6), (4, 6), (5, 6), (9, 8)]


def test_turns_pass_only_when_taken(spark):
    rng = random.Random(1)
    ticks = [(k, i, f"s{rng.randrange(2)}", DAY + timedelta(minutes=rng.randrange(600))) for k in range(4) for i in range(40)]
    want = []
    for key in range(4):
        turn, held = 0, {}
        for k, i, site, at in sorted((t for t in ticks if t[0] == key), key=lambda t: (t[3], t[1])):
            free = site not in held or (at - held[site]).total_seconds() >= 3600
            want.append((k, i, turn % 3, free))
            if free:
                held[site], turn = at, turn + 1
    df = spark.createDataFrame(ticks, "key long, seq long, site string, at timestamp_ntz").repartition(5)
    assert rows(rotation.rotated(df, 3, 3600), "key", "seq", "turn", "taken") == sorted(want, key=repr)


def test_due_sites(spark):
    sites = spark.createDataFrame([(s, 24, DAY) for s in "abcdef"], "site string, hours long, anchor timestamp_ntz")
    at = lambda h: DAY + timedelta(hours=h)
    tries = [("a", at(49), at(50), "ok", True), ("b", at(47), at(50), "ok", True), ("c", at(49), at(50), "failed", False), ("d", at(49), None, "degraded", True), ("e", at(49), at(50), "degraded", False), ("a", at(80), at(81), "failed", False)]
    attempts = spark.createDataFrame(tries, "site string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, eligible boolean")
    assert rows(rotation.due_sites(sites, attempts, str(at(60))), "site", "due", "hours") == [("a", False, 10.0), ("b", True, None), ("c", True, None), ("d", False, 11.0), ("e", True, None), ("f", True, None)]


def test_a_first_run_has_no_changes(spark):
    made = [(1, 1, "me", "x", 100, True, 5, 1), (2, 1, "you", "x", 90, False, 5, 1), (3, 2, "you", "y", 10, True, 5, 1), (4, 2, "me", "y", 200, False, 5, 1)]
    obs = spark.createDataFrame(made, "product_id long, match_id long, site string, category string, eff long, on_promo boolean, run_id long, seq long")
    found, counts = analysis.analyse(obs, 5, None, "me")
    assert set(found) == {"undercuts"} and rows(counts, "what", "n") == [("products", 4), ("promotions", 2), ("undercuts", 1)]
    later = obs.union(spark.createDataFrame([(1, 1, "me", "x", 80, False, 6, 2), (9, 9, "you", "z", 5, True, 6, 2)], obs.schema))
    found, counts = analysis.analyse(later, 6, 5, "me")
    assert rows(found["price_changes"], "product_id", "previous", "eff") == [(1, 100, 80)] and rows(found["new_products"], "product_id") == [(9,)]
    assert rows(found["promo_changes"], "site", "category", "change") == [("me", "x", "ended"), ("you", "y", "ended"), ("you", "z", "started")]
    assert rows(counts, "what", "n") == [("new_products", 1), ("price_changes", 1), ("products", 2), ("promo_changes", 3), ("undercuts", 0)]


def test_kept_lists_are_superseded_whole(spark, tmp_path):
    folder = str(tmp_path / "kept")
    items = spark.createDataFrame([(1, "a"), (2, "b")], "place long, payload string")
    read = lambda: spark.read.schema(analysis.PUBLISHED).parquet(folder)
    now = lambda e="e", f="f", at="2020-01-01 05:00:00": rows(analysis.current_items(read(), 1, "me", e, f, at, 24), "payload")
    with pytest.raises(ValueError):
        analysis.publish(items, folder, 1, "me", None, "f", 1, 1, "2020-01-01 00:00:00")
    analysis.publish(items, folder, 1, "me", "e", "f", 1, 1, "2020-01-01 00:00:00")
    assert now() == [("a",), ("b",)] and now("other") == now(f="g") == now(at="2020-01-02 00:00:01") == now(None) == []
    # A list of which rows are missing is not taken.
    read().limit(1).withColumn("seq", F.lit(2).cast("long")).write.mode("append").partitionBy("tenant_id", "client_site").parquet(folder)
    assert now() == [("a",), ("b",)]
    analysis.publish(items.where("place = 2"), folder, 1, "me", "e", "f", 2, 3, "2020-01-01 01:00:00")
    analysis.publish(items, folder, 1, "you", "e", "f", 2, 4, "2020-01-01 01:00:00")
    assert now() == [("b",)]
    assert rows(analysis.publications(read()).where("client_site = 'me'"), "seq", "state") == [(1, "superseded"), (2, "incomplete"), (3, "current")]
    analysis.publish(items.limit(0), folder, 1, "me", "e", "f", 2, 5, "2020-01-01 01:00:00")
    assert now() == [] and rows(analysis.publications(read()).where("seq = 5"), "state") == [("current",)]


def push(text: str) -> str:
    return f"<script>self.__next_f.push([1,{json.dumps(text)}])</script>"


def test_streams_of_pages(spark):
    inner = json.dumps({"@graph": [{"@type": "Product", "sku": "z", "name": "Inner", "offers": {"price": "3,50", "availability": "https://schema.org/InStock"}, "gtin13": "1234567890123"}]})
    texts = {
        "split": push('1:{"list":[{"id":1,"name":"A \\u0259","price":5,"old_pr') + push('ice":6.5,"quantity":"0","brand":"$a"}, "$b", "$c"]}\na:{"name":"Nova"}\nb:{"id":2,"name":"B","price":"1 200.00"}\nc:"$c"\nd:broken {\n'),
        "html": push('5:["$","div",null,{"dangerouslySetInnerHTML":{"__html":' + json.dumps(inner) + "}}]\n"),
        "twice": push('1:{"id":1,"name":"A","price":5}\n2:{"x":"$1","y":{"id":1,"name":"A","price":5}}\n'),
        "none": "<html>nothing</html>", "bad": '<script>self.__next_f.push([1,"unended', "page": push('1:{"currentPage":2,"lastPage":3,"list":[]}'), "null": None,
    }
    pages = spark.createDataFrame([(k, v) for k, v in texts.items()], "page string, html string")
    found = rows(flight.flight_products(pages).where("external_id is not null"), "page", "external_id", "name", "brand", "price_cents", "discount_cents", "gtin", "in_stock")
    assert found == sorted([("split", "1", "A ə", "Nova", 650, 500, None, False), ("split", "2", "B", None, 120000, None, None, None), ("html", "z", "Inner", None, 350, None, "1234567890123", True), ("twice", "1", "A", None, 500, None, None, None)], key=repr)
    assert rows(flight.flight_products(pages).where("current_page = 2"), "page", "last_page") == [("page", 3)]


def test_workbooks_there_and_back(spark, tmp_path):
    made = [(1, "=1+1", 2.5, True, None), (2, 'a & <b> "c"\n\x01d', -3.0, False, "  x "), (3, None, None, None, "ə🙂"), (2**60, "-x", 1e300, True, "")]
    df = spark.createDataFrame(made, "id long, name string, price double, ok boolean, note string").repartition(3)
    workbooks.write_workbooks({"s": df, "none": df.limit(0)}, str(tmp_path))
    back = workbooks.read_workbook(spark, f"{tmp_path}/s/*.xlsx")
    assert rows(back, *back.columns) == sorted([("1", "'=1+1", "2.5", "1", None), ("2", 'a & <b> "c"\nd', "-3.0", "0", "  x "), ("3", None, None, None, "ə🙂"), (str(2**60), "'-x", "1e+300", "1", "")], key=repr)
    workbooks.write_workbooks({"s": df.where("id = 1")}, str(tmp_path))
    assert workbooks.read_workbook(spark, f"{tmp_path}/s/*.xlsx").count() == 1
    empty = workbooks.read_workbook(spark, f"{tmp_path}/none/*.xlsx")
    assert empty.columns == df.columns and empty.count() == 0


def test_a_workbook_as_catalogue(spark, tmp_path):
    """Shared strings, places left out, several sheets."""
    head = '<?xml version="1.0"?>'
    main = workbooks.MAIN[1:-1]
    def book(path, sheets):
        with zipfile.ZipFile(path, "w") as z:
            workbooks.write_parts(z, "one")
            z.writestr("xl/sharedStrings.xml", f'{head}<sst xmlns="{main}"><si><t>Name</t></si><si><r><t>U</t></r><r><t>RL</t></r></si><si><t>Qiymət</t></si></sst>')
            body = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>Krem</t></is></c><c r="B3" t="str"><v>https://x.az/p/1</v></c><c r="D3"><v>12.5</v></c></row>'
            for i in range(1, sheets + 1):
                z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        return str(path)
    one = book(tmp_path / "one.xlsx", 1)
    assert rows(files.catalogue(spark, one, "x"), "name", "url", "price_cents") == [("Krem", "https://x.az/p/1", 1250)]
    assert workbooks.workbook_rows(spark, one).count() == 2
    with pytest.raises(ValueError):
        workbooks.read_workbook(spark, one, "other")


def test_circles_of_rules_of_any_length(spark):
    over = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f"), ("f", "g"), ("h", "h")], "id string, other string")
    assert rows(taxonomy.in_circles(over), "id") == [("a",), ("b",), ("c",), ("h",)]
