"""What must not grow with the tables: how often they are read, what is carried through shuffles, and where rows meet."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from offerlens.operators import analytics, catalogue_search, digest, electronics, ingest, lineage, marketplace, prices
from offerlens.plans import catalogue, state
from offerlens.sources import adapter, workbooks

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_latest_observations_meet_their_parts_last(spark):
    """a line a product is joined, not every line, with the same rows."""
    last = adapter.latest_observations(spark, DATA)
    assert plan(last).index("Join") < plan(last).index("Aggregate")
    every = prices.latest(adapter.observations(spark, DATA)).select(last.columns)
    assert last.exceptAll(every).isEmpty() and every.exceptAll(last).isEmpty()


def test_runs_come_to_the_journal(spark):
    """observations are not shuffled by their few runs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = spark.range(3).groupBy("id").count().select("id")
        found = lineage.confirmed_journal(adapter.observations(spark, DATA), runs)
        assert "BroadcastHashJoin [run_id" in found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_search_reads_its_products_once(spark):
    """hits come from what was written once."""
    made = spark.createDataFrame([(1, "a", "red bolt", "x"), (2, "b", "gear", None), (3, "b", "blue", "bolt")], "product_id long, site string, name string, brand string")
    for text, want in (("bolt", {1: 1, 3: 3}), ("bult", {1: 4, 3: 4}), ("", {})):
        found = catalogue_search.search(made, text)
        assert {r.product_id: r.rank for r in found.collect()} == want
        assert not want or all("offerlens-core-" in f for f in found.inputFiles())


def test_a_search_with_clusters_reads_its_products_once(spark):
    """only the clusters' own names are read beside what was written."""
    found = catalogue.search_with_clusters(spark, DATA).inputFiles()
    assert found and not any("lineitem" in f for f in found)


def test_events_are_counted_before_they_meet_users(spark):
    """F16: what meets the users is a count a tenant and severity."""
    log = spark.createDataFrame([(1, "critical", None), (1, "critical", []), (1, "info", None), (1, "critical", ["email"]), (2, None, None)], "tenant_id long, severity string, channels_sent array<string>")
    users = spark.createDataFrame([(7, 1, True, False, "info", "critical", "c", None), (8, 2, True, False, "info", "info", None, None)], "user_id long, tenant_id long, is_active boolean, daily_digest boolean, email_min string, chat_min string, chat_id string, quiet_hours string")
    found = digest.routed(log, users, adapter.NOW)
    assert sorted((r.user_id, r.channel, r.events, r.critical) for r in found.collect() if r.user_id == 7) == [(7, "chat", 2, 2), (7, "email", 3, 2)]
    assert plan(found).index("Join") < plan(found).rindex("Aggregate")


def test_subtotals_are_of_products(spark):
    """observations are counted by product before rows are repeated for subtotals."""
    obs = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("a", "y", 1), ("b", None, 2), ("b", "x", None)], "site string, category string, product_id long")
    found = analytics.rollup_counts(obs)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted([("a", "x", 2, 1), ("a", "y", 1, 1), ("b", None, 1, 1), ("b", "x", 1, 0), ("a", None, 3, 1), ("b", None, 2, 1), (None, None, 5, 2)], key=key)
    assert plan(found).rindex("Aggregate") > plan(found).index("Expand")


def test_passes_are_made_of_the_stored_state(spark, monkeypatch):
    """products are worked out once, for the state and for what is seen."""
    read, kept = [], state.stored
    monkeypatch.setattr(state, "stored", lambda df: read.append(df.inputFiles()) or kept(df))
    state.numbered(spark, DATA)
    assert len([files for files in read if any("lineitem" in f for f in files)]) == 1


def test_signatures_split_a_name_once(spark):
    """no word of a name works its folded text out anew."""
    made = spark.createDataFrame([("Samsun SM-A155F/128 6/128 GB Black",), ("Boss",)], "name string").select(electronics.signature(F.col("name")).alias("s"))
    assert plan(made).count("split(") == 1 and plan(made).count("lower(") == 1
    s = made.collect()[0].s
    assert (s.brand, s.code, s.ram, s.storage, s.colours) == ("samsun", "sm", "6", "128", ["black"])


def test_rows_of_a_workbook_come_in_batches():
    """a task never holds all rows of a workbook."""
    import pyarrow as pa

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        workbooks.write_parts(z, "one")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{workbooks.MAIN[1:-1]}"><sheetData>{"".join(workbooks.line(n, [n, "x"]) for n in range(1, 2502))}</sheetData></worksheet>')
    got = list(workbooks.batches_of(iter([pa.RecordBatch.from_pydict({"path": ["p"], "content": [made.getvalue()]})])))
    assert [b.num_rows for b in got] == [1000, 1000, 501]
    assert [n for b in got for n in b["row_number"].to_pylist()] == list(range(1, 2502)) and got[2]["cells"].to_pylist()[-1] == ["2501", "x"]


def test_names_of_venues_are_read_once_each(spark, monkeypatch):
    """features are worked out of distinct names, however many venues spell one alike."""
    read, kept = [], marketplace.stored
    monkeypatch.setattr(marketplace, "stored", lambda df: read.append(kept(df)) or read[-1])
    made = spark.createDataFrame([("a", "1", "Loremol 500 mq N20"), ("b", "2", "Loremol 500 mq N20"), ("c", "3", "Loremol 500mq N20"), ("a", "4", "Ipsum krem 20 q"), ("b", "5", "Ipsum krem 20 q"), ("c", "6", "Ipsum gel 20 q")], "venue string, item_id string, name string")
    assert sorted(r.item_id for r in marketplace.groups(made).collect()) == ["1", "2", "3"]
    assert read and read[0].count() == 4
    assert sorted(r.item_id for r in marketplace.groups(made, ("c",)).collect()) == ["1", "2", "3", "4", "5"]


def test_merged_rows_carry_one_order(spark):
    """rows are dealt by product before their newest values are taken, each of which has an order of its own."""
    found = ingest.merged(adapter.observations(spark, DATA))
    assert plan(found).index("Aggregate") < plan(found).index("RepartitionByExpression")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(product_id") == 1
