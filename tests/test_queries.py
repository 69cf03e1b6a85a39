"""Every query against its oracle, and what the oracles can't say."""

from __future__ import annotations

import subprocess
import sys

import pytest

from offerlens.plans import catalog

from .conftest import ROOT
from .oracle import differences

SF = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables; test_operators and test_curation have rows for what they call.
EMPTY = {"new_products", "lost_members", "price_stranger_moves"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    found = differences(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name])
    assert found == "" or (found == "no rows" and name in EMPTY)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_runs(spark, name):
    found = catalog.QUERIES[name](spark, SF)
    assert found.columns and found.count() >= 0


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q if n[2:3].isdigit()); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
