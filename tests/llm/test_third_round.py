"""Fill-in-the-middle, license scans and centroid clustering against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import fill_middle, license_scan, queries
from offerlens.llm.clustering import centroids_of, cluster_vectors, search
from offerlens.llm.fill_middle import checked, fill_in_middle, restore_middle
from offerlens.llm.license_scan import TEMPLATES, Template, matching_blocks, scan_licenses
from tests.oracle import differences

from . import brute
from .test_contracts import rows_of, texts_of

SF = "/root/testdata/sf0.001"
SHORT = (Template("x", "one two three four five six"), Template("y", "Two three THREE seven eight"), Template("z", "rare"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    assert differences(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("block, stretch", [(1 << 20, 4 << 20), (7, 50)])
def test_fill_in_middle(spark, docs, monkeypatch, block, stretch):
    """Also where texts are moved in several blocks, and alone."""
    for at, n in (("BLOCK", block), ("STRETCH", stretch)):
        monkeypatch.setattr(fill_middle, at, n)
    if block < 10 and docs.count() > 100:
        docs = docs.limit(20)
    digest = lambda c: F.sha2(F.col(c), 256).alias(c)
    moved = restore_middle(fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
    assert rows_of(moved, *moved.columns) == sorted(brute.fill_in_middle(texts_of(docs)), key=repr)


def test_forms_by_rate_and_share(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc") for i in range(400)], "doc_id long, text string")
    some = {r["form"]: r["count"] for r in fill_in_middle(docs, rate=50, spm=100).groupBy("form").count().collect()}
    assert set(some) == {"plain", "spm"} and 120 < some["plain"] < 280
    assert {r.form for r in fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle(docs, spm=0).collect()} == {"psm"}


def test_texts_with_marks_stay_plain(spark):
    texts = ["x\n<P>", "<S>\ny", "a<M>b\n", "<P", "p>\n<", "<\nS>\n", "é<\n<é\nP>"]
    moved = restore_middle(fill_in_middle(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    found = {r.doc_id: r for r in moved.collect()}
    assert [found[i].form for i in range(3)] == ["plain"] * 3 and all(found[i].form != "plain" for i in range(3, 7))
    assert [found[i].restored for i in range(7)] == texts


def test_outputs_that_are_not_ours(spark):
    """Without the marks that the form asks for there is nothing to restore; columns beside them stay."""
    rows = [(1, "psm", "<P>a<S>c<M>b"), (2, "psm", "no marks"), (3, "spm", "<P>a<S>c<M>b"), (4, None, "plain"), (5, "psm", None), (6, "spm", ""), (7, "psm", "<P>a<M>b")]
    found = restore_middle(spark.createDataFrame(rows, "restored_ long, form string, output string"))
    assert [r.restored for r in found.orderBy("restored_").collect()] == ["abc", None, None, "plain", None, None, None]


def test_marks_that_overlap_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "x"), ("", "b", "c"), ("a<M>", "<M>", "c")):
        with pytest.raises(ValueError):
            checked(marks)
    assert len(checked(("<fim_prefix>", "<fim_suffix>", "<fim_middle>"))) == 3


def test_license_scan(docs):
    templates = [(t.label, t.words) for t in TEMPLATES]
    found = scan_licenses(docs)
    assert rows_of(found, *found.columns) == sorted(brute.licenses(texts_of(docs), templates, 0.8), key=repr)


def license_rows() -> list[tuple]:
    rng = random.Random(3)
    words = "one two three four five six seven eight rare the of and 0 é".split()
    texts = [" ".join(rng.choice(words[: rng.choice((9, 11, 14))]) for _ in range(rng.choice((0, 1, 5, 12, 40, 300)))) for _ in range(150)]
    texts += [t.text for t in TEMPLATES] + ["\n * ".join(t.text.upper().split()) for t in TEMPLATES] + ["mit license " * 400, None, "MIT-License; Apache_License\nGNU GENERAL PUBLIC\x00LICENSE", "mit licenses, mit_\x7flicense, émit license", "İMIT LICENSE"]
    for t in TEMPLATES:  # with some words left out, changed and put between
        w = t.text.split()
        for lost in (1, 2, 4):
            cut = [x for i, x in enumerate(w) if i not in rng.sample(range(len(w)), min(lost, len(w) - 1))]
            texts.append("lead " * rng.randrange(60) + " ".join(x + rng.choice(["", "", " so"]) for x in cut))
    return [(i % 100, t) for i, t in enumerate(texts)] + [(None, TEMPLATES[0].text)] * 2


def test_license_scan_of_awkward_notices(spark):
    rows = license_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = scan_licenses(docs)
    assert rows_of(found, *found.columns) == sorted(brute.licenses(rows, [(t.label, t.words) for t in TEMPLATES], 0.8), key=repr)


@pytest.mark.parametrize("threshold", [0.01, 0.5, 0.8, 1.0])
def test_every_block_that_meets_a_template(spark, threshold):
    """Small templates of common words: every block, in many stretches, at every threshold."""
    rows = license_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.license_blocks(rows, [(t.label, t.words) for t in SHORT], threshold)
    assert want and rows_of(matching_blocks(docs, SHORT, threshold), "doc_id", "template", "first_word", "containment") == sorted(want, key=repr)


def test_license_scan_is_native(spark, documents):
    plan = scan_licenses(documents)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_templates_are_checked(spark, documents, monkeypatch):
    with pytest.raises(ValueError):
        scan_licenses(documents, templates=(Template("empty", "--"),))
    monkeypatch.setattr(license_scan, "MOST_WORDS", 10)
    with pytest.raises(ValueError):
        scan_licenses(documents)


VECTORS = "vec_id long, embedding array<double>, cluster string, v int"


def vector_rows(n: int, width: int, seed: int = 4) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [round(x + rng.gauss(0, 0.2), 2) for x in rng.choice(centres)], "clash", 1) for i in range(n)]
    rows += rows[:5] + [(n + i, rows[0][1], None, None) for i in range(5)] + [(1, rows[min(7, n - 1)][1], None, None)]
    rows += [(900, None, None, None), (901, [], None, None), (902, [0.0] * width, None, None), (903, [1.0] * (width + 1), None, None), (None, rows[3][1], None, None), (None, rows[4][1], None, None)]
    return rows + [(904 + i, [bad] + [0.5] * (width - 1), None, None) for i, bad in enumerate((None, math.nan, math.inf, -math.inf))]


@pytest.mark.parametrize("n, k, width", [(120, 7, 4), (3, 40, 2), (60, 1, 3)])
def test_clustering(spark, n, k, width):
    """With ties, repeated rows, null ids, vectors that take no part, and fewer vectors than centroids."""
    rows = vector_rows(n, width)
    found = cluster_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), clusters=k, rounds=3, width=width)
    assert rows_of(found, *found.columns) == sorted(brute.clusters([r[:2] for r in rows], k, 3, width), key=repr)


def test_clustering_of_no_vectors(spark):
    for rows in ([], [(1, None, None, None)]):
        found = cluster_vectors(spark.createDataFrame(rows, VECTORS))
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and found.count() == 0


def test_sums_beyond_a_long_are_null(spark):
    rows = [(i, [500_000.0 * (-1) ** i] * 64) for i in range(10)]
    found = cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), clusters=1, rounds=0).collect()
    far = max(r.distance for r in found)
    assert far == 64 * 256_000_000**2 and {(r.cluster_inertia, r.inertia) for r in found} == {(None, None)}


def test_components_too_large_are_refused(spark):
    with pytest.raises(Exception, match="524288"):
        cluster_vectors(spark.createDataFrame([(1, [600_000.0] * 64)], "vec_id long, embedding array<double>"))


def test_search_is_exact_and_saves_distances():
    """Ties go to the smaller number from any start, equal centroids included; clustered vectors need few distances."""
    rng = np.random.default_rng(1)
    c = rng.integers(-3, 4, (30, 2))
    x = rng.integers(-4, 5, (500, 2))
    every = ((x[:, None] - c) ** 2).sum(axis=2)
    for start in (0, 13, 29):
        at, d, _ = search(x, centroids_of(c), start)
        assert (at == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    far = rng.integers(-(10**6), 10**6, (40, 64))
    near = np.repeat(far, 20, axis=0) + rng.integers(-1000, 1000, (800, 64))
    at, _, measured = search(near, centroids_of(far))
    assert (at == np.repeat(np.arange(40), 20)).all() and measured < 0.75 * 800 * 40
