"""The corpus pipeline, stage by stage, each against a plain version on what the stage before it kept."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest

from offerlens.llm.byte_bpe import byte_bpe

from . import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(spark, name: str, rows: list[tuple]) -> list[tuple]:
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


def without_passages(rows: list[tuple], length: int = 100) -> list[tuple]:
    """Passages of so many bytes that started before go, but for characters that are cut."""
    first: dict[bytes, tuple] = {}
    for doc_id, text, *_ in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            here = (brute.at(doc_id), i)
            first[b[i : i + length]] = min(first.get(b[i : i + length], here), here)
    out = []
    for doc_id, text, lang, source, _ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (brute.at(doc_id), i):
                gone[i : i + length] = b"\1" * length
        kept, at = [], 0
        for c in (text or ""):
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((doc_id, "".join(kept), lang, source, len(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def documents_rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(COLUMNS).collect()]


def test_stages(spark, documents_rows):
    rows = documents_rows
    kept = {d for d, *_, ok in brute.quality_rules([r[:2] for r in rows]) if ok}
    first = stage(spark, "quality_rules", rows)
    assert first == sorted((r for r in rows if r[0] in kept), key=repr) and first

    stay = {d for d, _, c in brute.near_duplicates([r[:2] for r in first]) if d == c}
    second = stage(spark, "near_duplicates", first)
    assert second == sorted((r for r in first if r[0] in stay), key=repr) and len(second) < len(first)

    third = stage(spark, "suffix_array", second)
    assert third == without_passages(second)

    fourth = stage(spark, "mixing", third)
    assert set(fourth) <= set(third) and max(Counter(fourth).values()) <= 3
    sizes: Counter = Counter()
    taken: Counter = Counter()
    for rows_in, total in ((third, sizes), (fourth, taken)):
        for r in rows_in:
            total[r[3]] += len(brute.words(r[1]))
    documents = Counter(r[3] for r in third)
    longest = {s: max(len(brute.words(r[1])) for r in third if r[3] == s) for s in documents}
    for s, t in brute.targets(sizes).items():
        assert abs(taken[s] - t) <= (longest[s] / 2 + 1 if documents[s] < 40 else t / 100), (s, t, taken[s], documents[s], longest[s])


def test_run_ends_with_the_encoding_of_what_stays(spark, documents_rows):
    rows = documents_rows
    for name, _ in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, name, rows)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    want = byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert Counter(map(tuple, want.collect())) == Counter(map(tuple, corpus_pipeline.run(spark, SF).collect()))


#: Names that the stages and their operators use inside, among the extra columns.
EXTRA = ("row_key", "mix", "mix_", "copies", "copy", "times", "id", "k", "row", "kept", "n_words", "in_text", "component_id")


def awkward_rows() -> list[tuple]:
    rng = random.Random(3)
    prose = lambda n: " ".join(f"{rng.choice(['alpha', 'beta', 'gamma', 'delta'])}{rng.randrange(900)}" for _ in range(n))
    one, two, long = prose(60), prose(60), prose(4000)
    texts = [(None, None), (1, None), (2, ""), (3, " \n\t"), (None, one), (None, two), (4, prose(60)), (4, prose(70)), (4, prose(70)), (5, long), (6, long), (6, long), (7, "short"), (8, two), (None, prose(50)), (9, prose(80)), (9, prose(80))]
    rows = [(i, t, ["en", None][n % 2], ["a", None, "b"][n % 3], n) for n, (i, t) in enumerate(texts)]
    return rows + rows[5:8]


def plain_groups(rows: list[tuple]) -> list[tuple]:
    """Of rows whose fingerprints link, the first by (no id, id)."""
    found = {k: c for k, _, c in brute.near_duplicates([(n, r[1]) for n, r in enumerate(rows)])}
    groups: dict[int, list[tuple]] = {}
    for n, r in enumerate(rows):
        groups.setdefault(found[n], []).append(r)
    return [{r for r in g if (r[0] is None, r[0] or 0) == min((x[0] is None, x[0] or 0) for x in g)} for g in groups.values()]


def test_stages_of_awkward_rows(spark):
    """Nulls, repeated rows and ids, and clashing columns: rows are lost only to what a stage is for."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    frame = lambda rows: spark.createDataFrame([(*r, *(f"{c} {r[4]}" for c in EXTRA)) for r in rows], schema)

    def after(name: str, rows: list[tuple]) -> list[tuple]:
        found = dict(corpus_pipeline.STAGES)[name](spark, frame(rows), SF)
        assert found.columns == [*COLUMNS, *EXTRA]
        got = [tuple(r) for r in found.collect()]
        if name != "suffix_array":  # there n_chars, of which the columns were made, is counted anew
            assert all(r[5:] == tuple(f"{c} {r[4]}" for c in EXTRA) for r in got)
        return sorted((r[:5] for r in got), key=repr)

    rows = awkward_rows()
    kept = [ok for *_, ok in brute.quality_rules([(n, r[1]) for n, r in enumerate(rows)])]
    assert after("quality_rules", rows) == sorted((r for r, ok in zip(rows, kept) if ok), key=repr)

    groups = plain_groups(rows)
    second = after("near_duplicates", rows)
    assert len(second) == len(groups) and all(sum(r in g for r in second) == 1 for g in groups)

    assert after("suffix_array", rows) == without_passages(rows)

    fourth = after("mixing", rows)
    assert set(fourth) <= set(rows) and any(r[0] is None for r in fourth) and max(Counter(fourth).values()) <= 3 * max(Counter(rows).values())
    assert after("mixing", rows) == fourth

    assert dict(corpus_pipeline.STAGES)["byte_bpe"](spark, frame(rows), SF).count() == len(rows)


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0


def test_columns_of_any_type_come_along(spark):
    """Maps, arrays and structs, also with nulls in them, as far as the fourth stage."""
    prose = lambda k: " ".join(f"word{k * 100 + i} and" for i in range(60))
    text = ["same " + prose(1), "same " + prose(1), prose(2), prose(3), None]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(text)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "if(doc_id = 2, null, map('k', doc_id)) tags", "array(struct(map(doc_id, text) as m)) nested", "struct(doc_id as `a.b`) s", "array(doc_id, null) list")
    for name, function in corpus_pipeline.STAGES[:-1]:
        found = function(spark, docs, SF)
        assert found.columns == docs.columns, name
        docs = spark.createDataFrame(found.collect(), docs.schema)
        rows = {r.doc_id: r for r in docs.collect()}
        assert set(rows) == ({0, 1, 2, 3} if name == "quality_rules" else {0, 2, 3}), name
        assert rows[0].tags == {"k": 0} and rows[2].tags is None and rows[3].s["a.b"] == 3 and rows[3].list == [3, None]
