from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside, as extra columns of the input.
CLASHING = ("chunk", "hashes", "fp", "score", "size", "salt", "kept", "h1", "key", "n_words", "held_out", "label", "range", "v")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "ΔELTA", "naïve", "日本語", "don't", "42", "#x|y", "o p", "z‍", "ﬁn"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))
    passage, line = prose(70), prose(12)
    texts = [
        None, "", " \t\n\x0b\x0c\r ", "one", "two words", "Two Words", passage, passage.upper(), "x " + passage + " y", prose(30) + "\n" + passage + "\n" + prose(5),
        f"{line}\n{line}\n \n{line}", "ab" * 400, "a" * 1500, "a b " * 300, prose(6000) + " " + passage, passage + " " + passage, "\x1cfoo\x85bar baz \x00q", "🙂" * 90 + " end", "é" * 130,
        "<|endoftext|> <|startoftext|>", "   spaces   and\ttabs\n\nnew", "I'll we'RE they'd", passage[:-1] + "Q", prose(25), prose(400),
    ]
    rows = [(i * 3 - 6, t, ["en", "de", None][i % 3], ["a", "b", None, "B", ""][i % 5], 1, *["clash"] * len(CLASHING)) for i, t in enumerate(texts)]
    rows += [(None, passage, None, None, None, *[None] * len(CLASHING)), (None, None, None, None, None, *[None] * len(CLASHING))]
    return rows + rows[6:8]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(params=["awkward", "documents", "nothing"])
def docs(request):
    return request.getfixturevalue(request.param)
