"""Language ID by word-first backoff.

The model holds the commonest words and the commonest character n-grams of each language, with their log relative
frequencies in every language. A word that the model knows adds its own log frequencies; an unseen word backs off to its
n-grams of four letters, then three, two and one, and adds the mean over those of the first length of which
the model knows any. The language with the largest sum wins.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, partitions_for, pick, slices, stored

LETTERS = re.compile(r"[^\W\d_]+").findall
#: Different words (or grams) that a task counts before it hands its counts on.
FLUSH = 300_000
#: Words that a worker process keeps beside those of the model.
CACHE_LIMIT = 200_000


@dataclass(frozen=True)
class Setting:
    """Words, and grams of each length, that the model keeps for each language, and its smoothing. Bounds the model, not what is counted."""

    entries: int = 10_000
    longest: int = 4
    floor: float = 0.5


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word with a blank at either end (single letters without)."""
    if n == 1:
        return [*word]
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counted(pairs: Iterator[tuple[str, str, Counter]], flush: int = FLUSH) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, kind, item, n) from counters, added up before they leave the task."""
    sums: dict[tuple[str, int], Counter] = {}
    size = 0

    def out():
        for (lang, kind), c in sums.items():
            items = list(c)
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(part), pa.string()), "kind": pa.array([kind] * len(part), pa.int32()), "item": pa.array(part, pa.string()), "n": pa.array([c[x] for x in part], pa.int64())})

    for lang, kind, c in pairs:
        own = sums.setdefault((lang, kind), Counter())
        size -= len(own)
        own.update(c)
        size += len(own)
        if size >= flush:
            yield from out()
            sums.clear()
            size = 0
    yield from out()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, kind 0, item (a word in lower case) and n, over every text with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for batch in slices(batches):
                by: dict[str, list[str]] = {}
                for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                    by.setdefault(lang, []).extend(LETTERS(text.lower()))
                for lang, words in by.items():
                    yield lang, 0, Counter(words)

        yield from _counted(pairs())

    shares = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, kind int, item string, n long")
    return shares.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """lang, kind (the length), item (an n-gram) and n, from counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for batch in slices(batches, 5000):
                by: dict[tuple[str, int], Counter] = {}
                for lang, word, n in zip(batch["lang"].to_pylist(), batch["item"].to_pylist(), batch["n"].to_pylist()):
                    for kind in range(1, longest + 1):
                        c = by.setdefault((lang, kind), Counter())
                        for g in grams_of(word, kind):
                            c[g] += n
                for (lang, kind), c in by.items():
                    yield lang, kind, c

        yield from _counted(pairs())

    shares = words.select("lang", "item", "n").mapInArrow(run, "lang string, kind int, item string, n long")
    return shares.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, s: Setting) -> tuple[list[str], list[dict[str, int]], np.ndarray]:
    """Languages, for each kind the row of each item, and the rows: a log frequency for each language.

    What comes to the driver is bounded by the entries of the setting (and, at the cut, chance), for each language
    and kind, times the number of languages.
    """
    words = stored(word_counts(docs))
    # Dealt anew, as the words fill few files.
    dealt = words.repartition(partitions_for(docs.sparkSession, 1))
    counts = words.unionByName(stored(gram_counts(dealt, s.longest)))
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    # How many items have each count tells where the cut lies, so that no language is ranked in one task. Of the
    # items at the cut a share goes in, by hash.
    alike = counts.groupBy("lang", "kind", "n").agg(F.count("*").alias("items"))
    above = F.sum("items").over(Window.partitionBy("lang", "kind").orderBy(F.desc("n")))
    cut = alike.withColumn("above", above).where(F.col("above") - F.col("items") < s.entries)
    cut = cut.groupBy(F.col("lang").alias("l"), F.col("kind").alias("o")).agg(F.min("n").alias("least"), F.min_by((s.entries - F.col("above") + F.col("items")) / F.col("items"), "n").alias("share"))
    top = counts.join(F.broadcast(cut), (F.col("lang") == F.col("l")) & (F.col("kind") == F.col("o")))
    top = top.where((F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & (F.pmod(F.xxhash64("item"), F.lit(1 << 20)) < F.col("share") * (1 << 20))))
    # What is among the first of one language has its own count in every language that has it at all.
    items = top.select(F.col("kind").alias("k"), F.col("item").alias("i")).distinct()
    found = counts.join(items, (F.col("kind") == F.col("k")) & (F.col("item") == F.col("i")), "left_semi").toPandas()
    sums = totals.toPandas()
    langs = sorted(sums["lang"].unique())
    column = {x: i for i, x in enumerate(langs)}
    rows: list[dict[str, int]] = []
    tables = [np.zeros((0, len(langs)))]
    for kind in range(s.longest + 1):
        mine, before = found[found["kind"] == kind], sum(map(len, tables))
        names = sorted(mine["item"].unique())
        rows.append({x: before + i for i, x in enumerate(names)})
        total = np.ones(len(langs))
        own = sums[sums["kind"] == kind]
        total[own["lang"].map(column).to_numpy(np.int64)] = own["total"].to_numpy()
        # The floor stands for what a language does not have.
        table = np.full((len(names), len(langs)), s.floor)
        table[mine["item"].map(rows[kind]).to_numpy(np.int64) - before, mine["lang"].map(column).to_numpy(np.int64)] = mine["n"].to_numpy()
        tables.append(np.log(table / total))
    table = np.concatenate(tables)
    return langs, rows, table


class Model:
    """Scores texts. Vectors of words met before are kept, up to a limit, in one array after those of the model."""

    def __init__(self, langs: list[str], rows: list[dict[str, int]], table: np.ndarray):
        self.langs, self.rows, self.table = langs, rows, table
        self.forget()

    def forget(self) -> None:
        self.known = dict(self.rows[0])
        self.vectors = self.table

    def back_off(self, words: list[str]) -> None:
        """Keeps, for each unseen word, the mean over its n-grams of the greatest length that is known (zeros if
        not even a letter is)."""
        found, counts, at = [], [], []
        for k, w in enumerate(words):
            for n in range(len(self.rows) - 1, 0, -1):
                get = self.rows[n].get
                if mine := [i for g in grams_of(w, n) if (i := get(g)) is not None]:
                    found += mine
                    counts.append(len(mine))
                    at.append(k)
                    break
        new = np.zeros((len(words), len(self.langs)))
        if found:
            n = np.array(counts)
            new[at] = np.add.reduceat(self.table[found], np.cumsum(n) - n, axis=0) / n[:, None]
        self.known.update(zip(words, range(len(self.vectors), len(self.vectors) + len(words))))
        self.vectors = np.concatenate([self.vectors, new])

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """The likeliest language and its share; 'und' and 0 without a letter, or if nothing was learned."""
        lists = [LETTERS(t.lower()) if t and self.langs else [] for t in texts]
        if len(self.known) > CACHE_LIMIT + len(self.rows[0]):
            self.forget()
        if new := set().union(*lists).difference(self.known):
            self.back_off(sorted(new))
        for words in lists:
            if not any(any(map(str.isalpha, w)) for w in words):
                yield "und", 0.0
                continue
            total = self.vectors[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(np.argmax(total))  # of equals, the first by name
            yield self.langs[best], float(1 / np.exp(total - total[best]).sum())


_models: dict[str, Model] = {}


def model_of(name: str, given: Broadcast) -> Model:
    """One model a worker process, so that it is unpacked once and what it knows serves later tasks too."""
    if name not in _models:
        _models.clear()
        _models[name] = Model(*given.value)
    return _models[name]


def identify_language(docs: DataFrame, setting: Setting = Setting(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the winner's share, 0 to 1) of every row.

    Learns from texts with a language that are not held out. Texts that are null or have no letter are 'und'
    with score 0, as is everything if there is nothing to learn from. Equal sums go to the first language by
    name. Repeated rows count repeatedly and give repeated results; an empty table gives no rows; other
    columns are not read.
    """
    docs = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", held_out(F.col("doc_id")))
    # Bounded by the setting's entries, languages and kinds.
    given = docs.sparkSession.sparkContext.broadcast(learn(docs.where("not held_out"), setting))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(name, given)
        for batch in slices(batches):
            found = list(model.predict(batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
