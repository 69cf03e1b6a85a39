"""Catalogue search: keys of names and brands, prefix and near-miss words, ranks, and completions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..sources.shared import stored

# Words of a query that count, and units that never continue a head.
MOST_WORDS = 8
UNITS = "mg mq mkg mkq mcg ml l g q gr qr kg kq sm mm m bv iu me ed eded n no x doza"


def index(products: DataFrame) -> DataFrame:
    """products with key (folded name), full (name and brand, each word after a blank) and words."""
    key = names.fold(F.col("name"))
    full = F.concat(F.lit(" "), key, F.lit(" "), names.fold(F.coalesce("brand", F.lit(""))))
    return products.withColumns({"key": key, "full": full}).withColumn("words", words_in("full"))


def words_in(full: str) -> Column:
    return F.array_distinct(F.filter(F.split(full, " "), lambda w: w != ""))


def vocabulary(indexed: DataFrame) -> DataFrame:
    """word and products that have it."""
    return indexed.select("product_id", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("products"))


def query_words(spark, query: str) -> list[list[str]]:
    """The words of a query, each with its readings: one that ends in a 'c' may go on as a k or an s. The query is one short
    text, folded like the names."""
    raw = [w for w in re.findall(r"[^\W_]+", query)][: 2 * MOST_WORDS]
    if not raw:
        return []
    # Literals over one row: folded while the plan is made, without a job.
    keys = spark.sql("SELECT 1").select(F.array(*(names.fold(F.lit(w)) for w in raw))).first()[0]
    out: list[list[str]] = []
    for w, key in zip(raw, keys):
        for part in key.split():
            readings = [part]
            if len(part) > 1 and part.endswith("k") and w.lower().endswith("c"):
                readings.append(part[:-1] + "s")
            if readings[0] not in [o[0] for o in out]:
                out.append(readings)
    return out[:MOST_WORDS]


def near_words(words: DataFrame, word: str) -> DataFrame:
    """Words of the vocabulary that begin like a word but for one error (two from six letters on), with the same first letter."""
    most = 1 if len(word) <= 5 else 2
    if len(word) < 4 or not word.isalpha():
        return words.where("false").withColumn("errors", F.lit(0))
    errors = F.levenshtein(F.substring("word", 1, len(word)), F.lit(word))
    return words.where(F.startswith("word", F.lit(word[0]))).withColumn("errors", errors).where(F.col("errors") <= most)


def needles(known: DataFrame, wanted: list[list[str]]) -> tuple[list[list[str]], bool]:
    """For each word of a query the beginnings to look for, and whether any of them is only nearly what was asked for.

    One job over the vocabulary says which readings are known, and one more, if any word has none, which are near."""
    asked = sorted({r for readings in wanted for r in readings if len(r) >= 3})
    begin = {r: F.startswith("word", F.lit(r)) for r in asked}
    row = known.where(_any(list(begin.values()))).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(f"r{i}") for i, c in enumerate(begin.values()))).first() if asked else ()
    there = dict(zip(asked, row))
    hits = [[r for r in readings if there.get(r, True)] for readings in wanted]
    lost = {i: readings[0] for i, readings in enumerate(wanted) if not hits[i]}
    if lost:
        # At most a dozen words come back for each word of the query.
        near = [near_words(known, w).orderBy("errors", F.desc("products"), "word").limit(12).select(F.lit(i).alias("i"), "errors", "products", "word") for i, w in lost.items()]
        for r in sorted(reduce(DataFrame.union, near).collect(), key=lambda r: (r.errors, -r.products, r.word)):
            hits[r.i].append(r.word)
    return [h or readings[:1] for h, readings in zip(hits, wanted)], any(hits[i] for i in lost)


def _rank(groups: list[list[str]], fuzzy: bool, phrase: str) -> Column:
    name = F.concat(F.lit(" "), F.col("key"))
    in_name = reduce(lambda a, g: a & _any([F.contains(name, F.lit(" " + w)) for w in g]), groups, F.lit(True))
    return F.lit(4) if fuzzy else F.when(F.startswith(name, F.lit(" " + phrase)), 0).when(F.contains(name, F.lit(" " + phrase)), 1).when(in_name, 2).otherwise(3)


def search(products: DataFrame, query: str) -> DataFrame:
    """product_id, site, name, rank of products that have all words of the query as beginnings of words.

    Rank 0: the name starts with the query; 1: has it; 2: has its words; 3: found by brand; 4: by words that are nearly those
    asked for; 5: a single word inside of words. Names are folded for every query; `keep` does so once for many."""
    wanted = query_words(products.sparkSession, query)
    if not wanted:
        return products.where("false").select("product_id", "site", "name", F.lit(0).alias("rank"))
    # Written once, so that neither products nor folded names are worked out again for every look at the vocabulary.
    indexed = stored(index(products).select("product_id", "site", "name", "key", "full"))
    groups, fuzzy = needles(vocabulary(indexed.withColumn("words", words_in("full"))), wanted)
    found = reduce(lambda a, g: a & _any([F.contains("full", F.lit(" " + w)) for w in g]), groups, F.lit(True))
    phrase = " ".join(r[0] for r in wanted)
    inside = F.contains("key", F.lit(phrase)) if len(wanted) == 1 and len(phrase) >= 4 else F.lit(False)
    return indexed.where(found | inside).select("product_id", "site", "name", F.when(found, _rank(groups, fuzzy, phrase)).otherwise(5).cast("int").alias("rank"))


class Kept(NamedTuple):
    """A stored index: rows (product_id, site, name, key), postings (word, product_id), words (word, products) and the stamp of what
    it was made of."""

    rows: DataFrame
    postings: DataFrame
    words: DataFrame
    stamp: DataFrame


def keep(products: DataFrame, runs: DataFrame, folder: str) -> Kept:
    """Writes the index of products (product_id must be unique) into a folder of its own that all executors share.

    Postings and words are dealt and sorted by word, so that a scan for beginnings reads only the row groups that can hold them, and a word
    that very many products have is spread over several files."""
    spark = products.sparkSession
    index(products).select("product_id", "site", "name", "key", "words").write.parquet(f"{folder}/rows")
    each = spark.read.parquet(f"{folder}/rows").select(F.explode("words").alias("word"), "product_id")
    each.repartitionByRange("word", "product_id").sortWithinPartitions("word", "product_id").write.parquet(f"{folder}/postings")
    counted = spark.read.parquet(f"{folder}/postings").groupBy("word").agg(F.count("*").alias("products"))
    counted.repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{folder}/words")
    stamp(products, runs).write.parquet(f"{folder}/stamp")
    return kept(spark, folder)


def kept(spark: SparkSession, folder: str) -> Kept:
    return Kept(*(spark.read.parquet(f"{folder}/{t}") for t in Kept._fields))


def is_current(made: Kept, products: DataFrame, runs: DataFrame) -> bool:
    """Whether an index still stands for the products: if not, `keep` it anew in another folder."""
    return made.stamp.first() == stamp(products, runs).first()


def search_kept(made: Kept, query: str) -> DataFrame:
    """What `search` finds, from a stored index."""
    none = made.rows.where("false").select("product_id", "site", "name", F.lit(0).alias("rank"))
    wanted = query_words(made.rows.sparkSession, query)
    if not wanted:
        return none
    groups, fuzzy = needles(made.words, wanted)
    begins = [_any([F.startswith("word", F.lit(w)) for w in g]) for g in groups]
    all_of = reduce(lambda a, c: a & c, (F.bool_or(c) for c in begins))
    hits = made.postings.where(_any(begins)).groupBy("product_id").agg(all_of.alias("all_of")).where("all_of").select("product_id")
    phrase = " ".join(r[0] for r in wanted)
    found = made.rows.join(hits, "product_id", "left_semi").select("product_id", "site", "name", _rank(groups, fuzzy, phrase).cast("int").alias("rank"))
    if len(wanted) > 1 or len(phrase) < 4:
        return found
    inside = made.rows.where(F.contains("key", F.lit(phrase))).join(hits, "product_id", "left_anti")
    return found.unionByName(inside.select("product_id", "site", "name", F.lit(5).alias("rank")))


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def heads(products: DataFrame) -> DataFrame:
    """head, words (1 or 2), products: first words of names, alone and with a second word that goes on with them."""
    w = F.split(names.fold(F.col("name")), " ")
    first, second = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    units = F.array(*map(F.lit, UNITS.split()))
    goes_on = second.isNotNull() & ~F.array_contains(units, second) & ~second.rlike(r"^n\d+$") & (second.rlike("^[a-z]+$") | second.rlike(r"^\d{4,}$") | second.rlike(r"^[a-z]{1,2}\d{1,3}$"))
    both = F.array_compact(F.array(F.struct(first.alias("head"), F.lit(1).alias("words")), F.when(goes_on, F.struct(F.concat_ws(" ", first, second).alias("head"), F.lit(2).alias("words")))))
    return products.select("product_id", F.explode(both).alias("h")).select("product_id", "h.*").where("head <> ''").groupBy("head", "words").agg(F.count("*").alias("products"))


def completions(products: DataFrame, query: str, top: int = 8) -> DataFrame:
    """head, products: how a query of one or two words may go on; the commonest, then shortest heads first."""
    wanted = query_words(products.sparkSession, query)
    h = heads(products)
    if not wanted or len(wanted) > 2:
        return h.where("false").select("head", "products")
    if len(wanted) == 1:
        hit = _any([F.startswith("head", F.lit(r)) & (F.col("words") == 1) for r in wanted[0]] + [F.contains("head", F.lit(" " + r)) | F.startswith("head", F.lit(r + " ")) for r in wanted[0]])
    else:
        hit = (F.col("words") == 2) & _any([F.startswith("head", F.lit(r)) for r in wanted[0]]) & _any([F.contains("head", F.lit(" " + r)) for r in wanted[1]])
    return h.where(hit).orderBy("words", F.desc("products"), F.length("head"), "head").limit(top).select("head", "products")


def with_cluster_names(hits: DataFrame, products: DataFrame, clusters: DataFrame, word: str, now: str, days: int = 60, top: int = 100) -> DataFrame:
    """match_id of clusters that have a hit or the word in their own name, and, with match_id null, hits of no cluster that were
    seen lately (product_id)."""
    own = hits.join(products.select("product_id", "match_id", "last_seen_at"), "product_id")
    named = clusters.where(F.contains(names.fold(F.col("name")), F.lit(word))).select("match_id")
    matched = own.where("match_id is not null").select("match_id").union(named).distinct().select("match_id", F.lit(None).cast("long").alias("product_id"))
    recent = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last_seen_at").cast("timestamp")) <= days * 86400
    others = own.where(F.col("match_id").isNull() & recent).orderBy("rank", "product_id").limit(top).select(F.lit(None).cast("long").alias("match_id"), "product_id")
    return matched.unionByName(others)


def listing(products: DataFrame, site: str | None = None, brand: str | None = None, category: str | None = None, on_sale: bool | None = None, page: int = 0, size: int = 50) -> DataFrame:
    """A page of products by facets; filters come before paging."""
    df = products
    for column, value in (("site", site), ("brand", brand), ("category", category), ("on_sale", on_sale)):
        df = df if value is None else df.where(F.col(column) == value)
    return df.orderBy("name", "product_id").offset(page * size).limit(size)


def stamp(products: DataFrame, runs: DataFrame) -> DataFrame:
    """One row that changes when the index has to be built anew: the newest product and the last finished run."""
    return products.agg(F.max("product_id").alias("newest"), F.count("*").alias("products")).crossJoin(runs.agg(F.max("finished_at").alias("finished")))


def ranked(hits: DataFrame, k: int = 20) -> DataFrame:
    """The first hits, by rank, then name."""
    return hits.withColumn("place", F.row_number().over(Window.orderBy("rank", "name", "product_id"))).where(F.col("place") <= k)
