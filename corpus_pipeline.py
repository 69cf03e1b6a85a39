"""The corpus pipeline: five stages, each calling one operator, each written as Parquet and read again.

The stages work on rows: no row is lost for want of an id or for sharing one. Rejected are rows that the quality
rules reject, which null, empty and blank texts are; near-duplicates of another row, of which one stays, null ids
last; and what the mix leaves out. A null source is a source of its own. Columns beside those of documents, of
whatever name, come along as far as the fourth stage. An empty table goes through to an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.byte_bpe import byte_bpe
from offerlens.llm.common import read_table, stored
from offerlens.llm.mixing import mix_sources
from offerlens.llm.near_dup import near_duplicates
from offerlens.llm.quality_rules import quality_rules
from offerlens.llm.suffix_dups import remove_repeated_passages


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many marks as it takes for no column to have it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, written, so that a row keeps its number; and that column's name."""
    key = free_name(docs, "row_key")
    return stored(docs.withColumn(key, F.monotonically_increasing_id())), key


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged. Null, empty and blank texts have too few words to stay."""
    carried = {f"in_{c}": c for c in docs.columns}
    scored = quality_rules(docs.select("doc_id", "text", *(F.col(c).alias(x) for x, c in carried.items())), carry=tuple(carried))
    return scored.where("kept").select(*(F.col(x).alias(c) for x, c in carried.items()))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id, unchanged.

    Only fingerprints link: rows of one id with unlike texts both stay. Of rows of the smallest id that are in one
    group, the one of least hash stays; rows without an id come last. Maps, which have no hash, don't count in it. Null, empty and blank texts are one group."""
    rows, key = keyed(docs)
    groups = near_duplicates(rows, id_col=key).select(F.col("doc_id").alias("k"), F.col("component_id").alias("g"))
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = rows.select(F.col(key).alias("k"), F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", F.xxhash64(*hashed).alias("hash"), F.col(key).alias("row")).alias("o"))
    stay = groups.join(order, "k").groupBy("g").agg(F.min("o")["row"].alias("row"))
    return rows.join(stay, rows[key] == stay["row"], "left_semi").select(*docs.columns)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of 100 bytes that an earlier one (or an earlier part of it) has.

    Characters that would go in part stay. A null text becomes an empty one; n_chars counts what is left."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    carried = {f"in_{c}": c for c in rest}
    cleaned = remove_repeated_passages(docs.select("doc_id", "text", *(F.col(c).alias(x) for x, c in carried.items())), carry=tuple(carried), with_text=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")} | {c: F.col(x) for x, c in carried.items()}
    return cleaned.select(*(made[c].alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, as many times as it takes them. Texts without a word come in whole passes only."""
    rows, key = keyed(docs)
    taken = mix_sources(rows, carry=(key,)).where("copies > 0").select(F.col(key).alias("k"), F.sequence(F.lit(1).cast("long"), F.col("copies")).alias("times"))
    inner = free_name(docs, "mix")
    found = rows.select(key, F.struct(*docs.columns).alias(inner)).join(taken, F.col(key) == F.col("k"))
    return found.select(inner, F.explode("times")).select(*(F.col(inner)[c].alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token counts and digests of the ids and of what they decode to, of every document."""
    return byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", reject_low_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("suffix_array", remove_passages),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: Fingerprints, likelihood ratios over hash buckets and merges are beyond plain SQL; tests hold run() against a
#: brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
