"""Seed files of categories: blocks of keys and plain values under one heading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Indentation, key and value of a line; comments and empty lines don't match.
LINE = r"""^( *)["']?([^\s"'#:][^"':]*?)["']?\s*:(?:\s+(.*?))?\s*$"""


def category_seeds(spark: SparkSession, path: str, sites: tuple[str, ...], heading: str = "categories") -> DataFrame:
    """file, key, label_ru, label_az and <site>_slug of every category in files such as

        categories:
          vitamins:
            label_ru: "Vitamins"
            rival_a: vit-1

    A label that is missing or empty is the key; empty, `null` and `~` are null. What lies outside the heading, and keys with a plain
    value in place of a block, are passed over; of a key twice in a file the last block counts whole. Flow style, lists, anchors
    and texts of several lines are not read. A file is read in one task."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    part = lambda n: F.regexp_extract("line", LINE, n)
    raw = F.regexp_replace(part(3), r"^#.*$|\s+#.*$", "")
    quoted = F.regexp_extract(part(3), r"""^(?:"([^"]*)"|'([^']*)')""", 0)
    value = F.when(quoted != "", F.substring(quoted, F.lit(2), F.length(quoted) - 2)).when(~raw.isin("", "null", "~"), raw)
    lines = whole.where(F.col("line").rlike(LINE)).select("file", "pos", F.length(part(1)).alias("depth"), part(2).alias("name"), value.alias("value"))
    before = Window.partitionBy("file").orderBy("pos")
    lines = lines.withColumn("section", F.last(F.when(F.col("depth") == 0, F.col("name")), ignorenulls=True).over(before)).where((F.col("section") == heading) & (F.col("depth") > 0))
    lines = lines.withColumn("outer", F.min("depth").over(Window.partitionBy("file")))
    block = F.struct("pos", F.col("name").alias("key"), "value")
    lines = lines.withColumn("block", F.last(F.when(F.col("depth") == F.col("outer"), block), ignorenulls=True).over(before))
    fields = lines.where((F.col("depth") > F.col("outer")) & F.col("block.value").isNull())
    said = lambda name: F.max_by("value", F.when(F.col("name") == name, F.col("pos")))
    slugs = [f"{s}_slug" for s in sites]
    blocks = fields.groupBy("file", "block.key", F.col("block.pos").alias("at")).agg(said("label_ru").alias("label_ru"), said("label_az").alias("label_az"), *(said(s).alias(c) for s, c in zip(sites, slugs)))
    last = blocks.groupBy("file", "key").agg(F.max_by(F.struct("label_ru", "label_az", *slugs), "at").alias("r"))
    return last.select("file", "key", F.coalesce(F.nullif("r.label_ru", F.lit("")), "key").alias("label_ru"), "r.label_az", *(f"r.{c}" for c in slugs))
