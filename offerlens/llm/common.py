"""What the corpus operators share: reading tables, the word definition, Arrow batches in small steps."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII blanks. bytes.split() in Python cuts at the same six bytes.
BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names, so that other columns of any name do no harm."""
    return df.select(*(df[old].alias(new) for new, old in columns.items()))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few rows each, so that Python holds few texts as objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one of our own on a single machine
    only: on a cluster each host would have another."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read again: cuts lineage, computes once, and
    outlives executors. The table goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/offerlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then
        pass


def partitions_for(spark: SparkSession, wanted: int) -> int:
    """At least the session's number of shuffle partitions, more if the data ask for it."""
    return max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))
