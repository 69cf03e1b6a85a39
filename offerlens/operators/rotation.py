"""Which site or category is collected next."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def due_sites(sites: DataFrame, attempts: DataFrame, now: str) -> DataFrame:
    """site, due, hours: whether a site is to be collected in full now, and the hours since its last full collection ended.

    sites: site, hours (the cadence) and anchor (a moment at which a window begins). attempts: site, started_at, finished_at,
    status, eligible, of full collections. A site is done if its latest attempt began in the present window and succeeded, or
    was degraded but eligible."""
    at = F.lit(now).cast("timestamp_ntz")
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    length = F.col("hours") * 3600
    start = seconds(F.col("anchor")) + F.floor((seconds(at) - seconds(F.col("anchor"))) / length) * length
    last = attempts.where(F.col("started_at") <= at).groupBy("site").agg(F.max_by(F.struct("started_at", "finished_at", "status", "eligible"), "started_at").alias("a"))
    both = sites.select("site", start.alias("window_start")).join(last, "site", "left")
    good = (F.col("a.status") == "ok") | ((F.col("a.status") == "degraded") & F.col("a.eligible"))
    done = F.coalesce(good & (seconds(F.col("a.started_at")) >= F.col("window_start")), F.lit(False))
    hours = (seconds(at) - seconds(F.coalesce("a.finished_at", "a.started_at"))) / 3600
    return both.select("site", (~done).alias("due"), F.when(done, hours).alias("hours"))


def rotated(ticks: DataFrame, turns: int, gap_seconds: int) -> DataFrame:
    """The ticks (key, at, seq, site) with turn and taken: a tick takes the turn of its key, which then passes to the next of
    `turns`, if its site has not been taken in the last so many seconds; else it leaves the turn as it is.

    A chain of decisions, so a key's ticks are read in order; a task holds one tick and the last take of each site."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turn, held = object(), 0, {}
        for batch in batches:
            out_turn, out_taken = [], []
            for k, at, site in zip(batch["key"].to_pylist(), batch["second"].to_pylist(), batch["site"].to_pylist()):
                if k != key:
                    key, turn, held = k, 0, {}
                free = site not in held or at - held[site] >= gap_seconds
                out_turn.append(turn % turns)
                out_taken.append(free)
                if free:
                    held[site] = at
                    turn += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out_turn, pa.int64()), pa.array(out_taken, pa.bool_())], names=[*batch.schema.names, "turn", "taken"])

    given = ticks.select("key", "site", "seq", F.unix_seconds(F.col("at").cast("timestamp")).alias("second"))
    ordered = given.repartition("key").sortWithinPartitions("key", "second", "seq")
    return ordered.mapInArrow(run, "key long, site string, seq long, second long, turn long, taken boolean")
