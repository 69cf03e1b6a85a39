"""Structured Streaming twins of batch operators: the same results, fed in micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intake import SEEN_RUNS, persisted
from ..sources.shared import shared_folder


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A Parquet folder or file as a stream, a file a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def journal(observations: DataFrame) -> DataFrame:
    """Change-only journal: product_id, price_cents, discount_cents, at. State: each product's last kept pair.

    Rows of one product must arrive in order across batches; within a batch they are sorted by time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "price_cents", "discount_cents"])
        now = pd.DataFrame({"price_cents": rows["price_cents"].astype("int64"), "discount_cents": rows["discount_cents"].fillna(-1).astype("int64")})
        before = now.shift()
        if state.exists and len(now):
            before.iloc[0] = state.get
        kept = (now != before).any(axis=1)
        if len(now):
            state.update(tuple(map(int, now.iloc[-1])))
        yield now[kept].assign(product_id=key[0], at=rows["at"])[["product_id", "price_cents", "discount_cents", "at"]]

    out = "product_id long, price_cents long, discount_cents long, at timestamp"
    return observations.groupBy("product_id").applyInPandasWithState(step, out, "price_cents long, discount_cents long", "append", GroupStateTimeout.NoTimeout)


def cooldown(events: DataFrame, hours: int) -> DataFrame:
    """Events that pass a cooldown per type and user, measured from the last that passed. State: that time."""
    gap = hours * 3600 * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for us in sorted(pd.concat(list(batches))["us"]):
            if last is None or us - last >= gap:
                kept.append((*key, int(us)))
                last = int(us)
        state.update((last,))
        yield pd.DataFrame(kept, columns=["event_type", "user_id", "us"])

    rows = events.select("event_type", "user_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("event_type", "user_id").applyInPandasWithState(step, "event_type string, user_id long, us long", "last long", "append", GroupStateTimeout.NoTimeout)


def anchored(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Day windows from 22:00 on by type, closed by a watermark."""
    w = F.window("ts", "24 hours", "24 hours", "22 hours")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def once_each(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Replays of an event within the watermark count once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def countries(observations: DataFrame) -> DataFrame:
    """Country by two-run promotion: product_id, code, status after each batch that says something of a product. State: the country,
    the candidate, in how many runs it was seen and the last of them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        code, candidate, seen, last = state.get if state.exists else (None, None, 0, -1)
        status = "resolved" if code and not seen else "ambiguous" if seen else "unknown"
        for r in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            if r["code"] is None:
                continue
            if code in (None, r["code"]):
                code, candidate, seen, last, status = r["code"], None, 0, -1, "resolved"
                continue
            seen = seen + (r["run_id"] != last) if candidate == r["code"] else 1
            candidate, last, status = r["code"], int(r["run_id"]), "ambiguous"
            if seen >= SEEN_RUNS:
                code, candidate, seen, last, status = r["code"], None, 0, -1, "resolved"
        state.update((code, candidate, int(seen), int(last)))
        yield pd.DataFrame({"product_id": [key[0]], "code": [code], "status": [status]})

    out, kept = "product_id long, code string, status string", "code string, candidate string, seen int, last long"
    return observations.groupBy("product_id").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)


def persist(observations: DataFrame, folder: str, checkpoint: str, fields: tuple[str, ...]) -> StreamingQuery:
    """Writes the change-only journal of a stream batch by batch under folder: what differs from what earlier batches stored.

    A batch writes a folder of its own by number, so a batch that is run again overwrites itself and nothing else."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parts = [f"{folder}/batch={n}" for n in range(number)]
        stored = None
        for part in parts:
            try:
                one = spark.read.parquet(part)
            except AnalysisException:  # a batch in which nothing had changed
                continue
            stored = one if stored is None else stored.unionByName(one)
        last = batch.limit(0) if stored is None else stored
        last = last.groupBy("product_id").agg(F.max_by(F.struct(*fields), "seq").alias("x")).select("product_id", "x.*")
        persisted(batch, last, fields).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return observations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_by_scope(observations: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Rows of full runs and of partial ones go to folders of their own, so that a partial run never overrides what a verified one
    has said; confirmed_journal joins them when a later full run has seen the same."""

    def write(batch: DataFrame, number: int) -> None:
        for scope in ("full", "partial"):
            batch.where(F.col("scope") == scope).write.mode("overwrite").parquet(f"{folder}/{scope}/batch={number}")

    return observations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(df: DataFrame) -> DataFrame:
    """Runs a stream over what is there and returns what it put out, by way of files in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/offerlens-stream-{uuid.uuid4().hex}"
    query = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")
