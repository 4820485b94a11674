"""Structured Streaming forms of sessions and settled answers.

Event time is made a ``timestamp`` (watermarks do not take ``timestamp_ntz``); the
session time zone should be UTC.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from quillstone.operators.answers import DEADLINE, SESSION
from quillstone.operators.sessions import TIMEOUT
from quillstone.shared import new_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 64) -> DataFrame:
    """Events as they arrive in a folder (or at a path), as observations; with None, all files that are there make one micro-batch."""
    reader = spark.readStream.schema(EVENTS)
    reader = reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may match a file or a folder
    return raw.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), (F.col("event_type") == "error").alias("thinking"))


def session_stream(obs: DataFrame, seconds: int = TIMEOUT, late: str = "1 hour") -> DataFrame:
    """Sessions, emitted once the watermark has passed them; later events are dropped."""
    w = F.session_window("ts", f"{seconds} seconds")
    out = obs.withWatermark("ts", late).groupBy("key", w).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_activity"), F.count("*").alias("message_count"))
    return out.drop("session_window")


ANSWER = StructType([StructField("key", LongType()), StructField("text", StringType()), StructField("ts", TimestampType()), StructField("status", StringType())])


class Settling(StatefulProcessor):
    """Counts equal texts per key; emits one answer, or a timeout row at the deadline.

    State is (last text, count, done); rows of a micro-batch are sorted by (ts, seq)
    before they count.  The deadline runs on processing time from the first row; with
    None there is no deadline, as for a replay.
    """

    def __init__(self, k: int = SESSION, deadline: int | None = DEADLINE):
        self.k, self.deadline = k, deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [StructField("text", StringType()), StructField("n", IntegerType()), StructField("done", IntegerType())]
        self.state = handle.getValueState("run", StructType(fields))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "seq"])
        if self.state.exists():
            text, n, done = self.state.get()
        else:
            text, n, done = None, 0, 0
            if self.deadline is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.deadline * 1000)
        for row in new.itertuples():
            if done:
                break
            said = (row.text or "").strip()
            if row.thinking or not said:
                continue
            n = n + 1 if said == text else 1
            text = said
            if n >= self.k:
                done = 1
                yield pd.DataFrame({"key": [key[0]], "text": [text], "ts": [row.ts], "status": ["success"]})
        self.state.update((text, n, done))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists() and not self.state.get()[2]:
            text, n, _ = self.state.get()
            self.state.update((text, n, 1))
            yield pd.DataFrame({"key": [key[0]], "text": [None], "ts": [pd.NaT], "status": ["timeout"]})

    def close(self) -> None:
        pass


def answer_stream(obs: DataFrame, k: int = SESSION, deadline: int | None = DEADLINE) -> DataFrame:
    """The settled answer per key, as soon as it has settled."""
    mode = "None" if deadline is None else "ProcessingTime"
    return obs.groupBy("key").transformWithStateInPandas(statefulProcessor=Settling(k, deadline), outputStructType=ANSWER, outputMode="Append", timeMode=mode)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str = "append", provider: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into Parquet, and return what it wrote.

    In complete mode each micro-batch writes the whole result into a folder of its own,
    and the last one counts.
    """
    spark = stream.sparkSession
    folder, key = new_folder(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    out, written = f"{folder}/out", []

    def whole(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{batch}")
        written.append(batch)

    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    writer = writer.foreachBatch(whole) if mode == "complete" else writer.format("parquet").option("path", out)
    if provider:
        spark.conf.set(key, provider)
    try:
        writer.start().awaitTermination()
    finally:
        if provider:
            spark.conf.set(key, before) if before else spark.conf.unset(key)
    if mode != "complete":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.schema(stream.schema).parquet(f"{out}/{written[-1]}") if written else spark.createDataFrame([], stream.schema)


def drain_sessions(spark: SparkSession, path: str) -> DataFrame:
    """All sessions: complete mode drops no late event and returns those still open at the end."""
    return drain(session_stream(events_stream(spark, path, None)), "complete", ROCKS)


def drain_answers(spark: SparkSession, path: str) -> DataFrame:
    """Runs of equal texts are counted in event order, so all events go into one micro-batch."""
    return drain(answer_stream(events_stream(spark, path, None), deadline=None), provider=ROCKS)
