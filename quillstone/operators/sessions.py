"""Sessions: idle-timeout windows, accounts of a session, expiry and resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIMEOUT = 900  # seconds idle; a session ends only beyond it


def windows(events: DataFrame, key: str = "key", seconds: int = TIMEOUT) -> DataFrame:
    """Sessions per key with first and last event and count.  Session windows merge before the shuffle as well as after it."""
    w = F.session_window("ts", f"{seconds} seconds")
    return events.groupBy(key, w).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_activity"), F.count("*").alias("message_count")).drop("session_window")


def numbered(events: DataFrame, key: str = "key", order: tuple[str, ...] = ("ts", "seq"), seconds: int = TIMEOUT) -> DataFrame:
    """Every event with the number of its session, counted from 0."""
    by = Window.partitionBy(key).orderBy(*order)
    gap = F.coalesce(F.col("ts") > F.lag("ts").over(by) + F.expr(f"interval {seconds} seconds"), F.lit(False))
    return events.withColumn("new", gap.cast("int")).withColumn("session_no", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def info(events: DataFrame, as_of: str, key: str = "key") -> DataFrame:
    """Age, idle time and message count per key at ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    out = events.groupBy(key).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_activity"), F.count("*").alias("message_count"))
    return out.withColumns({"age_seconds": F.timestamp_diff("SECOND", "created_at", now), "inactive_seconds": F.timestamp_diff("SECOND", "last_activity", now)})


def expired(sessions: DataFrame, as_of: str, seconds: int = TIMEOUT) -> DataFrame:
    """With ``expired``: idle strictly longer than the timeout."""
    return sessions.withColumn("expired", F.col("last_activity") + F.expr(f"interval {seconds} seconds") < F.lit(as_of).cast("timestamp_ntz"))


def epochs(events: DataFrame, is_reset: Column, key: str = "key", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Per key and epoch, the messages since the last reset; a reset opens an epoch and is no message."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("reset", is_reset.cast("int")).withColumn("epoch", F.sum("reset").over(by))
    return out.groupBy(key, F.col("epoch").cast("long").alias("epoch")).agg(F.sum(1 - F.col("reset")).cast("long").alias("message_count"))


def until_closed(events: DataFrame, is_close: Column, key: str = "key", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Sessions that an event closes: the close belongs to the session that it ends and is no message; what follows opens the next one."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = events.withColumn("ends", F.coalesce(is_close, F.lit(False)))
    out = out.withColumn("session_no", F.coalesce(F.sum(F.col("ends").cast("long")).over(before), F.lit(0)))
    return out.groupBy(key, "session_no").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_activity"), F.sum(1 - F.col("ends").cast("long")).alias("message_count"), F.max("ends").alias("closed"))
