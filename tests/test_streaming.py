"""Streams against their batch forms."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from quillstone.operators import answers, sessions
from quillstone.plans import bindings
from quillstone.streaming import live


def test_sessions(spark, sf_dir):
    got = live.drain_sessions(spark, f"{sf_dir}/events.parquet")
    rows = {(r.key, r.created_at, r.last_activity, r.message_count) for r in got.collect()}
    batch = sessions.windows(bindings.observations(spark, sf_dir))
    end = batch.agg(F.max("last_activity")).first()[0] - dt.timedelta(hours=1)
    closed = {(r.key, r.created_at, r.last_activity, r.message_count) for r in batch.collect() if r.last_activity + dt.timedelta(seconds=900) <= end}
    everything = {tuple(r) for r in batch.select("key", "created_at", "last_activity", "message_count").collect()}
    assert closed <= rows <= everything and closed


def test_answers(spark, sf_dir):
    got = {(r.key, r.text, r.ts) for r in live.drain_answers(spark, f"{sf_dir}/events.parquet").filter("status = 'success'").collect()}
    batch = answers.stable(answers.usable(bindings.observations(spark, sf_dir)), answers.SESSION)
    assert got == {(r.key, r.text, r.ts) for r in batch.collect()}


def test_many_unordered_files(spark, sf_dir, tmp_path):
    events = bindings.table(spark, sf_dir, "events")
    events.repartition(80, F.xxhash64("event_id")).write.option("maxRecordsPerFile", 10).parquet(f"{tmp_path}/events.parquet")
    assert len(list(tmp_path.glob("events.parquet/*.parquet"))) > 64
    obs = bindings.observations(spark, sf_dir)
    got = live.drain_sessions(spark, f"{tmp_path}/events.parquet").select("key", "created_at", "last_activity", "message_count").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, sessions.windows(obs).select("key", "created_at", "last_activity", "message_count").collect()))
    got = live.drain_answers(spark, f"{tmp_path}/events.parquet").select("key", "text", "ts", "status").collect()
    assert sorted(map(tuple, got)) == sorted((r.key, r.text, r.ts, "success") for r in answers.stable(answers.usable(obs), answers.SESSION).collect())


class Fake:
    """Enough of a state-store handle for the processor."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def polls(texts, begin=0):
    return pd.DataFrame({"ts": [pd.Timestamp(begin + k, unit="s") for k in range(len(texts))], "seq": range(len(texts)), "text": texts, "thinking": [t == "..." for t in texts]})


def test_settling_over_batches():
    fake, one = Fake(), live.Settling(3, 120)
    one.init(fake)
    assert list(one.handleInputRows((1,), iter([polls(["A", "...", "A"]).iloc[::-1]]), fake)) == []
    assert fake.timers == [121_000]
    (out,) = one.handleInputRows((1,), iter([polls(["A ", "A"], 10)]), fake)
    assert out.iloc[0][["key", "text", "status"]].tolist() == [1, "A", "success"] and out.ts[0] == pd.Timestamp(10, unit="s")
    assert list(one.handleExpiredTimer((1,), fake, None)) == []
    assert list(one.handleInputRows((1,), iter([polls(["B"] * 5, 20)]), fake)) == []


def test_settling_times_out():
    fake, one = Fake(), live.Settling(3, 120)
    one.init(fake)
    assert list(one.handleInputRows((7,), iter([polls(["A", "B", "A", "B"])]), fake)) == []
    (out,) = one.handleExpiredTimer((7,), fake, None)
    assert out.status.tolist() == ["timeout"] and out.text[0] is None
    assert list(one.handleInputRows((7,), iter([polls(["B"] * 5, 20)]), fake)) == []
