"""Streams against the batch operators."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalmill.operators import consensus, dispatch
from signalmill.session import SETTINGS
from signalmill.streaming import epochs, processors


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, SETTINGS[key])
    yield
    spark.conf.unset(key)


def run(spark, df, tmp_path, mode="append"):
    """All rows that a stream gives."""
    name = f"s{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_epoch_points_and_single_rewards(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(minutes=7 * i), f"h{i % 3}", 1, f"i{i // 2}") for i in range(200)]
    df = spark.createDataFrame(rows, "at timestamp, hotkey string, amount long, item_id string")
    df.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = {(r.epoch, r.hotkey): r.amount for r in run(spark, epochs.epoch_points(stream()), tmp_path / "a")}
    batch = df.groupBy(F.floor(F.unix_seconds("at") / 1200).alias("epoch"), "hotkey").agg(F.sum("amount").alias("amount"))
    full = {(r.epoch, r.hotkey): r.amount for r in batch.collect()}
    assert got and all(full[k] == v for k, v in got.items())
    # what isn't past the watermark yet is held back
    late = max(e for e, _ in full)
    assert {k for k in full if k[0] <= late - 4} <= got.keys() and not any(e >= late - 1 for e, _ in got)
    once = run(spark, epochs.deduplicated(stream()), tmp_path / "b")
    assert sorted(r.item_id for r in once) == sorted({r[3] for r in rows})


def test_sequences(spark, tmp_path):
    sent = [("s", 1, 5, True), ("s", 2, 5, True), ("s", 3, 6, False), ("s", 4, 6, True), ("t", 5, 900, True), ("t", 6, 50, True), ("t", 7, 40, True)]
    df = spark.createDataFrame(sent, "sender string, arrival long, seq long, positive boolean")
    df.write.parquet(f"{tmp_path}/in")
    batch = df.withColumn("uid_values", F.create_map(F.lit(1), F.when(F.col("positive"), 1).otherwise(0).cast("long")))
    for resets, reference in ((False, consensus.sequenced), (True, consensus.sequenced_with_reset)):
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        got = run(spark, processors.with_state(stream, "sender", processors.SequenceProcessor(resets)), tmp_path / str(resets))
        assert {(r.arrival, r.reason) for r in got} == {(r.arrival, r.reason) for r in reference(batch).collect()}


def test_lifecycle_and_cooldown(spark, tmp_path):
    t = datetime(2024, 1, 1)
    events = [("a", 1, "process", "w"), ("a", 2, "done", None), ("a", 3, "done", None), ("b", 1, "process", "w"), ("b", 2, "reset", None), ("c", 1, "process", "x")]
    df = spark.createDataFrame([(*e, t) for e in events], "item_id string, seq long, event string, hotkey string, at timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = {r.item_id: (r.status, r.reward) for r in run(spark, processors.with_state(stream, "item_id", processors.LifecycleProcessor(event_time=True)), tmp_path / "a")}
    assert got == {"a": ("Processed", 1), "b": ("Unprocessed", 0), "c": ("Processing", 0)}
    runs = [("f", t + timedelta(seconds=i), i, i == 3) for i in range(15)] + [("g", t, 99, True)]
    df = spark.createDataFrame(runs, "hotkey string, at timestamp, event_id long, ok boolean")
    df.write.parquet(f"{tmp_path}/in2")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in2")
    got = run(spark, processors.with_state(stream, "hotkey", processors.CooldownProcessor(), "Update"), tmp_path / "b", "update")
    expected = dispatch.cooldowns(df).collect()
    assert [(r.hotkey, r.failures, r.level, r.until) for r in got] == [(r.hotkey, r.failures, r.level, r.until) for r in expected]
