"""Settings by time, read anew by every batch of a stream, and signals that act once."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from signalmill.operators.asof import in_force
from signalmill.sources import remote

START = datetime(2024, 1, 1)
DEFAULTS = {"USD_PRICE_PER_POINT": 0.04, "MINER_BATCH_SIZE": 3, "VALIDATION_FETCH_LIMIT": 24, "MIN_PERCENT_PER_POINT": 0.003}


@pytest.mark.parametrize("walk_rows", [3, 1 << 20])
def test_in_force_against_a_loop(spark, walk_rows):
    rng = random.Random(5)
    moment = lambda: START + timedelta(minutes=rng.randrange(600)) if rng.random() > 0.05 else None
    changes = [(moment(), i, rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for i in range(60)]
    rows = [(i, moment(), f"t{i}") for i in range(200)] + [(7, START, "twice")] * 2
    c = spark.createDataFrame(changes, "since timestamp, n int, a int, b string")
    r = spark.createDataFrame(rows, "bin int, at timestamp, walks string")  # names that are used inside
    got = in_force(r, c, "at", "since", ["a", "b"], ["n"], walk_rows=walk_rows)
    assert got.columns == ["bin", "at", "walks", "a", "b"]

    def at(moment, k):
        found = [(x[0], x[1], x[k]) for x in changes if x[0] and moment and x[0] <= moment and x[k] is not None]
        return max(found)[2] if found else None

    expected = [(i, t, w, at(t, 2), at(t, 3)) for i, t, w in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("bin_seconds", [60, 86400])
def test_changes_at_one_time(spark, bin_seconds):
    """Without an order each value's greatest counts, in the bin of the change and after it."""
    changes = spark.createDataFrame([(START, 1, "z"), (START, 2, "y"), (START, None, "x"), (None, 9, "zz")], "since timestamp, a int, b string")
    rows = spark.createDataFrame([(1, START), (2, START + timedelta(hours=2)), (3, START - timedelta(seconds=1))], "id int, at timestamp")
    got = in_force(rows, changes, "at", "since", ["a", "b"], bin_seconds=bin_seconds).select("id", "a", "b").orderBy("id").collect()
    assert list(map(tuple, got)) == [(1, 2, "z"), (2, 2, "z"), (3, None, None)]


def test_in_force_of_nothing(spark):
    rows = spark.createDataFrame([(1, START)], "id int, at timestamp")
    changes = spark.createDataFrame([], "since timestamp, a int")
    assert list(map(tuple, in_force(rows, changes, "at", "since", ["a"]).collect())) == [(1, START, None)]
    assert in_force(rows.withColumn("m", F.create_map("id", "id")), changes, "at", "since", ["a"]).first().m == {1: 1}
    assert in_force(rows.limit(0), changes, "at", "since", ["a"]).isEmpty()


def put(folder, name, **pull):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(pull))


def test_typed_settings(spark, tmp_path):
    put(tmp_path / "p", "1", pulled_at="2024-01-01T00:00:00", config={"MINER_BATCH_SIZE": 5, "USD_PRICE_PER_POINT": "0.1", "UNKNOWN": 1})
    put(tmp_path / "p", "2", pulled_at="2024-01-02T00:00:00", config={"MINER_BATCH_SIZE": "many", "VALIDATION_FETCH_LIMIT": "7"})
    put(tmp_path / "p", "3", config={"MINER_BATCH_SIZE": 99})
    (tmp_path / "p" / "4.json").write_text("no json")
    pulled = remote.pulls(spark, str(tmp_path / "p"))
    assert remote.settings(pulled).first().asDict() == DEFAULTS | {"MINER_BATCH_SIZE": 5, "USD_PRICE_PER_POINT": 0.1, "VALIDATION_FETCH_LIMIT": 7}
    early = remote.settings(pulled, F.lit("2024-01-01 12:00:00").cast("timestamp"), {"USD_PRICE_PER_POINT": "0.5", "MIN_PERCENT_PER_POINT": "none", "MINER_BATCH_SIZE": None})
    assert early.first().asDict() == DEFAULTS | {"MINER_BATCH_SIZE": 5, "USD_PRICE_PER_POINT": 0.5}
    assert remote.settings(pulled.limit(0)).first().asDict() == DEFAULTS
    rows = spark.createDataFrame([(1, datetime(2023, 1, 1)), (2, datetime(2024, 1, 1)), (3, datetime(2024, 1, 3)), (4, None)], "id int, at timestamp")
    got = remote.with_settings(rows, pulled, "at", ["MINER_BATCH_SIZE", "VALIDATION_FETCH_LIMIT"]).orderBy("id").collect()
    assert [tuple(r)[2:] for r in got] == [(3, 24), (5, 24), (5, 7), (3, 24)]


def test_a_stream_changes_its_limits_and_signals_act_once(spark, tmp_path):
    pulled, source, folder = tmp_path / "p", tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    seen = []

    def apply(rows, decision, batch):
        kept = rows.join(decision.barred, rows.value == decision.barred.hotkey, "left_anti")
        signals = [(r.before_epoch, r.hotkeys, r.scores) for r in decision.signals.orderBy("signal").collect()]
        seen.append((batch, decision.settings["MINER_BATCH_SIZE"], sorted(r.value for r in kept.collect()), signals))

    def drain(version=None, **overrides):
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
        remote.governed(stream, str(pulled), folder, apply, overrides=overrides, version=version).trigger(availableNow=True).start().awaitTermination()

    put(pulled, "1", pulled_at="2024-01-01T00:00:00", config={"MINER_BATCH_SIZE": 5}, blacklisted_hotkeys=["b"], reset_broadcasts_before_epoch=4)
    (source / "1.txt").write_text("a\nb")
    drain()
    # the same signal again, a new one, another limit and list
    put(pulled, "2", pulled_at="2024-01-02T00:00:00", config={"MINER_BATCH_SIZE": 6}, reset_broadcasts_before_epoch=4)
    put(pulled, "3", pulled_at="2024-01-03T00:00:00", blacklisted_hotkeys=["a"], purge_broadcast_hotkeys=["z", "y", "z"], reset_scores_id="s1", min_validator_version="1.10.0")
    (source / "2.txt").write_text("a\nb")
    drain(version="1.10.0")
    (source / "3.txt").write_text("a\nc")
    with pytest.raises(StreamingQueryException, match="1.9.9 is below 1.10.0"):
        drain(version="1.9.9")
    drain(version="2.0", MINER_BATCH_SIZE="9", BLACKLISTED_HOTKEYS=" c ,")
    expected = [(0, 5, ["a"], [(4, [], False)]), (1, 6, ["b"], [(-1, ["y", "z"], True)]), (2, 9, ["a"], [])]
    assert seen == expected
    # the last commit is lost, and something else is pulled meanwhile: the batch is played as it was
    commits = sorted((p for p in (tmp_path / "out" / "state" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        if p.exists():
            p.unlink()
    put(pulled, "4", pulled_at="2024-01-04T00:00:00", config={"MINER_BATCH_SIZE": 1}, reset_scores_id="s2")
    drain(MINER_BATCH_SIZE="9", BLACKLISTED_HOTKEYS="c")
    assert seen == [*expected, expected[-1]]
    (source / "4.txt").write_text("d")
    drain()
    assert seen[-1] == (3, 1, ["d"], [(-1, [], True)])
