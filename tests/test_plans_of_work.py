"""Dispatch under capacities, frames of sampled messages, tables that are replaced while read, and late rows."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalmill.operators import consensus, dispatch, ledger, lifecycle, validation
from signalmill.operators.ranges import intervals, numbered, within
from signalmill.operators.validation import seeded_order
from signalmill.session import SETTINGS
from signalmill.sources import readers
from signalmill.sources.registries import Entry
from signalmill.streaming import epochs, processors, sink
from signalmill.tables import TableChanged, VersionedTable

T0 = datetime(2024, 1, 1)
STATUS = "item_id string, arrived long"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, SETTINGS[key])
    yield
    spark.conf.unset(key)


def test_intervals_and_places(spark):
    rng = random.Random(4)
    rows = [(f"r{k}", rng.randrange(50), rng.randrange(5)) for k in range(500)]
    df = spark.createDataFrame(rows, "name string, k long, n long").repartition(7)
    got = {r.name: (r.start, r.end) for r in intervals(df, F.col("n"), "k", "name").collect()}
    at, spans = 0, {}
    for name, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        spans[name] = (at, at + n)
        at += n
    assert got == spans
    assert sorted((r.ordinal, r.name) for r in numbered(df, "k", "name").collect()) == [(i, r[0]) for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))]
    points = spark.createDataFrame([(p,) for p in range(-3, at + 3)], "p long")
    held = within(points, "p", intervals(df, F.col("n"), "k", "name"), 4)
    assert sorted((r.p, r.name) for r in held.collect()) == [(p, name) for name, (a, b) in sorted(spans.items(), key=lambda x: x[1]) for p in range(a, b)]
    assert intervals(df.limit(0), F.col("n"), "k", "name").collect() == []


def _loop(items, workers, busy, cool, barred, me, each, pending):
    """Batches in order of arrival, each to the first worker of the shuffle that has a slot left."""
    import hashlib

    free = {}
    for w in sorted(workers, key=lambda w: (hashlib.md5(f"s{w}".encode()).hexdigest(), w)):
        slots = min(each, dispatch.MAX_IN_FLIGHT - busy.get(w, 0))
        if w != me and w not in cool and w not in barred and slots > 0:
            free[w] = slots
    out = {}
    ordered = sorted(items, key=lambda i: (i[1], i[0]))
    for b in range(-(-len(ordered) // 3)):
        worker = next((w for w in free if free[w]), None) if pending is None or b < pending else None
        if worker:
            free[worker] -= 1
        for i, _ in ordered[3 * b : 3 * b + 3]:
            out[i] = (b, worker)
    return out


@pytest.mark.parametrize(("n_items", "each", "pending"), [(100, 1, 256), (100, 4, None), (7, 4, 2), (400, 3, 50)])
def test_dispatch_plan_against_a_loop(spark, n_items, each, pending):
    rng = random.Random(n_items)
    items = [(f"i{k}", rng.randrange(30)) for k in range(n_items)]
    workers = [f"w{k}" for k in range(25)]
    busy = {w: rng.randrange(6) for w in workers}
    cool, barred = {"w3", "w4"}, {"w5", "elsewhere"}
    runs = spark.createDataFrame([(w, T0 + timedelta(seconds=9)) for w in cool] + [("w6", T0 - timedelta(seconds=9)), ("w7", None)], "hotkey string, until timestamp")
    flight = spark.createDataFrame([(w, b) for w, n in busy.items() for b in range(n)], "hotkey string, batch long")
    plan = dispatch.planned(
        spark.createDataFrame(items, STATUS), spark.createDataFrame([(w,) for w in workers], "hotkey string"), flight, runs, F.lit(T0), "s", me="w1", barred=spark.createDataFrame([(b,) for b in barred], "hotkey string"), each=each, pending=pending
    )
    rows = plan.collect()
    assert {r.item_id: (r.batch, r.hotkey) for r in rows} == _loop(items, workers, busy, cool, barred, "w1", each, pending)
    given = {}
    for r in rows:
        if r.hotkey:
            given.setdefault(r.hotkey, set()).add(r.batch)
    assert all(busy[w] + len(b) <= dispatch.MAX_IN_FLIGHT and len(b) <= each and w not in cool | barred | {"w1"} for w, b in given.items())


def test_outcome_of_a_plan(spark):
    plan = spark.createDataFrame([("a", 0, "w0"), ("b", 0, "w0"), ("c", 1, "w1"), ("d", 2, "w2"), ("e", 3, "w3"), ("f", 4, None)], "item_id string, batch long, hotkey string")
    replies = spark.createDataFrame([(0, 200), (1, 503), (3, 200), (4, 200)], "batch long, code int")
    full = spark.createDataFrame([("w3",), ("w3",)], "hotkey string")
    items, events = dispatch.delivered(plan, replies, F.lit(T0), full)
    assert sorted((r.item_id, r.status, r.hotkey, r.start_time) for r in items.collect()) == [
        ("a", "Processing", "w0", T0), ("b", "Processing", "w0", T0), ("c", "Unprocessed", "w1", None), ("d", "Unprocessed", "w2", None), ("e", "Unprocessed", None, None), ("f", "Unprocessed", None, None),
    ]
    assert sorted((r.hotkey, r.ok) for r in events.collect()) == [("w0", True), ("w1", False), ("w2", False)]
    assert {r.hotkey: r.failures for r in dispatch.cooldowns(events).collect()} == {"w1": 1, "w2": 1}


def test_frames_and_recomputed_chat(spark):
    said = ["der erste", "und dann", "this one", "nothing here", "with that"]
    rows = [(0, c, t, f"u{t}", f"{said[t]} {c}", None if t else 5) for c in range(3) for t in range(5)]
    messages = spark.createDataFrame(rows, "batch long, conversation long, order long, user string, content string, inherited_asset_id long")
    picked = messages.where("order in (0, 1, 4)").select("conversation", "order")
    got = {(r.conversation, r.order): [m.content for m in r.context] for r in validation.frames(messages, picked, "conversation", "order").collect()}
    assert got == {(c, t): [f"{said[k]} {c}" for k in range(max(0, t - 2), t)] for c in range(3) for t in (0, 1, 4)}
    registry = (Entry(1, "DER", "d", ("der",)), Entry(2, "THIS", "t", ("this",)), Entry(9, "NO", "none"))
    worker = F.struct(F.lit(2).cast("long").alias("asset_id"), F.lit("Neutral").alias("sentiment"), *[F.lit(v).alias(f) for f, v in zip(validation.LABELS[1:], ("other", "none", "other", "NONE"))])
    rows = validation.recomputed_chat(messages.withColumn("worker", worker), 15, "s", registry, registry[-1]).collect()
    # "this" stands in message 2, and before messages 3 and 4; the first message inherits asset 5
    assert {(r.order, r.reason is None) for r in rows} == {(0, False), (1, False), (2, False), (3, True), (4, True)}
    assert all(r.own.asset_id == {0: 5, 1: 1, 2: 1, 3: 2, 4: 2}[r.order] for r in rows)


def test_only_sampled_articles_are_classified(spark):
    rows = [(k // 10, k, f"T{k}" if k % 4 else None, "der" if k % 3 else "this", k) for k in range(200)]
    registry = (Entry(1, "DER", "d", ("der",)), Entry(2, "THIS", "t", ("this",)), Entry(9, "NO", "none"))
    a = spark.createDataFrame(rows, "batch long, id long, title string, content string, n long").withColumn("summary", F.lit(None).cast("string")).withColumn("worker", F.lit(None).cast("struct<sector_id: bigint, sentiment: string, content_type: string, technical_quality: string, market_analysis: string, impact_potential: string>"))
    picked = validation.recomputed_articles(a, 2, "s", registry, registry[-1])
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    # classified once, above the join with the sample
    assert picked.count() == 40 and plan.count("very_bearish") == 1 and plan.index("very_bearish") < plan.index("Join") < plan.index("row_number")
    assert {(r.title is None, r.own is None) for r in picked.collect()} == {(True, True), (False, False)}
    assert all(r.preview == (r.title or "")[:100] and r.reason == "missing_miner_classification" for r in picked.collect())


def test_table_is_replaced_while_it_is_read(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k long, v long")
    assert table.read().collect() == [] and table.marks() == {}
    table.replace(spark.createDataFrame([(1, 1), (2, 2)], "k long, v long"), by="first")
    for _ in range(4):
        readers.save_state(readers.state(spark, f"file://{tmp_path}/t", table.schema).withColumn("v", F.col("v") * 2), f"file://{tmp_path}/t")
    assert sorted(map(tuple, table.read().collect())) == [(1, 16), (2, 32)] and table.version() == 5
    folders = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("rows-")]
    assert len(folders) == 2 and table.read(4).count() == 2


def test_a_kill_before_the_switch_leaves_the_old_table(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k long")
    table.replace(spark.range(3).withColumnRenamed("id", "k"))
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_switch", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.replace(spark.range(9).withColumnRenamed("id", "k"))
    assert table.read().count() == 3 and table.version() == 1
    with monkeypatch.context() as m:  # another writer takes the number first
        m.setattr(VersionedTable, "version", lambda self: 0)
        with pytest.raises(TableChanged):
            table.replace(spark.range(9).withColumnRenamed("id", "k"))
    assert table.read().count() == 3


def test_state_files_of_json(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"block_length": 100, "epoch_rewards": {"12": {"a": 3, "b": 1}, "-1": {"c": 2}, "x": {"d": 9}, "13": {}}}, indent=2))
    assert sorted(map(tuple, readers.ledger_from_json(spark, str(tmp_path / "r.json")).collect())) == [(-1, "c", 2), (12, "a", 3), (12, "b", 1)]
    (tmp_path / "i.json").write_text(json.dumps({"tweets": {"7": {"status": "Processing", "start_time": 1.5, "hotkey": "h", "submitted": True}, "8": {"status": "Unprocessed"}}}))
    rows = readers.items_from_json(spark, str(tmp_path / "i.json"), "tweets").orderBy("item_id").collect()
    assert [(r.item_id, r.status, r.hotkey, r.submitted, r.rewarded) for r in rows] == [("7", "Processing", "h", True, False), ("8", "Unprocessed", None, False, False)] and rows[0].start_time == datetime(1970, 1, 1, 0, 0, 1, 500000)


def test_rows_land_late_and_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(T0 + timedelta(seconds=rng.randrange(30 * 1200)), f"h{rng.randrange(4)}", 1) for _ in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "at timestamp, hotkey string, amount long")
    table = VersionedTable(spark, f"file://{tmp_path}/ledger", epochs.LEDGER)
    parts = [spark.createDataFrame(rows[k::5], df.schema) for k in range(5)]
    land = epochs.landing(table, "s")
    for k, part in enumerate(parts):
        land(part, k)
    land(parts[4], 4)  # played again
    land(parts[2], 2)
    sums = ledger.accumulated(df.select(ledger.epoch(ledger.block(F.col("at"))).alias("epoch"), "hotkey", "amount"))
    key = lambda d: sorted((r.epoch, r.hotkey, r.amount) for r in d.collect())
    assert key(table.read()) == key(ledger.retained(sums)) and table.marks() == {"s": 4}
    epochs.landing(table, "other")(parts[0], 0)
    assert table.marks() == {"s": 4, "other": 0}


def _lifecycle_events():
    rng = random.Random(11)
    out, seq = [], 0
    for _ in range(400):
        seq += 1
        event = rng.choice(["add", "process", "process", "result", "done", "reset", "delete"])
        out.append((f"i{rng.randrange(40)}", seq, event, T0 + timedelta(seconds=seq * 10), rng.choice(["w1", "w2", None]) if event in ("add", "process") else None))
    return out


def test_lifecycle_stream_is_the_batch(spark, tmp_path):
    df = spark.createDataFrame(_lifecycle_events(), "item_id string, seq long, event string, at timestamp, hotkey string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = sink.drained(processors.with_state(stream, "item_id", processors.LifecycleProcessor(event_time=True), delay="100 seconds"), "lifecycle")
    last = {r.item_id: (r.s.status, r.s.hotkey, r.penalty) for r in out.groupBy("item_id").agg(F.max_by(F.struct("status", "hotkey"), "version").alias("s"), F.max("penalty").alias("penalty")).collect()}
    now = F.lit(T0 + timedelta(seconds=400 * 10 - 100))
    state, fined = lifecycle.requeued(lifecycle.current(df), now)
    state = {r.item_id: (r.status, r.hotkey) for r in state.collect()}
    deleted = set(last) - set(state)  # forgotten by the batch, new to the stream
    assert all(last[i][:2] == ("Unprocessed", None) for i in deleted)
    assert {i: v[:2] for i, v in last.items() if i not in deleted} == state
    penalties = {}
    for _, hotkey, n in last.values():
        if n:
            penalties[hotkey] = penalties.get(hotkey, 0) + n
    assert penalties == {r.hotkey: r.penalty for r in fined.collect()} and penalties


def test_a_late_result_is_no_delivery(spark):
    rows = [("a", 1, "process", T0, "w"), ("a", 2, "reset", T0, None), ("a", 3, "result", T0 + timedelta(seconds=5), None), ("b", 1, "process", T0, "w"), ("b", 2, "result", T0 + timedelta(seconds=5), None)]
    df = spark.createDataFrame(rows, "item_id string, seq long, event string, at timestamp, hotkey string")
    assert {r.item_id: r.start_time for r in lifecycle.current(df).collect()} == {"a": None, "b": T0 + timedelta(seconds=5)}


def test_null_numbers_are_refused_alike(spark, tmp_path):
    sent = [("s", 1, 5, True), ("s", 2, None, True), ("s", 3, 6, False), ("s", 4, None, False), ("s", 5, 7, True), ("t", 6, None, True)]
    df = spark.createDataFrame(sent, "sender string, arrival long, seq long, positive boolean")
    df.write.parquet(f"{tmp_path}/in")
    batch = df.withColumn("uid_values", F.create_map(F.lit(1), F.when(F.col("positive"), 1).otherwise(0).cast("long")))
    expected = [(1, "accepted"), (2, "missing_seq"), (3, "empty_payload"), (4, "missing_seq"), (5, "accepted"), (6, "missing_seq")]
    for resets, reference in ((False, consensus.sequenced), (True, consensus.sequenced_with_reset)):
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        got = sink.drained(processors.with_state(stream, "sender", processors.SequenceProcessor(resets)), "seq")
        assert sorted((r.arrival, r.reason) for r in got.collect()) == expected == sorted((r.arrival, r.reason) for r in reference(batch).collect())


def test_cooldowns_of_one_moment_follow_event_ids(spark, tmp_path):
    rows = [("f", T0, 12 - i, i == 3) for i in range(12)]
    df = spark.createDataFrame(rows, "hotkey string, at timestamp, event_id long, ok boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = processors.with_state(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "hotkey", processors.CooldownProcessor(), "Append")
    assert [(r.hotkey, r.failures) for r in sink.drained(out, "cool").collect()] == [(r.hotkey, r.failures) for r in dispatch.cooldowns(df).collect()] == [("f", 3)]


def test_a_query_that_polls(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    df.write.parquet(f"{tmp_path}/in")
    query = sink.started(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/out", 1)
    try:
        query.processAllAvailable()
        df.write.mode("append").parquet(f"{tmp_path}/in")
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 4


def test_listings_points_and_signed_messages(spark):
    from signalmill.functions import text

    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "hotkey string, points long")
    assert sorted(r.points for r in readers.listing(rows, "a").collect()) == [1, 3] and readers.listing(rows, limit=2).count() == 2
    kept = spark.createDataFrame([(1, "a", 5)], "epoch long, hotkey string, amount long")
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "epoch long, hotkey string")
    assert sorted(map(tuple, ledger.points_of(kept, keys).collect())) == [(1, "a", 5), (1, "b", 0), (2, "a", 0)]
    assert spark.range(1).select(text.auth_message("sign", F.lit(12.9))).first()[0] == "sign:12"


def test_shuffle_is_fixed(spark):
    df = spark.createDataFrame([("w1",), ("w2",)], "hotkey string")
    assert df.select(seeded_order("s", F.col("hotkey")).alias("o")).collect() == df.select(seeded_order("s", F.col("hotkey")).alias("o")).collect()
