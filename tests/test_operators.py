"""Hand-computed cases, and operators that no driver-table query covers."""

import json
import urllib.error
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalmill import schemas
from signalmill.functions import classify, matching, scoring, text
from signalmill.functions.scoring import Economy
from signalmill.operators import consensus, dispatch, ledger, lifecycle, validation, votes, weights
from signalmill.sources import readers, rest
from signalmill.sources.registries import ASSETS, NO_ASSET, OTHER_SECTOR, SECTORS, Entry, credibility, read_registry, with_entry


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text(spark):
    r = one(spark, text.norm_text(F.lit("Hello\r\n  World  ")), text.norm_text(F.lit("é x\x1cy")), text.norm_text(F.lit(None).cast("string")), text.norm_author(F.lit("  @Bob\n")))
    assert tuple(r) == ("Hello World", "é x y", "", "@bob")
    r = one(spark, text.article_text(F.lit("T"), F.lit(""), F.lit("c" * 4000)), text.listed(F.lit(" a, ,b,")), text.version_parts(F.lit("1.10.2")) > text.version_parts(F.lit("1.9.9")))
    assert r[0] == "T\n\n" + "c" * 3000 and r[1] == ["a", "b"] and r[2]
    r = one(spark, text.normalised_keys(F.create_map(F.lit(" A"), F.lit(1.0), F.lit("a "), F.lit(2.0))), text.registry_line(F.lit("S"), F.lit(1), F.lit("N"), F.lit("d"), F.array(F.lit("x"), F.lit("y"))), text.display_name(F.lit(""), F.lit("n")))
    assert r[0] == {"a": 2.0} and r[1] == "S (id=1, N): d | IDs: x, y" and r[2] == "n"


@pytest.mark.parametrize(
    ("t", "expected"),
    [
        ("$BTC and solana", (1, "high", ["$BTC"])),
        ("solana ethereum", (2, "medium", ["ethereum"])),
        ("sol", (0, "low", [])),
        ("SOL", (3, "medium", ["SOL"])),
        ("éeth x", (0, "low", [])),
        ("bitcoin and BTC", (1, "high", ["bitcoin", "btc"])),
        ("$SOLANA", (3, "high", ["$SOL"])),
        ("erc-20!", (2, "medium", ["erc-20"])),
        (None, (0, "low", [])),
    ],
)
def test_match(spark, t, expected):
    m = one(spark, matching.match(F.lit(t).cast("string"), ASSETS, NO_ASSET).alias("m")).m
    assert (m.id, m.confidence, m.evidence) == expected


def test_registry(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps([{"id": 1, "symbol": "A", "name": "a", "unique_identifiers": ["aaa"], "cashtags": ["$A"]}, {"id": 2, "symbol": "B", "name": "b", "unique_identifiers": []}], indent=1))
    registry = read_registry(spark, str(path))
    assert registry == (Entry(1, "A", "a", ("aaa",), (), ("$A",)), Entry(2, "B", "b"))
    assert [e.id for e in with_entry(registry, Entry(1, "C", "c"))] == [2, 1]
    assert credibility(spark).count() == 77 and len(SECTORS) == 9


def test_scores(spark):
    now = datetime(2024, 1, 2)
    counts = dict(zip(scoring.CAPS, map(F.lit, (2500, 0, 300, 600, 0)), strict=True))
    at = lambda h: F.lit(now - timedelta(hours=h))
    r = one(spark, scoring.post_value(counts), *[scoring.recency(at(h), F.lit(now)) for h in (6, 24, -1)], scoring.clamp01(F.lit(None)), scoring.article_value(F.lit(1.0), F.lit("x")), scoring.article_value(F.lit(0.5), F.lit("")), scoring.total_score(F.lit(True), F.lit(1.0), at(12), F.lit(now)), scoring.total_score(F.lit(True), F.lit(1.0), at(241), F.lit(now)))
    assert [round(x, 9) for x in r] == [0.5, 0.75, 0.0, 1.0, 0.0, 1.0, 0.5, 0.95, 0.0]
    assert tuple(one(spark, *[scoring.article_weight(F.lit("x" * n)) for n in (499, 500, 2000)], scoring.tempo(F.lit(None).cast("int")), scoring.doubled(F.lit(2), F.lit(4)))) == (1, 2, 3, 360, 1.0)


def test_classify(spark):
    posts = spark.createDataFrame([("Announcing v1.2.0 of the btc api, latency 20 ms",), ("",), (None,)], "t string")
    rows = [r.c for r in posts.select(classify.classify_post(F.col("t"), ASSETS, NO_ASSET).alias("c")).collect()]
    assert (rows[0].id, rows[0].content_type, rows[0].technical_quality) == (1, "announcement", "high") and rows[1] is None and rows[2] is None
    a = one(spark, classify.classify_article(F.lit("Quarterly earnings"), F.lit(None).cast("string"), F.lit("gpu"), SECTORS, OTHER_SECTOR).alias("c")).c
    assert a.content_type == "earnings" and a.symbol == "EQUITIES"
    bad = F.struct(*[F.lit("x").alias(d) for d in classify.DIMENSIONS])
    assert one(spark, classify.valid_labels(bad).alias("v"), classify.valid_labels(classify.rule_labels(F.lit("gm"))).alias("w")).v is None
    group = F.array(F.struct(F.lit(1).alias("id"), F.lit("u").alias("user"), F.lit("hello").alias("content")))
    assert one(spark, classify.classify_group(group, F.lit(7), ASSETS, NO_ASSET).alias("g")).g.symbol == "ASSET_7"
    done = one(spark, classify.complete(classify.classify_post(F.lit("btc crash"), ASSETS, NO_ASSET)).alias("d")).d
    assert done.sentiment == -1.0 and done.asset_relevance == {"BTC": 1.0}


def test_model_is_asked_for_distinct_texts(spark):
    def make():
        return lambda texts: pd.DataFrame({d: texts.str.upper() for d in classify.DIMENSIONS})

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, t string")
    out = {r.id: r.labels for r in classify.model_labels(df, "t", make).collect()}
    assert out[1].sentiment == out[2].sentiment == "A" and out[3] is None


def test_sequences_with_reset(spark):
    sent = [(1, 5, 1), (2, 5, 1), (3, 6, 0), (4, 6, 1), (5, 900, 1), (6, 50, 1), (7, 51, 1), (8, 40, 1)]
    df = spark.createDataFrame([("s", a, q, {1: v}) for a, q, v in sent], "sender string, arrival long, seq long, uid_values map<int,long>")
    plain = [r.reason for r in consensus.sequenced(df).orderBy("arrival").collect()]
    assert plain == ["accepted", "duplicate_or_old_seq", "empty_payload", "duplicate_or_old_seq", "accepted", *["duplicate_or_old_seq"] * 3]
    reset = [r.reason for r in consensus.sequenced_with_reset(df).orderBy("arrival").collect()]
    assert reset == [*plain[:5], "accepted", "accepted", "duplicate_or_old_seq"]


def test_quorum(spark):
    local = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "epoch long, uid int, value long")
    peers = spark.createDataFrame([(1, "a", 2, 1), (1, "a", 3, 1), (1, "b", 3, 4), (1, "b", 4, 0)], "epoch long, sender string, uid int, value long")
    assert {(r.uid, r.votes) for r in consensus.penalised(local, peers).collect()} == {(2, 2), (3, 2)}
    assert consensus.without_stale_scheme(peers, 0).count() == 0 and consensus.flushed(peers, 1).count() == 0


def test_weights(spark):
    economy = Economy(token_usd=0.0, subnet_price=1.0, emission=1.0, min_percent_per_point=1.0)
    people = spark.createDataFrame([(0, "burn"), (1, "a"), (2, "b")], "uid int, hotkey string")
    run = lambda rows: {r.uid: round(r.weight, 9) for r in weights.point_weights(spark.createDataFrame(rows, "hotkey string, reward long"), people, economy).collect()}
    assert run([("a", 60), ("b", 90)]) == {0: 0.0, 1: 0.4, 2: 0.6}
    assert run([("a", 10), ("gone", 20)]) == {0: 0.7, 1: 0.1, 2: 0.0}
    assert run([("gone", 20)]) == {0: 0.8, 1: 0.0, 2: 0.0}
    w = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.0)], "uid int, weight double")
    assert {r.uid: r.value for r in weights.emitted(w).collect()} == {0: 65535, 1: 32768}
    few = {r.uid: round(r.weight, 9) for r in weights.processed(w, min_allowed=5, max_limit=1.0).collect()}
    assert few == {0: round(1 / 3, 9), 1: round(1 / 3, 9), 2: round(1 / 3, 9)}
    assert {r.uid for r in weights.processed(w, min_allowed=1, max_limit=1.0, quantile=1.0).collect()} == {0}
    assert {r.uid for r in weights.processed(w, min_allowed=3, max_limit=1.0).collect()} == {0, 1, 2}
    with pytest.raises(Exception, match="negative weight"):
        weights.emitted(spark.createDataFrame([(0, -1.0)], "uid int, weight double")).collect()
    nan = spark.createDataFrame([(0, float("nan")), (1, None), (2, 3.0)], "uid int, score double")
    assert [r.raw for r in weights.l1_normalised(weights.updated_scores(nan)).orderBy("uid").collect()] == [0.0, 0.0, 1.0]


def test_capped_share_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    for limit in (0.1, 0.2, 0.01):
        x = rng.random(20) ** 3
        got = np.array([r.capped for r in weights.capped_share(spark.createDataFrame(list(enumerate(map(float, x))), "uid int, weight double"), limit).orderBy("uid").collect()])
        assert abs(got.sum() - 1) < 1e-9 and (got.max() <= limit + 1e-6 or len(x) * limit <= 1)


def test_lifecycle(spark):
    t = datetime(2024, 1, 1)
    events = [("a", 1, "add", None), ("a", 2, "process", "w1"), ("a", 3, "result", None), ("a", 4, "done", None), ("a", 5, "submitted", None), ("b", 1, "process", "w2"), ("b", 2, "reset", None), ("c", 1, "process", "w"), ("c", 2, "delete", None), ("c", 3, "add", None)]
    df = spark.createDataFrame([(i, s, e, t + timedelta(seconds=s), h) for i, s, e, h in events], "item_id string, seq long, event string, at timestamp, hotkey string")
    now = {r.item_id: r for r in lifecycle.current(df).collect()}
    assert (now["a"].status, now["a"].start_time, now["a"].submitted, now["a"].hotkey) == ("Processed", t + timedelta(seconds=3), True, "w1")
    assert (now["b"].status, now["b"].start_time, now["b"].hotkey) == ("Unprocessed", None, "w2") and now["c"].hotkey is None
    signals = spark.createDataFrame([("x",), ("x",), ("y",)], "signal_id string")
    assert [r.signal_id for r in lifecycle.new_signals(signals, spark.createDataFrame([("y",)], "signal_id string")).collect()] == ["x"]


def test_dispatch(spark):
    flights = spark.createDataFrame([("a",)] * 4 + [("b",)], "hotkey string")
    workers = spark.createDataFrame([("a",), ("b",), ("c",)], "hotkey string")
    assert {r.hotkey for r in dispatch.with_room(workers, flights).collect()} == {"b", "c"}
    assert [one(spark, dispatch.poll_backoff(F.lit(n)))[0] for n in (0, 3, 20)] == [1.0, 8.0, 300.0]
    t = datetime(2024, 1, 1)
    runs = spark.createDataFrame([("a", t + timedelta(seconds=i), i, False) for i in range(11)] + [("b", t, 99, True)], "hotkey string, at timestamp, event_id long, ok boolean")
    c = dispatch.cooldowns(runs)
    assert [(r.hotkey, r.failures, r.level, r.until) for r in c.collect()] == [("a", 11, 2, t + timedelta(seconds=70))]
    assert tuple(dispatch.cooldown_stats(c, F.lit(t)).first()) == (1, 1) and dispatch.cooling(c, F.lit(t + timedelta(seconds=71))).isEmpty()


def test_votes(spark):
    rows = [("v1", 1, '{"miner_uid":7,"score":1}'), ("v2", 2, '{"scores":{"7":0,"8":1}}'), ("v3", 3, '{"miner_uid":7,"score":1}'), ("v4", 4, "junk")]
    c = spark.createDataFrame(rows, "hotkey string, block long, data string")
    got = {r.uid: (r.yes, r.no, round(r.weight, 6)) for r in votes.tallied(votes.votes(c)).collect()}
    assert got == {7: (2, 1, 0.666667), 8: (1, 0, 1.0)}
    seen = spark.createDataFrame([("v1", 1)], "hotkey string, block long")
    assert {(r.hotkey, r.action) for r in votes.changed(c, seen).collect()} == {("v2", "PENALIZE"), ("v3", "REWARD"), ("v4", "PENALIZE")}
    assert {(r.hotkey, r.block) for r in votes.seen_after(c.where("block > 1"), seen).collect()} == {("v1", 1), ("v2", 2), ("v3", 3), ("v4", 4)}


def test_readers_and_sinks(spark, tmp_path):
    path = tmp_path / "posts.json"
    path.write_text("\n".join(json.dumps(x) for x in ({"id": 2, "text": "b", "likeCount": 5}, {"id": 1, "text": "a", "like_count": 7, "createdAt": "2024-01-01T00:00:00Z"}, {"id": 3})))
    rows = readers.leased(spark, str(path), "post", limit=2).collect()
    assert [(r.id, r.like_count, r.quote_count, r.is_reply) for r in rows] == [(1, 7, 0, False), (2, 5, 0, False)] and rows[0].created_at.startswith("2024")
    assert readers.state(spark, str(tmp_path / "none"), schemas.LEDGER).count() == 0
    table = spark.createDataFrame([(1, "a", 2, "reward")], schemas.LEDGER)
    readers.save_state(table, str(tmp_path / "state"))
    assert readers.state(spark, str(tmp_path / "state"), schemas.LEDGER).count() == 1
    assert readers.submit_once(table, str(tmp_path / "out"), 4) and not readers.submit_once(table, str(tmp_path / "out"), 4)
    got = {r.key: r.value for r in readers.settings({"a": "1", "b": "2", "c": "3"}, {"b": "20"}, {"c": "300"}, spark).collect()}
    assert got == {"a": "1", "b": "20", "c": "300"} and one(spark, readers.outdated(F.lit("1.9"), F.lit("1.10")))[0]
    quotes = spark.createDataFrame([(1.0, 1), (2.0, 2)], "price double, last_updated int")
    assert readers.with_price(spark.range(1), quotes).first().token_usd == 2.0
    values = spark.createDataFrame([("m", "n", 5)], "module string, name string, value long")
    assert spark.range(1).select(readers.stored_value(values, "m", "n"), readers.stored_value(values, "m", "x")).first()[:] == (5, 0)


def test_rest_retries_connections_only():
    waits, calls = [], []

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise urllib.error.URLError("down")
        import io

        return io.BytesIO(b'[{"id": 1}]')

    assert rest.fetched("http://x", {}, opener=opener, wait=waits.append) == [{"id": 1}] and waits == [1.0, 2.0]

    def refusing(request, timeout):
        raise urllib.error.HTTPError("u", 403, "no", None, None)

    with pytest.raises(rest.ApiError, match="not allowed"):
        rest.fetched("http://x", {}, opener=refusing, wait=waits.append)
    assert waits == [1.0, 2.0]


def test_grading_and_tokens(spark):
    base = {"hotkey": "h", "tokens": {"btc": 1.0}, "own_tokens": {"btc": 1.0}, "sentiment": 0.0, "own_sentiment": 0.0}
    schema = "hotkey string, post_index int, post_id string, content string, tokens map<string,double>, own_tokens map<string,double>, sentiment double, own_sentiment double"
    cases = [({}, None), ({"post_id": ""}, "missing_post_id"), ({"content": " \n"}, "empty_content"), ({"own_tokens": None}, "analyzer_error"), ({"tokens": {"btc": 0.9}}, "tokens_mismatch"), ({"sentiment": 0.2}, "sentiment_mismatch")]
    rows = []
    for k, (change, _) in enumerate(cases):
        rows.append({**base, "hotkey": f"h{k}", "post_index": 0, "post_id": "p", "content": "x", **change})
    out = {r.hotkey: r for r in validation.graded(spark.createDataFrame(rows, schema)).collect()}
    for k, (_, code) in enumerate(cases):
        assert out[f"h{k}"].valid == (code is None) and (code is None or out[f"h{k}"].fault.code == code)
    many = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.struct(F.concat(F.lit("k"), i.cast("string")), i / 200)))
    assert one(spark, F.size(validation.selected_tokens(many, F.create_map(F.lit("own"), F.lit(1.0)))["worker"]))[0] == 128
    assert one(spark, ledger.epoch(ledger.block(F.lit(datetime(2024, 1, 1)))))[0] == 1704067200 // 1200
