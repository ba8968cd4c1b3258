"""Annotations by kind, parents of replies, prices without quotes, and resets by a plain loop."""

import datetime

from pyspark.sql import functions as F

from signalmill.functions import text
from signalmill.operators import annotate, consensus, dispatch
from signalmill.sources import readers

CLASS = "struct<id:bigint,symbol:string,confidence:string,evidence:array<string>,content_type:string,sentiment:string,technical_quality:string,market_analysis:string,impact_potential:string>"


def test_annotations_by_kind(spark):
    one = (4, "SOL", "high", ["sol"], "news", "bullish", "low", "price", "HIGH")
    df = spark.createDataFrame([(1, one), (2, None)], f"item int, c {CLASS}")
    post = annotate.annotated(df, "c", "post").collect()
    assert [r.asDict(True) for r in post] == [{"item": 1, "analysis": {"sentiment": "bullish", "asset_id": 4, "asset_symbol": "SOL", "content_type": "news", "technical_quality": "low", "market_analysis": "price", "impact_potential": "HIGH"}}]
    at = datetime.datetime(2024, 1, 1)
    chat = annotate.annotated(df, "c", "chat", F.lit(at)).first().analysis
    assert (chat.id, chat.asset_id, chat.analyzed_at) == (0, 4, at) and "confidence" not in chat
    assert annotate.annotated(df, "c", "article").first().analysis.sector_symbol == "SOL"


def test_parent_of_a_reply(spark):
    df = spark.createDataFrame([(1, None, "a", "x"), (2, 1, "b", "y"), (3, 9, "c", "z")], "id int, reply_to int, user string, content string")
    out = {r.id: r.parent_message for r in text.with_parent(df).collect()}
    assert tuple(out[2]) == ("a", "x") and out[1] is None and out[3] is None


def test_price_without_quotes(spark):
    df = spark.range(3)
    quotes = spark.createDataFrame([(1.5, 10), (2.5, 20)], "price double, last_updated int")
    assert [r.token_usd for r in readers.with_price(df, quotes).collect()] == [2.5] * 3
    assert [r.token_usd for r in readers.with_price(df, quotes.limit(0)).collect()] == [None] * 3


def test_resets_by_a_plain_loop(spark):
    rows = [("a", i, s, {1: v}) for i, (s, v) in enumerate([(100, 1), (90, 1), (9, 1), (9, 2), (50, 0), (49, 1), (4, 1), (5, 1), (-1, 1)])] + [("b", 3, 7, {}), ("b", 2, 8, {2: 1}), ("c", 1, 0, {1: 5})]
    out = {(r.sender, r.arrival): r.reason for r in consensus.sequenced_with_reset(spark.createDataFrame(rows, "sender string, arrival bigint, seq bigint, uid_values map<int,bigint>")).collect()}
    old, full, none = "duplicate_or_old_seq", "accepted", "empty_payload"
    assert [out["a", i] for i in range(9)] == [full, old, full, old, none, old, full, full, full]
    assert (out["b", 2], out["b", 3], out["c", 1]) == (full, old, full)


def test_failures_since_the_last_success(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", at(i), i, i == 3) for i in range(15)] + [("b", at(1), 1, True)] + [("c", at(1), i, False) for i in range(9)]
    out = {r.hotkey: (r.failures, r.level, r.until) for r in dispatch.cooldowns(spark.createDataFrame(rows, "hotkey string, at timestamp, event_id int, ok boolean")).collect()}
    assert out == {"a": (11, 2, at(14 + 60)), "c": (9, 0, None)}
