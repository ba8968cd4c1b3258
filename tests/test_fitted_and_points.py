"""Fitted labels, raw messages, sentiment of a last message, batches that came back short, point operations and prices."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalmill.functions import classify, fitted, text
from signalmill.operators import ledger, lifecycle, validation
from signalmill.sources import readers
from signalmill.tables import VersionedTable

FOLDER = "/root/testdata/sf0.1"
WORKS = {"kind": ("ask", "tell"), "mood": ("up", "down", "flat")}


def examples(spark):
    rows = [("Why is it so? why", "ask", "flat")] * 3 + [("how Why, gains", "ask", "up")] * 3 + [("It gains today", "tell", "up")] * 4 + [("it falls today", "tell", "down")] * 4
    return spark.createDataFrame([*rows, (None, "ask", "up"), ("why why", "shout", None), ("", None, None)], "body string, kind string, mood string")


def test_fitted_labels_are_naive_bayes(spark):
    import math
    import re

    model = fitted.fit(examples(spark), "body", WORKS, {"mood": "flat"}, least_texts=1)
    asked = [(1, "why"), (2, "TODAY it falls"), (3, ""), (4, None), (5, "unheard"), (6, "why"), (7, "gains " * 5000)]
    out = {r.id: r.labels for r in model.apply(spark.createDataFrame(asked, "id int, body string"), "body").collect()}
    told = [(set(re.findall(r"\w+", r.body.lower())), r) for r in examples(spark).collect() if r.body is not None]

    def best(words, d):
        scores = []
        for k, x in enumerate(WORKS[d]):
            of = [w for w, r in told if r[d] == x]
            all_ = [w for w, r in told if r[d] in WORKS[d]]
            rate = {w: sum(w in t for t in all_) / len(all_) for w in words}
            known = [w for w in words if rate[w]]
            scores.append((round(1000 * math.log(len(of))) + sum(round(1000 * math.log((sum(w in t for t in of) + 10 * rate[w]) / (len(of) + 10))) for w in known), -k, x))
        return max(scores)[2]

    for i, t in asked:
        if t is None:
            assert out[i] is None
        else:
            words = set(re.findall(r"\w+", t.lower()))
            assert (out[i].kind, out[i].mood) == (best(words, "kind"), best(words, "mood")), t
    assert len(out) == len(asked) and out[1] == out[6]


def test_fitted_without_examples_gives_defaults(spark):
    none = spark.createDataFrame([], "body string, " + ", ".join(f"{d} string" for d in classify.DIMENSIONS))
    model = fitted.fit(none, "body")
    rows = model.apply(spark.createDataFrame([("launch",), (None,)], "body string"), "body").collect()
    assert {r.body: r.labels and r.labels.asDict() for r in rows} == {"launch": classify.DEFAULTS, None: None}
    assert model.apply(none.select("body"), "body").count() == 0


def test_fitted_labels_held_out(spark):
    """Of what words tell, as languages and toxic texts; labels of quality go by symbols, capitals and repeats here, which words don't show."""
    d = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    d = d.withColumn("toxic", F.col("toxic").cast("string"))
    domains = {"lang": ("en", "de", "es", "fr"), "toxic": ("0", "1")}
    model = fitted.fit(d.where("doc_id % 4 <> 0"), "text", domains, {})
    out = model.apply(d.where("doc_id % 4 = 0"), "text")
    for x in domains:
        shares = {r[x]: r.share for r in out.groupBy(x).agg(F.avg((F.col(f"labels.{x}") == F.col(x)).cast("int")).alias("share")).collect()}
        assert set(shares) == set(domains[x]) and min(shares.values()) > (0.95 if x == "lang" else 0.8), shares


def test_plan_shuffles_no_text(spark):
    model = fitted.fit(examples(spark), "body", WORKS, {}, least_texts=1)
    found = model.apply(spark.range(10).select(F.col("id").cast("string").alias("body")), "body").select("labels")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_raw_messages(spark):
    raw = '[{"message_id":7,"username":"ann","content":"to the moon","reply_to":"3"},{"id":"8","from":"bob","text":"fine"},{"username":null,"from":"cy"},{}]'
    df = spark.createDataFrame([(1, raw), (2, "[]"), (3, None), (4, "no list")], "id int, raw string")
    out = {r.id: r for r in df.select("id", text.messages_from_json(F.col("raw")).alias("m"), classify.last_message_sentiment(text.messages_from_json(F.col("raw"))).alias("s")).collect()}
    assert [tuple(m) for m in out[1].m] == [("7", "ann", "to the moon", None, "3"), ("8", "bob", "fine", None, None), ("", "cy", "", None, None), ("", "unknown", "", None, None)]
    assert out[1].s == "very_bullish" and out[2].m == [] and out[2].s is None and out[3].m is None and out[3].s is None and not out[4].m


@pytest.mark.parametrize("said,expected", [(["crash", "gains"], "bullish"), (["crash", "well"], "very_bearish"), (["well", None], "neutral")])
def test_last_message_decides_then_context(spark, said, expected):
    df = spark.createDataFrame([([{"id": str(i), "user": "u", "content": c} for i, c in enumerate(said)],)], "m array<struct<id:string,user:string,content:string>>")
    assert df.select(classify.last_message_sentiment(F.col("m")).alias("s")).first().s == expected


def test_short_batches_fail_whatever_the_verdict(spark):
    sent = spark.createDataFrame([(b, f"{b}{i}", "h", False) for b in "abcd" for i in range(3)], "batch string, item_id string, hotkey string, rewarded boolean")
    returned = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)] * 4, "batch string")
    verdicts = spark.createDataFrame([("a", True), ("b", True), ("c", True)], "batch string, is_valid boolean")
    assert {r.batch: (r.n_sent, r.n_returned, r.whole) for r in validation.whole_batches(sent, returned).collect()} == {"a": (3, 3, True), "b": (3, 2, False), "c": (3, 4, False), "d": (3, 0, False)}
    out = validation.handled(sent, returned, verdicts).collect()
    assert {(r.item_id[0], r.status) for r in out} == {("a", "Processed"), ("b", "Unprocessed"), ("c", "Unprocessed"), ("d", "Unprocessed")}
    assert {x: (sum(r.reward for r in out if r.item_id[0] == x), sum(r.penalty for r in out if r.item_id[0] == x)) for x in "abcd"} == {"a": (3, 0), "b": (0, 1), "c": (0, 1), "d": (0, 1)}


def test_point_operations(spark):
    items = spark.createDataFrame([("1", "Processed", None, "h", False, True), ("2", "Unprocessed", None, None, False, False)], "item_id string, status string, start_time timestamp, hotkey string, submitted boolean, rewarded boolean")
    ids = spark.createDataFrame([("1",), ("3",), ("1",)], "item_id string")
    assert {r.item_id: (r.status, r.is_rewarded) for r in lifecycle.looked_up(items, ids).collect()} == {"1": ("Processed", True), "3": (None, False)}
    assert sorted((r.item_id, r.submitted, r.rewarded) for r in lifecycle.submitted(items, ids).collect()) == [("1", True, True), ("2", False, False)]
    assert [r.item_id for r in lifecycle.deleted(items, ids).collect()] == ["2"]
    assert [r.item_id for r in lifecycle.deleted(items, where=F.col("hotkey") == "h").collect()] == ["2"]
    assert lifecycle.marked(items.limit(0), ids, status=F.lit("x")).count() == 0


def test_listings_points_and_auth(spark):
    rows = spark.createDataFrame([(f"h{i % 2}", i) for i in range(250)], "hotkey string, points int")
    assert readers.listing(rows).count() == 100 and readers.listing(rows, "h1", 200).count() == 125
    assert {r.hotkey for r in readers.listing(rows, "h1").collect()} == {"h1"} and readers.listing(rows, "none").count() == 0
    book = spark.createDataFrame([(1, "a", 5)], "epoch long, hotkey string, amount long")
    keys = spark.createDataFrame([(1, "a"), (2, "a")], "epoch long, hotkey string")
    assert sorted(map(tuple, ledger.points_of(book, keys).collect())) == [(1, "a", 5), (2, "a", 0)]
    assert spark.range(1).select(text.auth_message("prefix", F.lit(12.9)).alias("m")).first().m == "prefix:12"


def test_prices_are_fetched_when_stale(spark, tmp_path):
    cache = VersionedTable(spark, f"file://{tmp_path}/price", readers.QUOTE)
    start, waits, asked = datetime(2024, 1, 1), [], []

    def source(*answers):
        left = list(answers)

        def fetch():
            asked.append(1)
            answer = left.pop(0)
            if isinstance(answer, Exception):
                raise answer
            return answer

        return fetch

    down = OSError("down")
    with pytest.raises(OSError):
        readers.fetched_price(source(down, down, down), cache, start, waits.append)
    assert waits == [2, 5] and len(asked) == 3
    assert readers.fetched_price(source(down, 4.5), cache, start, waits.append).first().price == 4.5
    assert waits == [2, 5, 2]
    assert readers.fetched_price(source(9.0), cache, start + timedelta(seconds=299), waits.append).first().price == 4.5
    assert len(asked) == 5  # fresh, so not asked
    assert readers.fetched_price(source(down), cache, start + timedelta(seconds=301), waits.append).first().price == 4.5
    assert readers.fetched_price(source(9.0), cache, start + timedelta(seconds=301), waits.append).first().price == 9.0
    assert waits == [2, 5, 2] and cache.read().count() == 1
