"""Envelopes of all kinds through a stream that is stopped, started again and played again."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalmill.operators import consensus
from signalmill.streaming import ingest

BODIES = {
    "posts": {"items": [{"id": 1, "text": "a", "author": {"id": 5, "followers_count": 3}}, {"id": 2}]},
    "chat": {"items": [{"id": "m", "content": "hello", "context_messages": [{"id": "c", "content": "before"}]}]},
    "articles": {"items": []},
    "rewards": {"epoch": 3, "seq": 7, "uid_values": {"4": 2, "5": 0}},
    "penalties": {"epoch": 3, "seq": 1, "uid_values": {"9": 1}},
    "score": {"score": 0.5, "block_window_start": 1, "block_window_end": 2},
    "validation_result": {"validation_id": "v", "post_id": "p", "success": False, "failure_reason": {"code": "x"}},
    "is_alive": {"is_alive": True},
}


def line(kind, body, sender="s", **more):
    return json.dumps({"kind": kind, "sender": sender, "id": "1", "sent_at": "2024-01-01T00:00:00Z", "body": body} | more)


BAD = {
    "no object": ["", "{", "[1]", "7", "null", '"text"'],
    "unknown kind": [line("gossip", {}), json.dumps({"sender": "s", "body": {}}), line(None, {})],
    "no sender": [line("is_alive", {"is_alive": True}, sender=""), line("is_alive", {"is_alive": True}, sender=None)],
    "bad body": [line("rewards", {"epoch": 3, "seq": 7}), line("rewards", {"epoch": "soon", "seq": 7, "uid_values": {}}), line("posts", {"items": "none"}), line("posts", None), line("score", {"score": None}), json.dumps({"kind": "score", "sender": "s"})],
}


def drain(spark, folder, source):
    rows = spark.readStream.option("maxFilesPerTrigger", 1).text(source)
    ingest.pushed(rows, folder).trigger(availableNow=True).start().awaitTermination()


def test_all_kinds_restart_and_replay(spark, tmp_path):
    source, folder = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(line(k, b) for k, b in BODIES.items()))
    (source / "b.txt").write_text("\n".join(x for lines in BAD.values() for x in lines))
    drain(spark, folder, str(source))
    (source / "c.txt").write_text(line("rewards", {"epoch": 3, "seq": 8, "uid_values": {"4": 6}}) + "\n" + line("rewards", {"epoch": 3, "seq": 8, "uid_values": {"4": 9}}, sent_at="not a time"))
    drain(spark, folder, str(source))  # a restart: only the new file
    counts = {r.kind: r["count"] for r in ingest.received(spark, folder).groupBy("kind").count().collect()}
    assert counts == {k: 1 for k in BODIES} | {"rewards": 3, "refused": sum(map(len, BAD.values()))}
    assert {r.problem: r["count"] for r in ingest.refused(spark, folder).groupBy("problem").count().collect()} == {k: len(v) for k, v in BAD.items()}
    assert {r.raw for r in ingest.refused(spark, folder).collect()} == {x for v in BAD.values() for x in v}
    # the last batch's commit is lost: it is played again and changes nothing
    commits = sorted((p for p in (tmp_path / "out" / "state" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        if p.exists():
            p.unlink()
    drain(spark, folder, str(source))
    assert {r.kind: r["count"] for r in ingest.received(spark, folder).groupBy("kind").count().collect()} == counts
    posts = ingest.messages(spark, folder, "posts").select(F.explode("items").alias("p")).select("p.id", "p.text", "p.author.followers_count").collect()
    assert sorted((r.id, r.text, r.followers_count) for r in posts) == [(1, "a", 3), (2, None, None)]
    snapshot = ingest.messages(spark, folder, "rewards").withColumn("arrival", F.row_number().over(Window.orderBy("batch", "seq", F.col("sent_at").desc_nulls_last())))
    kept = consensus.sequenced(snapshot)
    assert sorted((r.seq, r.reason, dict(r.uid_values)) for r in kept.collect()) == [(7, "accepted", {4: 2}), (8, "accepted", {4: 6}), (8, "duplicate_or_old_seq", {4: 9})]
    alive = ingest.messages(spark, folder, "is_alive").first()
    assert alive.is_alive and alive.sender == "s" and ingest.messages(spark, folder, "validation_result").first().failure_reason == {"code": "x"}
