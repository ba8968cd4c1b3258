"""Labels remembered across runs, and commitments read block by block over HTTP."""

import json
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalmill.functions import classify
from signalmill.sources.commitments import CommitmentSource, CommitmentStream
from signalmill.tables import VersionedTable

T0 = datetime(2024, 1, 1)


def model_of(folder):
    """A model that writes down what it is asked; it fails on texts with a question mark."""

    def make():
        import uuid

        def ask(texts: pd.Series) -> pd.DataFrame:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return pd.DataFrame([classify.DEFAULTS | {"sentiment": "unsure" if "?" in t else "neutral"} for t in texts])

        return ask

    return make


def asked(folder):
    out = sorted(x for p in folder.iterdir() for x in p.read_text().splitlines())
    for p in folder.iterdir():
        p.unlink()
    return out


def test_second_run_asks_for_unseen_and_expired_texts_only(spark, tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    memo = VersionedTable(spark, f"file://{tmp_path}/memo", classify.MEMO)

    def run(texts, seconds, model="m1"):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
        out = classify.remembered_labels(df, "text", model_of(str(folder)), memo, model, F.lit(T0 + timedelta(seconds=seconds)))
        return {r.k: r.labels and r.labels.sentiment for r in out.collect()}, asked(folder)

    assert run(["a", "b", "a", None, "c?"], 0) == ({0: "neutral", 1: "neutral", 2: "neutral", 3: None, 4: None}, ["a", "b", "c?"])
    labels, seen = run(["a", "b", "d", "c?"], 100)
    assert labels == {0: "neutral", 1: "neutral", 2: "neutral", 3: None} and seen == ["c?", "d"]  # what failed is asked again
    assert run(["a"], 200, "m2")[1] == ["a"]  # another version
    assert run(["a", "b", "d"], 299)[1] == []
    assert run(["a", "b", "d"], 300)[1] == ["a", "b"]  # expired since the first run
    assert memo.read().count() == 4  # d and a, b of m1, a of m2


class Chain(BaseHTTPRequestHandler):
    commits, head, asked = [], 0, []

    def do_GET(self):
        url = urlparse(self.path)
        rows = [{"block": self.head}]
        if url.path == "/commitments":
            after, upto = (int(parse_qs(url.query)[k][0]) for k in ("after", "upto"))
            self.asked.append((after, upto))
            rows = [c for c in self.commits if after < c["block"] <= upto]
        body = json.dumps(rows).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def chain():
    Chain.commits, Chain.head, Chain.asked = [], 0, []
    server = HTTPServer(("127.0.0.1", 0), Chain)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_restart_reads_later_blocks_only(spark, tmp_path, chain):
    spark.dataSource.register(CommitmentSource)
    Chain.commits[:] = [{"hotkey": f"h{b % 3}", "block": b, "data": f"d{b}"} for b in range(1, 400, 7)]

    def run(head):
        Chain.head = head
        Chain.asked.clear()
        stream = spark.readStream.format("commitments").option("url", chain).option("taskBlocks", "50").load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/rows")
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r.block for r in spark.read.parquet(f"{tmp_path}/rows").collect())

    assert run(120) == list(range(1, 121, 7)) and max(b for _, b in Chain.asked) == 120
    assert run(399) == list(range(1, 400, 7))
    assert min(a for a, _ in Chain.asked) >= 120 and all(b - a <= 50 for a, b in Chain.asked)


def test_offsets_are_bounded_and_never_fall(chain):
    Chain.head = 1000
    reader = CommitmentStream(None, {"url": chain, "batchBlocks": "300", "startBlock": "10"})
    assert [reader.latestOffset()["block"] for _ in range(5)] == [310, 610, 910, 1000, 1000]
    Chain.head = 900
    assert reader.latestOffset() == {"block": 1000} and reader.partitions({"block": 1000}, {"block": 1000}) == []
    assert [(p.after, p.upto) for p in reader.partitions({"block": 10}, {"block": 230})] == [(10, 110), (110, 210), (210, 230)]
