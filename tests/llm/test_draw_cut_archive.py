"""Operators 11, 12 and 13 against brute force on small, odd and adversarial tables."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalmill.llm import fill_in_middle as fim
from signalmill.llm import queries, resampling, warc

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "a", "ab", "<P>", "x<S", "S>", "\U0001f600ä́\n\r\0 end", "<" * 40, "a<P>b", "word " * 5000, "same", "same", "\U0001f600" * 700]


def fim_brute(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, a, b - a, sha(out), sha(text)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, f"clash {i}") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (None, None, "x"), (3, "other text of id 3", "y"), (11, "same", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, output string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("folder", ["sf", "odd"])
def test_op11(spark, odd, folder):
    folder = SF if folder == "sf" else odd
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = queries.op11_fill_in_middle(spark, folder)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(fim_brute(r.doc_id, r.text)) for r in rows)


def test_outputs_and_callers_columns(spark, odd):
    df = spark.read.parquet(f"{odd}/documents.parquet")
    out = fim.restored(fim.transformed(df))
    assert out.columns[:3] == df.columns and out.where("output like 'clash %'").count() == len(TEXTS)
    assert all(r["__fim_restored"] == (r.text or "") for r in out.collect())
    words = fim.Cut(seed=9, unit=r"\w+", rate=100, spm=50)
    pattern = fim.unit_pattern(words.unit)
    for r in fim.restored(fim.transformed(df, words), words).collect():
        text = r.text or ""
        ends = [0, *(m.end() for m in regex.finditer(r"\w+", text))]
        assert r["__fim_n"] == len(ends) - 1 and r["__fim_restored"] == text
        assert r["__fim_form"] == "plain" or (r["__fim_prefix_chars"] in ends and r["__fim_prefix_chars"] + r["__fim_middle_chars"] in ends)
        assert list(fim.unit_ends(pattern, text)) == ends[1:]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM>ab\n\U0001f600", max_size=40), st.integers(0, 10**6))
def test_any_text_comes_back(text, key):
    how = fim.Cut(rate=100)
    n, form, a, b, output = fim.cut(text, str(key), how, fim.unit_pattern(how.unit))
    assert n == len(text) and fim.put_back(output, form, how) == text


def test_sentinels_that_overlap_are_refused():
    for a, b, c in (("<a", "<ab", "c"), ("ab", "bc", "x"), ("", "b", "c"), ("aa", "a", "b"), ("xyx", "b", "c")):
        with pytest.raises(ValueError):
            fim.Cut(prefix=a, suffix=b, middle=c)
    with pytest.raises(ValueError):
        fim.unit_pattern("a*")


FAKE = warc.record(777, "http://fake/", b"<html>fake</html>", False, None)
PAGES = [
    (1, "http://a/", "<html>one</html>"), (2, "http://b/ c\r\nWARC/1.1", "<html>one</html>"), (3, None, None), (4, "u", ""), (5, "u", "x\r\n\r\n" + FAKE.decode() + FAKE.decode()),
    (6, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\n"), (7, "u", "\r\n\r\nWARC/1.1\r\nno end"), (8, "u", "é\U0001f600" * 50_000), (9, "u", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"), (None, "u", "<html>one</html>"),
    (None, "u", "only without id"), (None, "v", "only without id"), (0, "u", "only once"), (11, "u", "rep"), (11, "u", "rep"), (10, "u", "WARC-Type: revisit\r\n\r\n\r\n\r\n"),
]


def warc_brute(pages, least=0):
    firsts = {}
    for i, _, html in pages:
        if i is not None:
            firsts[html or ""] = min(i, firsts.get(html or "", i))
    out = []
    for i, _, html in pages:
        payload = (html or "").encode()
        first = firsts.get(html or "", i)
        revisit = i != first and len(payload) >= least
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(str, out))


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize(("file_bytes", "range_bytes", "least"), [(1 << 26, 1 << 22, 0), (900, 64, 10), (1 << 26, 1000, 0)])
def test_archives_come_back(spark, tmp_path, pages, file_bytes, range_bytes, least):
    files = warc.write(pages.coalesce(1), f"file://{tmp_path}", least_bytes=least, file_bytes=file_bytes)
    rows = warc.records(files, range_bytes=range_bytes).collect()
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in rows) == warc_brute(PAGES, least)
    assert {(r.page_id, bytes(r.payload)) for r in rows if r.record_type == "response"} <= {(i, (h or "").encode()) for i, _, h in PAGES}
    assert all(r.whole for r in warc.chains(files, range_bytes=range_bytes).collect())
    assert warc.listed(spark, f"file://{tmp_path}").agg(F.sum("length")).first() == files.agg(F.sum("length")).first()


def test_magic_in_payloads_is_a_candidate_but_no_record(spark, tmp_path, pages):
    files = warc.write(pages.coalesce(1), f"file://{tmp_path}")
    found = warc.candidates(files, range_bytes=256)
    assert found.count() > len(PAGES) and warc.records(files, range_bytes=256).where("page_id = 777").isEmpty()


def test_damaged_file_gives_what_is_before(spark, tmp_path):
    content = [warc.record(i, "u", b"p%d" % i * 50, False, None) for i in range(20)]
    whole = b"".join(content)
    cut = sum(map(len, content[:13])) + 30
    broken = bytearray(whole)
    broken[sum(map(len, content[:5]))] = 0
    paths = []
    for name, data in (("whole", whole), ("cut", whole[:cut]), ("broken", bytes(broken)), ("empty", b"")):
        (tmp_path / f"{name}.warc").write_bytes(data)
        paths.append((f"file://{tmp_path}/{name}.warc", len(data)))
    files = spark.createDataFrame(paths, "path string, length long")
    counts = {"whole": 20, "cut": 13, "broken": 5}
    expected = sorted(i for n in counts.values() for i in range(n))
    assert sorted(r.page_id for r in warc.records(files, range_bytes=300).collect()) == expected
    assert {r.path.rpartition("/")[2]: r.whole for r in warc.chains(files, range_bytes=300).collect()} == {"whole.warc": True, "cut.warc": False, "broken.warc": False, "empty.warc": True}


@pytest.mark.parametrize("least", [0, 10])
def test_many_repeats_are_joined_by_key(spark, monkeypatch, tmp_path, least):
    monkeypatch.setattr(warc, "smaller", lambda table: table)
    rng = random.Random(1)
    rows = [(i, "u", f"hot payload of all {0 if rng.random() < 0.4 else rng.randrange(1, 900)}"[: rng.choice([5, 60])]) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(df, f"file://{tmp_path}", least_bytes=least).select(*COLUMNS).collect()
    assert sorted(str(tuple(r)) for r in got) == warc_brute(rows, least)


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(str(tuple(r)) for r in queries.op12_warc_chain(spark, SF).collect()) == warc_brute(rows)


def draw_brute(documents, targets, percent=10, least=20):
    def words(t):
        t = "".join(c.lower() if c.isascii() else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in documents]), (t, targets)):
        for x in texts:
            for w in words(x):
                counts[bucket(w)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10000) / ((a + 1) * (T + 10000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for d, x in documents:
        w = words(x)
        weight = sum(gain[bucket(k)] for k in w)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, eligible[: percent * len(eligible) // 100]


@pytest.mark.parametrize("blocks", ["large", "small"])
def test_op13(spark, monkeypatch, blocks):
    folder = SF
    if blocks == "small":  # many runs, several merges, ranges of a few records
        folder = "/root/testdata/sf0.01"
        for name, n in (("RUN_RECORDS", 40), ("FAN_IN", 7), ("BLOCK", 3), ("FENCE", 2), ("RANGE_RECORDS", 100)):
            monkeypatch.setattr(resampling, name, n)
        monkeypatch.setattr(queries, "small_batches", lambda session: session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20))
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows, drawn = draw_brute(documents, [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    ranks = {r[0]: k for k, r in enumerate(drawn, 1)}
    got = queries.op13_importance_draw(spark, folder)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted((*r, ranks.get(r[0])) for r in rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def test_draw_of_ties_nulls_and_repeats(spark, tmp_path, monkeypatch):
    for name, n in (("RUN_RECORDS", 50), ("FAN_IN", 3), ("BLOCK", 8), ("FENCE", 4), ("RANGE_RECORDS", 32)):
        monkeypatch.setattr(resampling, name, n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 25)
    long = "alpha beta " * 15
    rows = [(None, long)] * 300 + [(5, long)] * 40 + [(i, f"{long} w{i}") for i in range(100)] + [(-7, "short"), (None, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("clash"))
    target = spark.createDataFrame([("alpha",), (None,)], "text string")
    brute, drawn = draw_brute(rows, ["alpha", None], percent=50)
    got = [tuple(r) for r in resampling.resampled(df, target, percent=50).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    assert sorted(map(str, (r[:4] for r in got))) == sorted(map(str, brute))
    ranked = sorted((r for r in got if r[4]), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(drawn) + 1)) and [(r[3], r[0]) for r in ranked] == [(r[3], r[0]) for r in drawn]


def test_nothing_to_draw(spark):
    df = spark.createDataFrame([(1, "few words"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert sorted((r.doc_id, r["rank"]) for r in resampling.resampled(df, none).collect()) == [(1, None), (2, None)]
    assert resampling.resampled(df.limit(0), none).collect() == []


def test_features_of_several_words():
    found, n = resampling.features(b"A b, C", 1, 3)
    assert n == 3 and sorted(found) == sorted([b"a", b"b", b"c", b"a b", b"b c", b"a b c"])
    assert sorted(resampling.features(b"A b, C", 2, 2)[0]) == [b"a b", b"b c"]


def test_a_tournament_merges_and_stops(tmp_path):
    rng = np.random.default_rng(1)
    for n_runs in (1, 2, 3, 7):
        runs = []
        for k in range(n_runs):
            r = np.zeros(int(rng.integers(0, 9000)), resampling.RECORD)
            r["score"], r["place"] = rng.integers(0, 50, len(r)), np.arange(len(r)) * 10 + k
            data = np.sort(resampling.flat(r))
            (tmp_path / f"{n_runs}-{k}").write_bytes(data.tobytes())
            runs.append(data)
        slices = [resampling.Slice(f"file://{tmp_path}/{n_runs}-{k}", 0, len(r)) for k, r in enumerate(runs)]
        whole = np.sort(np.concatenate(runs))
        most = len(whole) * 2 // 3
        got = np.concatenate([whole[:0], *resampling.Tournament(slices).merged(most)])
        assert (got == whole[:most]).all()


def test_records_hold_rows():
    rows = pa.RecordBatch.from_pydict({"doc_id": [3, None, -2, 2**62], "n_features": [1, 2, 3, 4], "weight": [-5, 6, 0, -(2**60)], "score": [-1, 0, 2**40, -(2**61)], "text_hash": [-9, 9, 0, 1], "place": [0, 1, 2, 2**50]})
    back = resampling.rows_of(resampling.packed(rows))
    assert {c: a.to_pylist() for c, a in back.items()} == rows.to_pydict()
