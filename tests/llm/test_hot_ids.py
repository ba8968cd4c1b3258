"""Words made to collide, and rows of one id or of none: nothing is mistaken, and no task gets them all."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from signalmill.llm import mixing, near_dedup, quality_rules, secret_scan, wavelet
from signalmill.llm.hashing import hasher
from signalmill.llm.storage import smaller

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def thue_morse(n, a="a", b="b"):
    """A word and its opposite, whose polynomial hashes modulo 2**64 agree for any base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_made_to_collide(spark, n):
    t, u = thue_morse(n)
    words, at = hasher().words([t.encode(), u.encode(), t.encode()], fold=False)
    assert len(set(words.tolist())) == 2 and words[0] == words[2] and at.tolist() == [0, 1, 2, 3]
    counts = quality_rules.count_batch([f"{t} x y {u} x y".encode(), f"{t} x y {t} x y".encode()])
    assert counts[:, quality_rules.COUNTS.index("n_repeat_words")].tolist() == [0, 6]
    df = spark.createDataFrame([(1, f"one two {t} three"), (2, f"one two {u} three"), (3, f"One two {t.upper()} three")], "doc_id bigint, text string")
    got = near_dedup.similar_components(df, width=3, percent=85).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1), (2, 2, 2), (3, 2, 1)]


def test_a_word_longer_than_a_batch(spark):
    t, u = thue_morse(1 << 19)
    words, _ = hasher().words([t.encode(), u.encode(), t.encode(), b"short"], fold=True)
    assert len(set(words.tolist())) == 3 and words[0] == words[2]


def test_many_texts_under_one_id_are_sets_of_their_own(spark, monkeypatch):
    """As many rows are shingled again as there are rows, not as many as their square."""
    n = 1000
    texts = [" ".join(f"w{k // 2}x{j}" for j in range(30)) + (" end" if k % 2 else "") for k in range(n)]
    df = spark.createDataFrame([(7, t) for t in texts], "doc_id bigint, text string")
    seen = spark.sparkContext.accumulator(0)
    plain = near_dedup._own_sets

    def counted(width):
        work = plain(width)

        def through(chunks):
            def passed():
                for chunk in chunks:
                    seen.add(chunk.num_rows)
                    yield chunk

            return work(passed())

        return through

    monkeypatch.setattr(near_dedup, "_own_sets", counted)
    rows = near_dedup.similar_components(df, width=3, percent=85, keepers=True).collect()
    assert len(rows) == n and {r.component_id for r in rows} == {7} and sum(r.kept for r in rows) == n // 2
    assert 0 < seen.value <= 10 * n


@pytest.mark.parametrize("doc_id", [None, 5])
def test_rings_of_rows_without_ids_of_their_own(spark, doc_id):
    """Rows of one id, or of none, lie on as many rings as others do, and the mix comes near its targets."""
    rows = [(doc_id, f"t{k} " + "word " * (k % 7 + 1), "xx", "a" if k % 3 else "b", 1) for k in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    size, key = mixing.word_count(F.col("text")), mixing.text_key(F.col("text"))
    sources, shards = mixing.quotas(df.select("doc_id", key.alias("text_key"), "source", size.alias("size")), shard_words=512)
    rings = shards.groupBy("__mix_k").agg(F.count("*").alias("n"), F.max("__mix_ring").alias("most")).collect()
    assert len(rings) == 2 and all(r.n > 5 and r.most < 3 * 512 for r in rings)
    out = mixing.taken(df, sources, shards, size, key, shard_words=512)
    assert out.count() == len(rows) and out.where("__mix_taken > 3 * __mix_size").isEmpty()
    for r in out.groupBy("source").agg(F.sum("__mix_taken").alias("taken"), F.first("__mix_target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 2 * mixing.BLOCK_WORDS
    again = mixing.taken(df.orderBy(F.desc("text")), sources, shards, size, key, shard_words=512)
    assert sorted(out.select("text", "__mix_taken").collect()) == sorted(again.select("text", "__mix_taken").collect())


@pytest.mark.parametrize("doc_id", [None, 5])
def test_files_of_rows_without_ids_of_their_own(spark, doc_id):
    texts = [f"{k * 7919 % 4000} some words" for k in range(4000)]
    df = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id bigint, text string").repartition(4)
    folder, key = spark.sparkContext.getConf().get("spark.checkpoint.dir"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # these few rows would be one task in any case
    try:
        shards = wavelet.write_shards(df, public_tokenizers.path("word_bpe_49k.json"), f"{folder}/hot-ids-{doc_id}", end_id=1)
    finally:
        spark.conf.unset(key)
    parts = [r.n for r in shards.groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(parts) == len(texts) and len(parts) > 1 and max(parts) < len(texts) * 0.6
    rows = wavelet.read_shards(shards).orderBy("start").collect()
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_spans_count_towards_a_broadcast(spark):
    small = spark.range(100).select("id", F.sequence(F.lit(0), F.lit(9)).alias("spans"))
    large = spark.range(3).select("id", F.sequence(F.lit(0), F.lit(1_000_000)).alias("spans"))
    hinted = lambda df, *items: "ResolvedHint (strategy=broadcast)" in df.join(smaller(df.toDF("id", "other"), *items), "id")._jdf.queryExecution().analyzed().toString()
    assert hinted(small, F.size("other")) and not hinted(large, F.size("other")) and hinted(large)


def test_one_blob_of_many_spans(spark, tmp_path):
    text = "\n".join(f"password={k:08d}" for k in range(120_000))
    df = spark.createDataFrame([(1, text), (2, text), (3, "nothing"), (None, None)], "doc_id bigint, text string")
    ledger = secret_scan.BlobLedger(spark, f"file://{tmp_path}/ledger")
    ledger.scan(df)
    ledger.scan(df)
    assert ledger._rows().count() == 3
    got = {r.doc_id: r.n for r in ledger.join(df).select("doc_id", F.size("__secret_spans").alias("n")).collect()}
    assert got == {1: 120_000, 2: 120_000, 3: 0, None: 0}
