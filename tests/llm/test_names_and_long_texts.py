"""Callers' columns with the names that operators use inside, texts of megabytes, and hashes that collide."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalmill.llm import bpe, license_scan, line_dedup, mixing, near_dedup, parts, quality_rules, secret_scan, wavelet

INSIDE = """quota start ring k seats blocks size spans blob_id rule_version token_ids decoded ids hash home until node check signature tree key prefix members
 rank salt salts runs text_hash first last chunk a b n h p u v z positive labelled f shard block q vector taken target copies kept rule counts base_failed words found""".split()
BPE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def rows_of(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    texts = [line(60) for _ in range(4)] + [None, "", "password = abcdefgh", "cc by 4.0"]
    return [(i, t, f"s{i % 2}") for i, t in enumerate([*texts, *texts])]


OPERATORS = {
    "quality": lambda s, d: quality_rules.judged(d, quality_rules.DecisionList(())),
    "lines": lambda s, d: line_dedup.deduplicated(d),
    "mix": lambda s, d: mixing.taken(d, *mixing.quotas(d.select("doc_id", mixing.text_key(F.col("text")).alias("text_key"), "source", F.length("text").cast("bigint").alias("size"))), F.coalesce(F.length("text"), F.lit(0)).cast("bigint"), mixing.text_key(F.col("text"))),
    "licenses": lambda s, d: license_scan.scanned(d),
    "bpe": lambda s, d: bpe.round_trip(d, BPE),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_callers_columns_come_along(spark, name):
    plain = spark.createDataFrame(rows_of(spark), "doc_id long, text string, source string")
    crowded = plain.select("*", *[F.lit(f"mine {x}").alias(x) for x in INSIDE])
    plain, out = (OPERATORS[name](spark, d) for d in (plain, crowded))
    own = [c for c in plain.columns if c != "__lines_text"]
    assert set(out.columns) == set(plain.columns) | set(INSIDE)
    got = out.select(*own, *INSIDE).collect()
    assert all(r[x] == f"mine {x}" for r in got for x in INSIDE)
    assert sorted(str(r[: len(own)]) for r in map(tuple, got)) == sorted(str(tuple(r)) for r in plain.select(*own).collect())


def test_callers_columns_elsewhere(spark, tmp_path):
    plain = spark.createDataFrame(rows_of(spark), "doc_id long, text string, source string")
    crowded = plain.select("*", *[F.lit(f"mine {x}").alias(x) for x in INSIDE])
    for k, d in enumerate((plain, crowded)):
        ledger = secret_scan.BlobLedger(spark, f"file://{tmp_path}/{k}")
        ledger.scan(d)
        out = ledger.join(d)
        assert set(out.columns) == {*d.columns, "__secret_blob", "__secret_spans"} and out.where(F.size("__secret_spans") > 0).count() == 2
    a, b = (sorted(map(tuple, near_dedup.similar_components(d, width=3, percent=85).collect())) for d in (plain, crowded))
    assert a == b
    a, b = ([tuple(r) for r in wavelet.store(d, WORDS, end_id=1).collect()] for d in (plain, crowded))
    assert sorted(a) == sorted(b)


def test_texts_of_megabytes(spark):
    """Whole texts, far above the pieces that are hashed at once: one of many lines, one of a single line, one without spaces."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**5)}" for _ in range(300_000)]
    lines = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
    rows = [(0, "first line\n" + lines), (1, lines + "\nlast line"), (2, " ".join(words)), (3, "x" * 1_500_000), (4, " ".join(words[:-5]) + " or others")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counted = {r.doc_id: r.c for r in df.select("doc_id", quality_rules.text_counts("text").alias("c")).collect()}
    assert [counted[d].n_words for d in range(5)] == [len(t.split()) for _, t in rows] and counted[3].word_chars == 1_500_000
    left = {r.doc_id: r["__lines_text"] for r in line_dedup.deduplicated(df).collect()}
    assert left[1] == "last line" and all(left[d] == rows[d][1] for d in (0, 2, 3, 4))
    found = {r.doc_id: r.component_id for r in near_dedup.similar_components(df, width=3, percent=85).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0}
    library = Tokenizer.from_file(BPE)
    for r in bpe.round_trip(df.where("doc_id in (0, 4)"), BPE).collect():
        assert r["__bpe_ids"] == library.encode(r.text, add_special_tokens=False).ids and r["__bpe_decoded"] == r.text


def test_hashes_of_pieces_agree():
    from signalmill.llm.hashing import BATCH_BYTES, hasher

    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5 * BATCH_BYTES, dtype=np.uint8)
    ends = np.array([3, 500, BATCH_BYTES, BATCH_BYTES + 1, 3 * BATCH_BYTES + 9, 5 * BATCH_BYTES])
    starts = np.concatenate([[0], ends[:-1]])
    alone = [hasher().spans(data[a:b].copy(), np.array([0]), np.array([b - a]))[0] for a, b in zip(starts, ends, strict=True)]
    assert hasher().spans(data, starts, ends).tolist() == [int(x) for x in alone]


def test_parts_of_one_hash_are_told_apart(monkeypatch):
    class Poor:
        def spans(self, data, starts, ends):
            return (ends - starts).astype(np.uint64) % np.uint64(3)

    monkeypatch.setattr(parts, "hasher", Poor)

    def learn(some):
        ids = [list(p) for p in some]
        sizes = np.array([len(x) for x in ids])
        return np.array([y for x in ids for y in x], np.int32), np.cumsum(sizes) - sizes, sizes

    memo = parts.PartMemo(np.dtype(np.int32), learn)
    for seed in range(30):
        rng = np.random.default_rng(seed)
        data = rng.integers(0, 3, 40, dtype=np.uint8)
        cuts = np.unique(np.concatenate([[0, 40], rng.integers(1, 40, 12)]))
        ids, placed = memo.ids(data, cuts[:-1], cuts[1:])
        assert ids.tolist() == data.tolist() and placed.tolist() == cuts[1:].tolist()


def test_nodes_of_one_number_are_told_apart(spark, monkeypatch):
    whole = near_dedup.node_numbers
    monkeypatch.setattr(near_dedup, "node_numbers", lambda x: (5, whole(x)[1]))
    rows = [(i, f"a{i // 2} b c d{i // 4} e f g h i j k l m n o p q r s t u v w x y z " * 3) for i in range(8)]
    out = {r.doc_id: r.component_id for r in near_dedup.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=100).collect()}
    assert out == {i: i // 2 * 2 for i in range(8)}
