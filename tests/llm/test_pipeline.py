"""Each stage of the pipeline against brute force on its own input."""

import os
import sys

import public_tokenizers
import pytest
from test_pair_operators import brute_clean, exact_components, same
from test_text_operators import ODD, quality_base, words_of
from tokenizers import Tokenizer

import corpus_pipeline
from signalmill.llm import quality_rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", params=["sf", "odd", "empty"])
def stages(request, spark, tmp_path_factory):
    """The folder, and the rows before and after each stage."""
    folder = SF
    root = str(tmp_path_factory.mktemp("pipeline"))
    if request.param != "sf":
        folder = f"{root}/{request.param}"
        long = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(6)]
        rows = [(i, t, None, f"s{i % 3}", 1, i, "x") for i, t in enumerate([*ODD, *long, *long, None])]
        rows += [(None, long[0], None, None, None, 1, None), (3, long[1], "en", "s1", 5, 2, "k"), (3, long[1], "en", "s1", 5, 2, "k")]
        schema = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"
        spark.createDataFrame(rows if request.param == "odd" else [], schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        after.write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs.collect())
    return folder, out


def test_quality_stage(spark, stages):
    folder, rows = stages
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    rules = quality_rules.fit(read("documents"), read("labels"))
    expected = []
    for r in rows[0]:
        n, chars, symbols, dup, repeat, failed = quality_base(r.text)
        lines = (r.text or "").split("\n")
        counts = {"symbols_per_word": symbols / max(n, 1), "upper_share": sum("A" <= c <= "Z" for c in r.text or "") / max(len(r.text or ""), 1), "digit_share": sum("0" <= c <= "9" for c in r.text or "") / max(len(r.text or ""), 1), "dup_line_share": dup / len(lines), "repeat_share": repeat / max(n, 1), "word_length": chars / max(n, 1), "n_words": n}
        rejected = any(all(counts[c.feature] > c.threshold if c.above else counts[c.feature] <= c.threshold for c in rule) for rule in rules.rules)
        if not failed and not rejected:
            expected.append(tuple(r))
    same(rows[1], expected)


def test_line_stage(stages):
    _, rows = stages
    expected = {}
    cleaned = brute_clean([(r.doc_id, r.text) for r in rows[1]])
    kept = [(r, t) for r, (_, t, _, gone) in zip(rows[1], cleaned, strict=True) if not gone or words_of(t)]
    same([(r.doc_id, r.text, r.source, r.n_chars) for r in rows[2]], [(r.doc_id, t, r.source, None if t is None else len(t)) for r, t in kept])
    assert expected == {}


def test_near_stage(stages):
    _, rows = stages
    components = exact_components([(r.doc_id, r.text) for r in rows[2]], 5, 80)
    seen, expected = set(), []
    for r, (d, _, c) in zip(rows[2], components, strict=True):
        if (d is None or c is None or d <= c) and (d is None or (d, r.text) not in seen):
            expected.append((d, r.text))
            seen.add((d, r.text))
    got = [(r.doc_id, r.text) for r in rows[3]]
    same(list(set(got)), list(set(expected)))
    assert len([g for g in got if g[0] is not None]) == len({g for g in got if g[0] is not None})


def test_mix_stage(stages):
    _, rows = stages
    before, after = {}, {}
    for part, count in ((rows[3], before), (rows[4], after)):
        for r in part:
            count[tuple(r)] = count.get(tuple(r), 0) + 1
    assert set(after) <= set(before) and all(n <= 3 * before[k] for k, n in after.items())
    size = lambda part: sum(len(words_of(r.text)) for r in part)
    largest = max((len(words_of(r.text)) for r in rows[3]), default=0)
    sources = len({r.source for r in rows[3]})
    assert abs(size(rows[4]) - size(rows[3])) <= 4 * (sources + 1) + 2 * largest * sources


def test_bpe_stage(stages):
    _, rows = stages
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    same([(r.doc_id, r.source, r.n_tokens, tuple(r.token_ids), r.round_trips) for r in rows[5]], [(r.doc_id, r.source, len(ids), tuple(ids), True) for r in rows[4] for ids in [library.encode(r.text or "", add_special_tokens=False).ids]])


def test_entry_without_llm(tmp_path):
    """The driver deletes this subpackage, its tests and the pipeline."""
    import shutil
    import subprocess

    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(repo, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
