"""Operators 2, 5 and 6 against brute force."""

import random
import re

import numpy as np
import pytest

from signalmill.llm import graph, line_dedup, near_dedup, permutation_index, queries

SF = "/root/testdata/sf0.01"


def fold(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def exact_components(rows, width, percent):
    """(doc_id, size, component) of each row, over all pairs that share a shingle."""
    sets = [shingle_set(t, width) for _, t in rows]
    tops = list(range(len(rows)))

    def top(x):
        while tops[x] != x:
            tops[x] = x = tops[tops[x]]
        return x

    posts = {}
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in posts.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            posts[x].append(i)
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                tops[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def same(a, b):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def test_op5_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = exact_components(rows, 3, 85)
    out = queries.op5_lsh_forest(spark, SF).collect()
    same([r[:3] for r in out], expected)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_op5_oracle_agrees(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same([r[:3] for r in con.sql(queries.oracle_sql()["op5_lsh_forest"]).fetchall()], exact_components(rows, 3, 85))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_copies_in_crowds(spark, width, percent):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    other = [f"x{rng.randrange(500)}" for _ in range(60)]
    texts = [" ".join(base)] * 40 + [edited(rng, base, rng.choice((0, 1, 1, 2, 3))) for _ in range(260)] + [edited(rng, other, rng.randrange(3)) for _ in range(80)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(150)]
    texts += ["", None, " \n", "one", "One", "one two", "two one", "ONE two"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, "one"), (3, "three has another text here"), (None, None), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dedup.similar_components(df, width=width, percent=percent).collect()
    same(out, exact_components(rows, width, percent))


def test_crowds_of_any_size_and_cut_regions(spark, monkeypatch):
    """Tiny bounds make nearly all regions crowds, cut by tasks and by what a walk holds; no link is lost."""
    for name, value in (("REGION", 4), ("HELD", 20), ("HOT", 3), ("CROWD_BLOCK", 16)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(12)
    bases = [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (60, 90, 200)]
    texts = [edited(rng, bases[i % 3], rng.choice((0, 1, 1, 2, 4, 9))) for i in range(240)] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    rows = list(enumerate(texts))
    out = near_dedup.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), width=3, percent=85).collect()
    same(out, exact_components(rows, 3, 85))


def test_walk_keeps_neighbours_by_longest_common_prefix(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_dedup, "REGION", 3)
    rng = np.random.default_rng(4)
    rows = sorted({tuple([t, *(rng.integers(0, 2, 16) * np.array([0] * 3 + [1] * 13)).tolist()]) for t in (0, 1) for _ in range(25)} | {(2, *range(k, k + 16)) for k in range(9)})
    keys = [np.array(r[1:], ">u4").view("<u4").tobytes() for r in rows]
    batches = [pa.record_batch({"tree": pa.array([r[0] for r in rows[k : k + 11]], pa.int32()), "key": pa.array(keys[k : k + 11], pa.binary()), "node": pa.array(range(k, min(k + 11, len(rows))), pa.int64())}) for k in range(0, len(rows), 11)]
    found = [r for b in near_dedup._walk(iter(batches)) for r in b.to_pylist()]
    pairs = {(x, y) for r in found if r["prefix"] is None for x in r["members"] for y in r["members"] if x < y}
    for i in range(len(rows) - 1):
        shared = next((k for k in range(17) if rows[i][k] != rows[i + 1][k]), 17) - 1
        assert ((i, i + 1) in pairs) == (shared >= 3)
    crowd = [x for r in found if r["prefix"] is not None for x in r["members"]]
    assert sorted(crowd) == [i for i, r in enumerate(rows) if r[0] < 2] + [len(rows) - 1] and len(set(crowd)) == len(crowd)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000)]
    edges += [(2000 + rng.randrange(200), 2000 + rng.randrange(200)) for _ in range(150)]
    tops = {}

    def top(x):
        while tops.setdefault(x, x) != x:
            x = tops[x]
        return x

    for u, v in edges:
        a, b = top(u), top(v)
        if u != v:
            tops[max(a, b)] = min(a, b)
    expected = {n: top(n) for u, v in edges if u != v for n in (u, v)}
    out = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(out) == len(expected) and {r.node: r.root for r in out} == expected
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def exact_neighbours(rows, k, step):
    usable = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in usable:
        if i is not None and i % step == 0:
            scores = [(-(float((v * u).sum())), j) for j, u in usable if j != i]
            out[i] = sorted(scores)[:k]
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_op2_recall(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    exact = exact_neighbours(rows, 20, 20)
    found = {}
    for r in queries.op2_permutation_index(spark, folder).collect():
        found.setdefault(r.query_id, []).append(r)
    assert found.keys() == exact.keys()
    hits = total = 0
    value = {i: np.array(v, float) for i, v in rows}
    for i, best in exact.items():
        got = sorted(found[i], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, len(best) + 1)) and i not in {r.vec_id for r in got}
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        assert all(abs(r.score - (value[i] * value[r.vec_id]).sum()) < 1e-12 for r in got)
        hits += len({j for _, j in best} & {r.vec_id for r in got})
        total += len(best)
    assert hits >= 0.95 * total, hits / total


def test_op2_odd_vectors(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [0.6, 0.8]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (9, [-1.0, 0.5]), (None, [0.0, 1.0])]
    rows += [(100 + i, [0.5, 0.5]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("vec_id", "vec_id").selectExpr("*", "1 as score", "2 as vector").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {}
    for r in queries.op2_permutation_index(spark, str(tmp_path)).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert out.keys() == {0, 20, 40, 100, 120, 140}
    assert [v for _, v in sorted(out[0])] == [1, 20, 40, *range(100, 117)]
    assert [v for _, v in sorted(out[140])][:3] == [40, 0, 1] and 140 not in {v for _, v in out[140]}
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.op2_permutation_index(spark, f"{tmp_path}/none").collect() == []


def brute_clean(rows):
    """Rows without the lines of runs of 50 words that a document of smaller id holds, too; knows no chunks and no hashes."""
    full = [[i for i, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for _, t in rows]
    lines = [[t.split("\n")[i] for i in f] if t else [] for (_, t), f in zip(rows, full, strict=True)]
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    places = {}
    for r, (d, _) in enumerate(rows):
        for i, x in enumerate(lines[r] if d is not None else []):
            places.setdefault(x, []).append((r, i))
    out = []
    for r, (d, t) in enumerate(rows):
        own, gone = lines[r], set()
        for i, x in enumerate(own if d is not None else []):
            for q, j in places[x]:
                # a common run begins here if the lines before differ
                if rows[q][0] < d and not (i and j and own[i - 1] == lines[q][j - 1]):
                    n = 1
                    while i + n < len(own) and j + n < len(lines[q]) and own[i + n] == lines[q][j + n]:
                        n += 1
                    if sum(map(words, own[i : i + n])) >= 50:
                        gone.update(range(full[r][i], full[r][i + n - 1] + 1))
        all_lines = (t or "").split("\n")
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(all_lines) if i not in gone), len(gone & set(full[r])), sum(words(all_lines[i]) for i in gone)))
    return out


def test_op6_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    same(queries.op6_line_chunks(spark, "/root/testdata/sf0.001").collect(), brute_clean(rows))


def test_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(2)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two, many = [line(70)], [line(30), line(35)], [line(8) for _ in range(24)]
    rows = []
    for i in range(60):
        own = [line(rng.randint(3, 40)) for _ in range(rng.randint(4, 20))]
        at = rng.randrange(len(own) + 1)
        passage = (one, two, many, [])[i % 4]
        rows.append((i, "\n".join(own[:at] + passage + own[at:])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "\n".join(two)), (103, "short line\nshort line"), (0, rows[0][1]), (104, "\n".join(["a b", "c d", "", "e f"] * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as hash", "1 as home")
    out = line_dedup.deduplicated(df).collect()
    assert {"hash", "home"} <= set(df.columns)
    same([(r.doc_id, r["__lines_text"], r["__lines_n_removed_lines"], r["__lines_n_removed_words"]) for r in out], brute_clean(rows))
    left = {r.doc_id: r["__lines_text"] for r in out}
    for i in range(4, 60):
        before, after = rows[i][1].split("\n"), left[i].split("\n")
        if i % 4 == 0:
            assert one[0] not in after
        elif i % 4 == 1:
            assert two[0] not in after and two[1] not in after
        elif i % 4 == 2:
            assert not set(many) & set(after)
        else:
            assert before == after
    assert left[0].count(one[0]) == 1


def test_chunks_have_several_lines_and_begin_anew(spark):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice((3, 8, 30)))).encode()
    own = [line() for _ in range(4000)]
    other = own[:1000] + [line()] + own[1000:2500] + own[2510:]
    a, b = line_dedup.Lines([b"\n".join(own)]), line_dedup.Lines([b"\n".join(other)])
    first, second = ({x.bytes(*c) for c in x.chunks(0)} for x in (a, b))
    assert 6 < len(own) / len(first) < 12 and all(1 < c.count(b"\n") + 1 <= 32 for c in first - {a.bytes(*a.chunks(0)[-1])})
    assert len(first - second) <= 8


def test_runs_go_or_stay_whole_at_any_offset(spark):
    """4 lines of 8 words stay, 7 of 8 go, whatever stands around them; equal hashes of other bytes change nothing."""
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    short, long = [line(8) for _ in range(4)], [line(8) for _ in range(7)]
    rows = []
    for i in range(40):
        own = [line(rng.choice((2, 9, 25))) for _ in range(i // 2)]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + (short if i % 2 else long) + own[at:])))
    out = {r.doc_id: r["__lines_text"].split("\n") for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(set(short) <= set(out[i]) for i in range(1, 40, 2)) and set(long) <= set(out[0])
    assert not any(set(long) & set(out[i]) for i in range(2, 40, 2))


def test_hot_runs_are_spread(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 7)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    rng = random.Random(7)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    runs = [[line(30) for _ in range(5)] for _ in range(3)]
    rows = [(i, "\n".join([line(4)] + runs[i % 3][: 2 + i % 4] + [line(5)])) for i in range(60)] + [(i, "\n".join(runs[0])) for i in range(60, 80)]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([(r.doc_id, r["__lines_text"], r["__lines_n_removed_lines"], r["__lines_n_removed_words"]) for r in out], brute_clean(rows))


def test_components_over_many_pieces(spark, monkeypatch):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300) - 150, rnd.randrange(300) - 150) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    rnd.shuffle(edges)
    found = {}
    for piece in (1 << 17, 20):
        monkeypatch.setattr(graph, "PIECE", piece)
        rows = [(r.node, r.root) for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()]
        assert len(rows) == len(set(rows))
        found[piece] = dict(rows)
    assert found[20] == found[1 << 17] and len({found[20][i] for i in range(1000, 1061)}) == 1
    assert all(found[20][u] == found[20][v] for u, v in edges if u != v)
