"""Passages of short lines against brute force over lines, which knows no cuts."""

import random

from signalmill.llm import line_dedup


def brute_runs(rows):
    """The words of lines in runs of 50 words or more whose pairs of lines all stand in earlier documents."""
    out = {}
    for d, t in rows:
        lines = [x for x in t.split("\n") if x.strip()]
        earlier = {p for e, u in rows if e < d for f in [[x for x in u.split("\n") if x.strip()]] for p in zip(f, f[1:])}
        kept, run = [], lines[:1]
        for a, b in [*zip(lines, lines[1:]), (lines[-1], None)]:
            if (a, b) in earlier:
                run.append(b)
            else:
                kept += run if len(run) < 2 or sum(len(x.split()) for x in run) < 50 else []
                run = [b]
        out[d] = kept
    return out


def test_short_line_passages_go_whole(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(60):
        size = rng.randint(4, 8)
        passage = [line(rng.randint(-(-50 // size), min(19, 100 // size))) for _ in range(size)]
        for copy in range(2):
            own = [line(rng.randint(1, 15)) for _ in range(rng.randint(3, 9))]
            at = rng.randrange(len(own) + 1)
            blank = [""] if k % 3 == 0 else []
            rows.append((2 * k + copy, "\n".join(own[:at] + blank + passage[:2] + blank + passage[2:] + own[at:])))
    # two passages of one document with other homes, in a row as they are in an earlier one
    a, b = [line(9) for _ in range(3)], [line(9) for _ in range(3)]
    rows += [(200, "\n".join(a)), (201, "\n".join(a + b)), (202, "\n".join([line(5)] + a + b + [line(5)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.deduplicated(df).collect()}
    expected = brute_runs(rows)
    for d, t in rows:
        if d in (200, 201):
            continue  # runs of fewer words, where cuts decide
        r = out[d]
        assert [x for x in r["__lines_text"].split("\n") if x] == expected[d], d
        was = [x for x in t.split("\n") if x]
        assert (r["__lines_n_removed_lines"], r["__lines_n_removed_words"]) == (len(was) - len(expected[d]), len(t.split()) - sum(len(x.split()) for x in expected[d]))
    assert len(out[202]["__lines_text"].split("\n")) == 2
