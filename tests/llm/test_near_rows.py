"""The near stage decides by row, where ids are repeated or missing."""

import random

import corpus_pipeline


def test_rows_that_share_an_id(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))
    a, b, c, d, e, unique, single = (text() for _ in range(7))
    near = lambda t: t + " more"
    rows = [(1, a), (2, near(a)), (2, unique), (5, b), (5, near(b)), (None, c), (None, near(c)), (None, single), (9, d), (None, near(d)), (7, e), (7, e), (None, None), (8, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, "").collect()]
    fixed = [(1, a), (2, unique), (None, c), (None, near(c)), (None, single), (9, d), (None, near(d)), (7, e), (None, None), (8, ""), (8, None)]
    key = lambda r: tuple((x is not None, x) for x in r)
    rest = [r for r in out if r not in fixed]
    assert sorted([r for r in out if r in fixed], key=key) == sorted(fixed, key=key)
    assert rest in ([(5, b)], [(5, near(b))])
