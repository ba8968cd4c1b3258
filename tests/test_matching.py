"""All matches of a registry table against patterns tried one by one."""

import functools
import random
import re

import pytest
from pyspark.sql import functions as F

from signalmill.functions import matching
from signalmill.operators import annotate
from signalmill.sources.registries import Entry, as_table


@functools.cache
def pattern(identifier):
    left = r"(?<!\w)" if re.match(r"\w", identifier[0]) else r"(?<=\w)"
    right = r"(?!\w)" if re.match(r"\w", identifier[-1]) else r"(?=\w)"
    return re.compile(left + re.escape(identifier) + right)


def stands(identifier, text):
    return pattern(identifier).search(text) is not None


def brute(registry, text):
    text = text or ""
    lower = text.lower()
    out = []
    for e in registry:
        evidence = [t for t in e.cashtags if t and t.lower() in lower]
        score = 1.0
        if not evidence:
            evidence = [n for n in e.cased if len(n) >= 3 and stands(n, text)] + [n for n in e.identifiers if len(n) >= 3 and stands(n.lower(), lower)]
            score = 0.9 if len(evidence) > 1 else 0.8
        if evidence:
            out.append((e.id, score, tuple(evidence)))
    return out


ODD = (
    Entry(1, "A", "A", ("s&p 500", "erc-20", "$btc", "abc", "ab", "c++ code", "...", "x.y"), ("SOL", "S P"), ("$BTC", "a$")),
    Entry(2, "B", "B", ("abc", "abc"), (), ("él", "### tok", "$$", "-mid-", "ab")),
    Entry(3, "C", "C", (), (), ("pre-",)),
)
TEXTS = [
    None, "", "S&P 500 rose", "s&p 5000", "erc-20 and erc-200", "x$btc y", "$BTCUSD", "abc", "abcd", "zabc", "ab c", "SOL sol", "Sol", "c++ code!", "c++ codes", "a...b", "a ... b", "a$", "ba$x", "élan", "dél", "### token", "###  tok", "$$", "x-mid-y", "-middle-",
    "spre-x", "pre x", "x.y", "x.yz", "x_y abc_", "S P", "s p", "abc abc ABC", "él $btc erc-20 x.y",
]


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, text string")


@pytest.mark.parametrize("large", [False, True])
def test_all_matches_of_odd_identifiers(spark, large):
    got = matching.all_matches(rows_of(spark, TEXTS), as_table(spark, ODD), key="k", broadcast_bytes=-1 if large else 1 << 25).collect()
    expected = sorted((k, *m) for k, t in enumerate(TEXTS) for m in brute(ODD, t))
    assert sorted((r.k, r.id, r.score, tuple(r.evidence)) for r in got) == expected


@pytest.mark.parametrize("large", [False, True])
def test_registry_of_thousands(spark, large):
    rng = random.Random(5)
    letters = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "klmnrst"]
    name = lambda: " ".join(rng.choice(letters) + rng.choice(["", "", "x"]) for _ in range(rng.choice([1, 1, 2, 3])))
    registry = tuple(Entry(k, f"S{k}", "n", tuple(name() for _ in range(2)), (name().title(),), (f"${rng.choice(letters)}",)) for k in range(2500))
    texts = [" ".join(rng.choice(["$", "", "", ""]) + rng.choice(letters) for _ in range(60)).replace("kl", rng.choice(["kl", "Kl"])) for _ in range(40)]
    got = matching.all_matches(rows_of(spark, texts), as_table(spark, registry), key="k", broadcast_bytes=-1 if large else 1 << 25).collect()
    assert sorted((r.k, r.id, r.score, tuple(r.evidence)) for r in got) == sorted((k, *m) for k, t in enumerate(texts) for m in brute(registry, t))


def test_best_of_an_expression_is_the_best_of_all(spark):
    default = Entry(9, "NO", "none")
    rows = rows_of(spark, TEXTS).select("k", "text", matching.match(F.col("text"), (*ODD, default), default).alias("m")).collect()
    for r in rows:
        best = max(brute(ODD, r.text), key=lambda m: (m[1], -m[0]), default=(9, 0, ()))
        assert (r.m.id, tuple(r.m.evidence)) == (best[0], best[2]), r.text


def test_postings_are_joined_not_tried(spark):
    plan = matching.all_matches(rows_of(spark, TEXTS), as_table(spark, ODD), key="k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Cartesian" not in plan


def test_annotated_classifies_once(spark):
    from signalmill.functions import classify

    default = Entry(9, "NO", "none")
    items = rows_of(spark, TEXTS).withColumn("c", classify.classify_post(F.col("text"), (*ODD, default), default))
    out = annotate.annotated(items, "c", "post")
    assert out.count() == sum(1 for t in TEXTS if t)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("very_bearish") == 1


#: Texts at the edges of words and numbers, with what the rules say of them: content_type, technical_quality and the asset matched.
EDGES = {
    "release v1.2 at 20 ms": ("announcement", "high", 9),
    "RELEASE 3.5% of rapid": ("announcement", "high", 9),
    "capital 1. 2 and 9.a of the node": ("other", "low", 9),
    "an API, 7 items": ("other", "medium", 9),
    "_api apis repo_ x20ms http:/": ("other", "none", 9),
    "https://x sdk 5tps 1.0": ("other", "high", 9),
    "Was it a vote": ("governance", "none", 1),
    "was it; WAS Wash Was_": ("other", "none", 9),
    "İmo gm": ("community", "none", 9),
    "\U0001d400gm \U0001f600imo": ("opinion", "none", 9),
}


def test_labels_at_edges_and_texts_split_once(spark):
    from signalmill.functions import classify

    registry, default = (Entry(1, "WAS", "w", ("zebra",), ("Was",)), Entry(9, "NO", "none")), Entry(9, "NO", "none")
    out = rows_of(spark, EDGES).select("k", classify.classify_post(F.col("text"), registry, default).alias("c"))
    assert [(r.c.content_type, r.c.technical_quality, r.c.id) for r in sorted(out.collect(), key=lambda r: r.k)] == list(EDGES.values())
    # one splitting for the lower case, whether the matcher or the rules ask, and one for texts with a cased identifier
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
    assert all(plan.count(p) == 1 for p in classify.SPECIFICS)
