"""Toxicity: a linear classifier from positive and unlabelled texts.

Confirmed toxic texts are positives; a sample of all texts, whose labels are
ignored, is unlabelled.  With class prior p the risk of a score g is
    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]),
the non-negative unbiased estimate; where the second term turns negative a step
goes against it, so that the fit can't profit from memorised positives.

Features, the same for any language: the presence of a word; of a word with a
beginning of 3 to 6 letters, since stems take many endings; and that certain shares
of a text's distinct words (two at least) have that beginning.  They are chosen by
how their share of distinct texts differs between the positives and all documents
that are not held out.

Defined results: null and empty texts have no features and get the score of the
intercept; equal texts count once in the fit, and a doc_id of several texts gives
one of them; rows with equal doc_id are scored one by one; without positives every
score is 0.01.  labels, lang, source and doc_id are never features.  Extra columns
are not read; empty tables give empty results.  A text is scored whole, whatever its
length.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import text_batches
from .storage import written

#: At most this many labelled texts, and about as many unlabelled ones, train the classifier.
MAX_LABELLED = MAX_UNLABELLED = 20_000
#: At most this many features, and as many times more whose frequency is counted over all documents.
MAX_FEATURES, CANDIDATES = 512, 8
#: Lengths of beginnings, and the shares of distinct words that are features.
BEGINNINGS = (3, 4, 5, 6)
SHARES = (2, 4, 8)
#: A feature stands in so many positives at least.
LEAST_TEXTS = 5
WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    """Names of the features of a text: 'word', 'beg-' and 'beg->4%'."""
    words = set(WORD.findall(text.lower()))
    begun: dict[str, int] = {}
    for w in words:
        for k in BEGINNINGS:
            if len(w) > k:
                begun[w[:k]] = begun.get(w[:k], 0) + 1
    out = words | {f"{b}-" for b in begun}
    for b, n in begun.items():
        if n > 1:
            out |= {f"{b}->{s}%" for s in SHARES if 100 * n >= s * len(words)}
    return out


class Features:
    """Numbers of known features, found without naming all others."""

    def __init__(self, names: list[str]):
        self.number = {n: i for i, n in enumerate(names)}
        self.words = {n for n in names if "-" not in n}
        self.beginnings = {n.partition("-")[0] for n in names if "-" in n}

    def of(self, text: str) -> list[int]:
        words = set(WORD.findall(text.lower()))
        out = [self.number[w] for w in words & self.words]
        begun: dict[str, int] = {}
        for k in BEGINNINGS:
            for b in [b for w in words if len(w) > k and (b := w[:k]) in self.beginnings]:
                begun[b] = begun.get(b, 0) + 1
        for b, n in begun.items():
            names = [f"{b}-", *(f"{b}->{s}%" for s in SHARES if n > 1 and 100 * n >= s * len(words))]
            out += [self.number[x] for x in names if x in self.number]
        return sorted(out)

    def column(self, text: str) -> Column:
        known = self

        @F.arrow_udf("array<int>")
        def numbers(texts: pa.Array) -> pa.Array:
            return pa.array([known.of(t.decode()) for _, part in text_batches(texts) for t in part], pa.list_(pa.int32()))

        return numbers(text)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


@dataclass(frozen=True)
class LinearModel:
    weights: dict[str, float]
    intercept: float

    def scorer(self):
        """A function of one text."""
        known, weights = Features(list(self.weights)), list(self.weights.values())

        def score(text: str | None) -> float:
            z = math.fsum([self.intercept, *(weights[i] for i in known.of(text or ""))])
            return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))

        return score

    def column(self, text: str) -> Column:
        model = self

        @F.arrow_udf("double")
        def score_text(texts: pa.Array) -> pa.Array:
            score = model.scorer()
            return pa.array([score(t.decode()) for _, part in text_batches(texts) for t in part], pa.float64())

        return score_text(text)


def train(rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, n_words: int, prior: float, *, steps: int = 600, rate: float = 0.05, l2: float = 1e-4, beta: float = 0.0, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept. rows: the feature numbers of each text, under the two sample masks."""
    x = np.zeros((len(rows), n_words + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, n_words] = 1
    xp, xu = x[positive], x[unlabelled]
    w = np.zeros(n_words + 1)
    w[n_words] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        now = w.astype(np.float32)  # else the matrices are widened in each step
        sp, su = (1 / (1 + np.exp(-(x @ now).astype(float))) for x in (xp, xu))
        # l(z) = log(1 + exp(-z)): d l(g)/dg = s - 1, d l(-g)/dg = s
        positive_part = prior * ((sp - 1).astype(np.float32) @ xp) / len(xp)
        negative_risk = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        negative_part = su.astype(np.float32) @ xu / len(xu) - prior * (sp.astype(np.float32) @ xp) / len(xp)
        g = positive_part + negative_part if negative_risk >= -beta else -gamma * negative_part
        g = g + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _z(p: Column, n_p: int, u: Column, n_u: int) -> Column:
    """How far the shares p / n_p and u / n_u are apart, in standard errors."""
    pooled = (p + u) / (n_p + n_u)
    return (p / n_p - u / n_u) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n_p + 1 / n_u))


def fit(documents: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, least_z: float = 4.0) -> LinearModel:
    """Learn from documents and labels, of which rows held out are never read.

    Labelled texts: those of the max_labelled doc_ids of smallest hash. Unlabelled
    texts, for the gradient alone: a share of all distinct texts by hash, about
    max_unlabelled.  Frequencies that choose the features are those in all distinct
    texts that are not held out.
    """
    documents = documents.select("doc_id", "text").where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    labels = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    share = min(1.0, max_unlabelled / max(1, documents.count()))
    picked = F.pmod(F.xxhash64("h", F.lit("unlabelled")), F.lit(1 << 20)) < int(share * (1 << 20))
    labelled = documents.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("h", "text", "toxic")).alias("r")).select("r.*")
    labelled = labelled.select("h", "text", (F.col("toxic") == 1).cast("int").alias("positive"), F.lit(1).alias("labelled"), F.lit(0).alias("unlabelled"))
    unlabelled = documents.where(picked).select("h", "text", F.lit(0).alias("positive"), F.lit(0).alias("labelled"), F.lit(1).alias("unlabelled"))
    flags = ("positive", "labelled", "unlabelled")
    # equal texts are one row, combined before the shuffle
    sample = labelled.unionByName(unlabelled).groupBy("h").agg(F.min("text").alias("text"), *[F.max(c).alias(c) for c in flags])
    sample = written(sample, "toxicity-sample")
    sizes = sample.agg(*[F.sum(c).alias(c) for c in flags]).first()
    if not sizes.positive or not sizes.unlabelled:
        return LinearModel({}, math.log(0.01 / 0.99))
    prior = min(0.5, max(0.001, sizes.positive / sizes.labelled))

    @F.arrow_udf("array<string>")
    def names_of(texts: pa.Array) -> pa.Array:
        return pa.array([list(features_of(t.decode())) for _, part in text_batches(texts) for t in part], pa.list_(pa.string()))

    p, u = F.col("p"), F.col("u")
    counts = sample.select(names_of.asNondeterministic()("text").alias("names"), *flags).select(F.explode("names").alias("name"), *flags).groupBy("name").agg(F.sum("positive").alias("p"), F.sum("unlabelled").alias("u")).where(p >= LEAST_TEXTS)
    likely = counts.withColumn("z", _z(p, sizes.positive, u, sizes.unlabelled)).orderBy(F.abs("z").desc(), "name").limit(CANDIDATES * max_features)
    likely = {r.name: r.p for r in likely.collect()}
    every = documents.select("h", Features(list(likely)).column("text").alias("f")).groupBy("h").agg(F.min("f").alias("f"))
    every = written(every, "toxicity-features")
    n = every.count()
    candidates = every.sparkSession.createDataFrame([(i, name, p) for i, (name, p) in enumerate(likely.items())], "i int, name string, p bigint")
    seen = every.select(F.explode("f").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("u")).join(F.broadcast(candidates), "i")
    best = seen.withColumn("z", _z(p, sizes.positive, u, n)).where(F.abs("z") >= least_z).orderBy(F.abs("z").desc(), "name").limit(max_features)
    names = [r.name for r in best.select("name").collect()]
    rows = sample.where("positive = 1 or unlabelled = 1").select("h", "positive", "unlabelled", Features(names).column("text").alias("f")).collect()
    rows.sort(key=lambda r: r.h)
    w, b = train([np.array(r.f, int) for r in rows], np.array([r.positive == 1 for r in rows]), np.array([r.unlabelled == 1 for r in rows]), len(names), prior)
    return LinearModel({n: float(x) for n, x in zip(names, w, strict=True)}, b)
