"""Labels by a classifier fitted on labelled texts: naive Bayes over the words that speak most for each label.

Fitting is one grouping of words with a count for each label; a model is a table of at
most `most_words` words (a parameter, so broadcasting it is safe whatever the corpus)
and a prior for each label.  Scores are whole thousandths of logarithms, so sums don't
depend on their order.  Labelling explodes a text's distinct words, joins the
broadcast words and adds up by the text's hash: what is shuffled is a few numbers a
text, never the text, and equal texts are added up before the shuffle.

Defined results: a null text has null labels; an empty one, or one without known words,
the likeliest label of all; a dimension without labelled texts its default; of equally
likely labels the earlier in its domain is taken.  Null labels and labels outside
their domain are no examples.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import materialised
from .classify import DEFAULTS, DOMAINS

#: Words of a model, and labelled texts that a word must stand in.
MOST_WORDS, LEAST_TEXTS = 4096, 3
#: Scores are thousandths of natural logarithms.
UNIT = 1000
#: So many texts with the word at its rate over all labels are added to each label's, lest words that a rare label never met speak for it.
SHRINK = 10.0
#: Parts of a label's words whose best are found apart, as a label may have any number of words.
PARTS = 64


def words_of(text: Column) -> Column:
    """The distinct words of a text, lower-cased; the empty word, which every text has, counts texts."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(text), r"[^\p{L}\p{N}_]+")))


@dataclass(frozen=True)
class Model:
    """words: (word, scores array<bigint>, one for each of labels); priors of labels, None where a label has no text."""

    words: DataFrame
    labels: tuple[tuple[str, str], ...]
    priors: tuple[int | None, ...]
    defaults: Mapping[str, str]

    def apply(self, df: DataFrame, text: str, out: str = "labels") -> DataFrame:
        """df with a struct of a label for each dimension."""
        hashed = df.withColumn("__hash", F.sha2(F.col(text), 256))
        asked = hashed.where("__hash is not null").select("__hash", F.explode(words_of(F.col(text))).alias("word"))
        sums = [F.sum(F.col("scores")[i]).alias(f"s{i}") for i in range(len(self.labels))]
        found = asked.join(F.broadcast(self.words), "word").groupBy("__hash").agg(F.sum(F.when(F.col("word") == "", 1).otherwise(0)).alias("copies"), *sums)
        found = found.select("__hash", F.struct(*[self._best(d).alias(d) for d in self.defaults]).alias(out))
        # rows without a text would all meet in one task of the join
        silent = hashed.where("__hash is null").withColumn(out, F.lit(None).cast(found.schema[out].dataType))
        return hashed.where("__hash is not null").join(found, "__hash", "left").unionByName(silent).drop("__hash")

    def _best(self, dimension: str) -> Column:
        """The label of greatest score; copies of a text are divided out."""
        seen = [(i, x) for i, ((d, x), p) in enumerate(zip(self.labels, self.priors, strict=True)) if d == dimension and p is not None]
        if not seen:
            return F.lit(self.defaults[dimension])
        scores = [F.struct((F.lit(self.priors[i]) + F.expr(f"s{i} div copies")).alias("score"), F.lit(-i).alias("place"), F.lit(x).alias("label")) for i, x in seen]
        return F.array_max(F.array(*scores))["label"]


def fit(examples: DataFrame, text: str, domains: Mapping[str, Sequence[str]] = DOMAINS, defaults: Mapping[str, str] = DEFAULTS, *, most_words: int = MOST_WORDS, least_texts: int = LEAST_TEXTS) -> Model:
    """A model of examples with a text and a column for each dimension.

    A word's score for a label is the logarithm of the share of that label's texts that hold it, drawn towards the
    share of all labelled texts that do.  Every label has an equal part of the words: those that raise it most over the
    dimension's least likely label, in all its texts.
    """
    labels = tuple((d, x) for d, values in domains.items() for x in values)
    n = len(labels)
    told = F.array(*[F.coalesce(F.col(f"`{d}`") == x, F.lit(False)).cast("int") for d, x in labels])
    seen = examples.where(F.col(text).isNotNull()).select(told.alias("told"), F.explode(words_of(F.col(text))).alias("word"))
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("texts"), *[F.sum(F.col("told")[i]).alias(f"n{i}") for i in range(n)])
    counts = materialised(counts, "word-counts")
    # the empty word stands in every text, so its counts are those of labels
    whole = counts.where("word = ''").first()
    totals = [whole[f"n{i}"] if whole else 0 for i in range(n)]
    zero = F.lit(0).cast("bigint")

    def score(i: int) -> Column:
        if not totals[i]:
            return zero
        of = [k for k in range(n) if labels[k][0] == labels[i][0]]
        held = sum((F.col(f"n{k}") for k in of[1:]), F.col(f"n{of[0]}"))
        share = (F.col(f"n{i}") + SHRINK * held / sum(totals[k] for k in of)) / (totals[i] + SHRINK)
        return F.when(held > 0, F.round(UNIT * F.log(share)).cast("bigint")).otherwise(zero)

    scored = counts.where((F.col("texts") >= least_texts) & (F.col("word") != "")).select("word", F.array(*map(score, range(n))).alias("scores"), F.array(*[f"n{i}" for i in range(n)]).alias("held"))
    speaks = []
    for i, (d, _) in enumerate(labels):
        of = [F.col("scores")[k] for k in range(n) if labels[k][0] == d and totals[k]]
        if totals[i] and len(of) > 1:
            speaks.append(F.struct(F.lit(i).alias("label"), (F.col("held")[i] * (F.col("scores")[i] - F.least(*of))).alias("value")))
    none = F.array().cast("array<struct<label:int,value:bigint>>")
    voiced = scored.select("word", "scores", F.inline(F.array(*speaks) if speaks else none)).where("value > 0")
    # the first of each label are among the first of each part of it
    for keys in (["label", F.pmod(F.xxhash64("word"), F.lit(PARTS))], ["label"]):
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("value"), "word"))
        voiced = voiced.withColumn("place", place).where(F.col("place") <= most_words // n).drop("place")
    best = voiced.select("word", "scores").distinct()
    empty = examples.sparkSession.range(1).select(F.lit("").alias("word"), F.array_repeat(F.lit(0).cast("bigint"), n).alias("scores"))
    words = materialised(best.unionByName(empty), "model")
    return Model(words, labels, tuple(_prior(t) for t in totals), {d: defaults.get(d, values[0]) for d, values in domains.items()})


def _prior(texts: int) -> int | None:
    """A label's score before any word; only differences within a dimension count, so no total is needed."""
    return round(UNIT * math.log(texts)) if texts else None
