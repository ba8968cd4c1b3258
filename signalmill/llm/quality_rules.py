"""Quality rules: an ordered decision list learnt by sequential covering.

Per text, an Arrow UDF counts plain statistics.  From labelled statistics,
:func:`learn` grows conjunctions of thresholds by information gain on one part
of the rows, prunes them on the other, and keeps a rule only if it is precise on
both and met often enough that this is no luck.  Conditions that change nothing go.
The list is emitted as one chained Spark conditional, so applying it is a projection.

Defined results: a null or empty text has zero words and fails the base rules;
rows with equal doc_id are judged one by one, and a labelled doc_id of several texts
gives one of them; without labels, or without rows labelled 0, the list is empty and
only the base rules reject; ties between conditions go to the first feature and the
lowest threshold; extra columns come along, and names under the prefix are the
result's; empty tables give an empty result.  A text is counted whole, whatever its
length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import batches, hasher, shingles, text_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_lines", "n_chars")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True

#: At most about this many labelled rows are used to learn the list.
MAX_LABELLED = 20_000


def count_batch(texts: list[bytes]) -> np.ndarray:
    """A row of COUNTS for each text."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    h = hasher()
    for first, part in batches(texts):
        words, at = h.words(part, fold=False)
        for i, t in enumerate(part):
            w = words[at[i] : at[i + 1]]
            data = np.frombuffer(t, np.uint8)
            lines = t.split(b"\n")
            full = [x for x in lines if x.strip()]
            repeated = 0
            if len(w) > 3:
                _, back, times = np.unique(shingles(w, 3), return_inverse=True, return_counts=True)
                if len(times) < len(back):
                    twice = np.zeros(len(w), bool)
                    starts = times[back] > 1
                    for k in range(3):
                        twice[k : k + len(starts)] |= starts
                    repeated = int(twice.sum())
            points = (data & 0xC0) != 0x80
            out[first + i] = (
                len(w),
                int((points & ~h.spaces[data]).sum()),
                int(SYMBOLS[data].sum()),
                len(full) - len(set(full)),
                repeated,
                int(UPPER[data].sum()),
                int(DIGIT[data].sum()),
                len(lines),
                int(points.sum()),
            )
    return out


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(text: pa.Array) -> pa.Array:
    rows = np.concatenate([np.zeros((0, len(COUNTS)), np.int64), *[count_batch(part) for _, part in text_batches(text)]])
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], list(COUNTS))


def features(c: Column) -> dict[str, Column]:
    """Ratios that the rules test, of a struct of COUNTS."""
    words, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["n_chars"], F.lit(1))
    return {
        "symbols_per_word": c["n_symbols"] / words,
        "upper_share": c["n_upper"] / chars,
        "digit_share": c["n_digits"] / chars,
        "dup_line_share": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
        "repeat_share": c["n_repeat_words"] / words,
        "word_length": c["word_chars"] / words,
        "n_words": c["n_words"].cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, features: dict[str, Column]) -> Column:
        x = features[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects, else the text is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejecting(self, table: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(table.values())))
        return np.any([np.all([c.holds(table) for c in rule], axis=0) for rule in self.rules] or [np.zeros(n, bool)], axis=0)

    def column(self, counts: Column) -> Column:
        """The text of the first rule that holds, null for none."""
        named, out = features(counts), None
        for rule in self.rules:
            test = rule[0].column(named)
            for c in rule[1:]:
                test = test & c.column(named)
            text = " and ".join(map(str, rule))
            out = F.when(test, text) if out is None else out.when(test, text)
        return F.lit(None).cast("string") if out is None else out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _grow(table, bad, inside, most: int, cuts: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best = (0.0, None)
        for name, x in table.items():
            values = np.unique(x[inside])
            # half-way between neighbours, so that a rule leaves a margin on both sides
            middles = (values[1:] + values[:-1]) / 2
            picks = np.searchsorted(values, np.quantile(x[inside], np.linspace(0, 1, cuts + 2)[1:-1], method="lower"))
            for threshold in middles[np.unique(picks[picks < len(middles)])]:
                for above in (True, False):
                    hit = inside & (x > threshold if above else x <= threshold)
                    p = int((hit & bad).sum())
                    if (gain := _gain(p, int(hit.sum()) - p, p0, n0)) > best[0] + 1e-9:
                        best = (gain, Condition(name, above, float(threshold)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = inside & best[1].holds(table)
    return rule


def sure_share(p: int, n: int, z: float = 1.645) -> float:
    """The lower end of Wilson's interval for a share of p in p + n."""
    m = p + n
    if not m:
        return 0.0
    return (p / m + z * z / (2 * m) - z * math.sqrt(p / m * (1 - p / m) / m + z * z / (4 * m * m))) / (1 + z * z / m)


def _simpler(rule: list[Condition], table: dict[str, np.ndarray], rows: np.ndarray) -> list[Condition]:
    """The rule without conditions that the others imply on these rows."""
    hit = rows & np.all([c.holds(table) for c in rule], axis=0)
    for c in list(rule):
        rest = [x for x in rule if x is not c]
        if rest and np.array_equal(rows & np.all([x.holds(table) for x in rest], axis=0), hit):
            rule = rest
    return rule


def learn(table: dict[str, np.ndarray], good: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.95, min_sure: float = 0.8, min_rows: int = 5, min_pruning: int = 3, cuts: int = 63) -> DecisionList:
    """Sequential covering of the rows that are not good.

    Every third row prunes, the others grow.  A rule stays if it rejects with
    min_precision on both parts, at least min_rows rows where it grew and min_pruning
    where it was pruned, which it never saw while it grew, and so many on both together
    that its precision is min_sure even if they flatter it.
    """
    bad = ~np.asarray(good, bool)
    prune = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < max_rules and (bad & left & ~prune).sum() >= min_rows:
        rule = _grow(table, bad, left & ~prune, max_conditions, cuts)
        if not rule:
            break

        def worth(cut: list[Condition], part: np.ndarray) -> tuple[int, int]:
            hit = part & left & np.all([c.holds(table) for c in cut], axis=0)
            return int((hit & bad).sum()), int((hit & ~bad).sum())

        def score(cut: list[Condition]) -> float:
            p, n = worth(cut, prune)
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (round(score(r), 9), -len(r)))
        parts = [worth(rule, ~prune), worth(rule, prune)]
        if any(p < least or p < min_precision * (p + n) for (p, n), least in zip(parts, (min_rows, min_pruning), strict=True)) or sure_share(*map(sum, zip(*parts, strict=True))) < min_sure:
            break
        rules.append(tuple(_simpler(rule, table, left)))
        left &= ~np.all([c.holds(table) for c in rule], axis=0)
    return DecisionList(tuple(rules))


def fit(documents: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learn the list from labels.quality of at most max_labelled rows, those of smallest hash of doc_id."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # a doc_id of many rows gives one text
    labelled = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("__quality").alias("__quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
    counted = labelled.withColumn("__c", text_counts("text"))
    named = features(F.col("__c"))
    rows = counted.select("doc_id", "__quality", *[c.alias(k) for k, c in named.items()]).toPandas()
    rows = rows.sort_values(["doc_id", *named], kind="stable")
    rows = rows.iloc[np.argsort((rows["doc_id"].to_numpy(np.int64) * 2654435761) % (1 << 32), kind="stable")]
    if rows.empty:
        return DecisionList(())
    return learn({k: rows[k].to_numpy(float) for k in named}, rows["__quality"].to_numpy() == 1)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def judged(documents: DataFrame, rules: DecisionList, prefix: str = "__quality_") -> DataFrame:
    """All columns of documents and, under prefix: counts, base_failed, rule, kept."""
    c = F.col(f"{prefix}counts")
    out = documents.withColumn(f"{prefix}counts", text_counts("text"))
    out = out.withColumn(f"{prefix}base_failed", base_failed(c)).withColumn(f"{prefix}rule", rules.column(c))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & F.col(f"{prefix}rule").isNull())
