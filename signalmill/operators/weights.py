"""From settled points to emitted weights: one row per registered uid, of which there are some hundreds.

Windows over all uids run in one task; uids are a bounded registry, not data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import Economy

U16 = 65_535
EPSILON = 1e-7


def everything():
    return W.partitionBy()


def point_weights(rewards: DataFrame, participants: DataFrame, economy: Economy, burn_uid: int = 0) -> DataFrame:
    """(uid, weight): shares of the emission by points, what is left to the burn uid.

    rewards: (hotkey, reward).  A point is worth at least a minimum; more than 100 % in all
    is scaled down.  The total counts unregistered hotkeys, which get no weight.
    """
    percent = F.greatest(economy.percent_needed(F.col("reward")), F.col("reward") * economy.min_percent_per_point)
    asked = rewards.select("hotkey", percent.alias("percent"))
    # one row, so that the total of rewards without any registered hotkey comes along, too
    total = asked.agg(F.coalesce(F.sum("percent"), F.lit(0.0)).alias("total"))
    out = participants.select("uid", "hotkey").join(asked, "hotkey", "left").crossJoin(F.broadcast(total))
    scale = F.when(F.col("total") > 100, 100 / F.col("total")).otherwise(1.0)
    own = F.coalesce("percent", F.lit(0.0)) * scale / 100
    return out.select("uid", F.when(F.col("uid") == burn_uid, 1 - F.least(F.col("total"), F.lit(100.0)) / 100).otherwise(own).alias("weight"))


def updated_scores(scores: DataFrame) -> DataFrame:
    """(uid, score) with NaN and null as 0."""
    return scores.withColumn("score", F.coalesce(F.nanvl(F.col("score"), F.lit(0.0)), F.lit(0.0)))


def resynced(scores: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """(uid, score) for the uids of now: 0 for new ones and where the hotkey has changed."""
    out = now.select("uid", "hotkey").join(before.select("uid", F.col("hotkey").alias("old")), "uid", "left").join(scores, "uid", "left")
    return out.select("uid", F.when(F.col("hotkey") == F.col("old"), F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("score"))


def l1_normalised(scores: DataFrame) -> DataFrame:
    """(uid, score, raw): scores over the sum of their sizes, which counts as 1 if it is 0 or unknown."""
    norm = F.sum(F.abs("score")).over(everything())
    norm = F.when(norm.isNull() | F.isnan(norm) | (norm == 0), 1.0).otherwise(norm)
    return scores.withColumn("raw", F.col("score") / norm)


def capped_share(weights: DataFrame, limit: float, weight: str = "weight") -> DataFrame:
    """weights with `capped`: summing to 1, none above limit; uniform if that can't be."""
    w = F.col(weight).cast("double")
    ordered = W.orderBy(F.col(weight), "uid")
    out = weights.withColumn("__sum", F.sum(w).over(everything())).withColumn("__n", F.count(F.lit(1)).over(everything())).withColumn("__share", w / F.when(F.col("__sum") == 0, F.lit(None)).otherwise(F.col("__sum")))
    out = out.withColumn("__k", F.row_number().over(ordered)).withColumn("__cum", F.sum("__share").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    # how many of the sorted shares stay below the limit if all above are cut to them
    below = F.col("__share") / ((F.col("__n") - F.col("__k")) * F.col("__share") + F.col("__cum") + EPSILON) < limit
    out = out.withColumn("__count", F.sum(below.cast("long")).over(everything()))
    # a count of 0 takes the last sum, as an index of -1 does
    at = F.when(F.col("__count") == 0, F.col("__n")).otherwise(F.col("__count"))
    out = out.withColumn("__at", F.max(F.when(F.col("__k") == at, F.col("__cum"))).over(everything()))
    cutoff = (limit * F.col("__at") - EPSILON) / (1 - limit * (F.col("__n") - F.col("__count"))) * F.col("__sum")
    fits = F.max("__share").over(everything()) <= limit
    cut = F.when(fits, w).otherwise(F.least(w, cutoff))
    out = out.withColumn("__uniform", (F.col("__sum") == 0) | (F.col("__n") * limit <= 1)).withColumn("__cut", cut)
    share = F.col("__cut") / F.sum("__cut").over(everything())
    out = out.withColumn("capped", F.when(F.col("__uniform"), F.lit(1.0) / F.col("__n")).otherwise(share))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def processed(weights: DataFrame, *, min_allowed: int, max_limit: float, quantile: float = 0.0) -> DataFrame:
    """(uid, weight): positive weights from the quantile up, capped; see the cases.

    No positive weight, or fewer uids than min_allowed: uniform over all.  Fewer positive
    weights than that: all uids, each with a little.  Else those below the quantile go,
    but never so many that fewer than min_allowed stay.
    """
    w = F.col("weight").cast("float")
    base = weights.select("uid", w.alias("weight")).withColumn("n", F.count(F.lit(1)).over(everything())).withColumn("m", F.count_if(F.col("weight") > 0).over(everything()))
    case = F.when((F.col("m") == 0) | (F.col("n") < min_allowed), "uniform").when(F.col("m") < min_allowed, "all").otherwise("positive")
    base = base.withColumn("case", case)
    q = F.least(F.lit(quantile), F.greatest(F.col("m") - min_allowed, F.lit(0)) / F.greatest(F.col("m"), F.lit(1)))
    # linear interpolation between neighbours in the order of positive weights
    rank = F.row_number().over(W.partitionBy(F.col("weight") > 0).orderBy("weight", "uid")) - 1
    base = base.withColumn("__r", F.when(F.col("weight") > 0, rank)).withColumn("__p", q * (F.col("m") - 1))
    low = F.max(F.when(F.col("__r") == F.floor("__p"), F.col("weight").cast("double"))).over(everything())
    high = F.max(F.when(F.col("__r") == F.ceil("__p"), F.col("weight").cast("double"))).over(everything())
    base = base.withColumn("__cut", (low + (high - low) * (F.col("__p") - F.floor("__p"))).cast("float"))
    kept = base.where((F.col("case") != "positive") | ((F.col("weight") > 0) & (F.col("weight") >= F.col("__cut"))))
    value = F.when(F.col("case") == "uniform", 1.0).when(F.col("case") == "all", 1e-5 + F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(0.0)).otherwise(F.col("weight").cast("double"))
    capped = capped_share(kept.select("uid", "case", "n", value.alias("weight")), max_limit)
    return capped.select("uid", F.when(F.col("case") == "uniform", F.lit(1.0) / F.col("n")).otherwise(F.col("capped")).alias("weight"))


def emitted(weights: DataFrame) -> DataFrame:
    """(uid, value): weights over the largest as 16-bit numbers, halves to even, zeros left out; a negative weight is an error."""
    checked = F.when(F.col("weight") < 0, F.raise_error(F.lit("negative weight"))).otherwise(F.col("weight").cast("double"))
    share = F.col("weight") / F.max("weight").over(everything())
    out = weights.select("uid", checked.alias("weight")).withColumn("value", F.rint(share * U16).cast("int"))
    return out.where("value > 0").select("uid", "value")


def dense(weights: DataFrame, n: int) -> DataFrame:
    """(uid, weight) for every uid below n, 0 where there is none."""
    uids = weights.sparkSession.range(n).select(F.col("id").cast("int").alias("uid"))
    return uids.join(weights.select("uid", "weight"), "uid", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
