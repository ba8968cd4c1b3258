"""Commitments: votes on workers, and changes since the last look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def single_commitment(uid: Column, score: Column, version: str = "1.0") -> Column:
    return F.to_json(F.struct(uid.cast("int").alias("miner_uid"), score.cast("int").alias("score"), F.lit(version).alias("version")))


def multi_commitment(scores: Column, version: str = "1.0") -> Column:
    """scores: map from uid to score."""
    return F.to_json(F.struct(scores.cast("map<string,int>").alias("scores"), F.lit(version).alias("version")))


def parsed(data: Column) -> Column:
    """struct<miner_uid, score, scores, raw>: of either shape of JSON, or the text itself in raw."""
    p = F.from_json(data, "miner_uid int, score int, scores map<string,int>")
    known = p["miner_uid"].isNotNull() | p["scores"].isNotNull()
    return F.struct(p["miner_uid"].alias("miner_uid"), p["score"].alias("score"), p["scores"].alias("scores"), F.when(~F.coalesce(known, F.lit(False)), data).alias("raw"))


def votes(commitments: DataFrame) -> DataFrame:
    """(voter, uid, score): one row for each score that can be read."""
    p = commitments.select(F.substring("hotkey", 1, 16).alias("voter"), parsed(F.col("data")).alias("p"))
    many = p.where(F.col("p.scores").isNotNull()).select("voter", F.explode("p.scores").alias("uid", "score"))
    one = p.where(F.col("p.scores").isNull() & F.col("p.miner_uid").isNotNull()).select("voter", F.col("p.miner_uid").cast("string").alias("uid"), F.col("p.score").alias("score"))
    return many.unionByName(one).select("voter", F.expr("try_cast(uid AS int)").alias("uid"), "score").where("uid is not null and score is not null")


def tallied(votes: DataFrame) -> DataFrame:
    """(uid, yes, no, voters, weight): weight is the share of yes."""
    out = votes.groupBy("uid").agg(F.count_if(F.col("score") == 1).alias("yes"), F.count_if(F.col("score") != 1).alias("no"), F.sort_array(F.collect_list("voter")).alias("voters"))
    n = F.col("yes") + F.col("no")
    return out.withColumn("weight", F.when(n > 0, F.col("yes") / n).otherwise(0.0))


def changed(commitments: DataFrame, last_seen: DataFrame) -> DataFrame:
    """Commitments of a later block than was seen, each to reward or to penalise."""
    seen = last_seen.select("hotkey", F.col("block").alias("__seen"))
    out = commitments.join(seen, "hotkey", "left").where(F.col("block") > F.coalesce("__seen", F.lit(0))).drop("__seen")
    return out.withColumn("action", F.when(parsed(F.col("data"))["score"] == 1, "REWARD").otherwise("PENALIZE"))


def seen_after(commitments: DataFrame, last_seen: DataFrame) -> DataFrame:
    """(hotkey, block) to be kept for the next look."""
    return commitments.select("hotkey", "block").unionByName(last_seen).groupBy("hotkey").agg(F.max("block").alias("block"))
