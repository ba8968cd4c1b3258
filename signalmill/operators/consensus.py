"""Merging peers' snapshots, the penalty quorum, and settlement."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ledger import EPOCH_BLOCKS

# Validators that must agree on a penalty, and broadcast epochs kept.
QUORUM, KEEP_BROADCAST_EPOCHS = 2, 3


def sequenced(broadcasts: DataFrame) -> DataFrame:
    """Of (sender, seq, arrival, ...): with accepted and reason, by arrival.

    A sequence number must be above all of the sender's before it; one without a
    positive value uses its number up, too, but isn't accepted.  A null number is refused and
    changes nothing.  uid_values is a map.
    """
    before = W.partitionBy("sender").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    last = F.greatest(F.max("seq").over(before), F.lit(-1))  # numbers below 0 never count
    out = broadcasts.withColumn("uid_values", positive("uid_values")).withColumn("__last", last)
    reason = F.when(F.col("seq").isNull(), "missing_seq").when(F.col("seq") <= F.col("__last"), "duplicate_or_old_seq").when(F.size("uid_values") == 0, "empty_payload").otherwise("accepted")
    return out.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted").drop("__last")


def sequenced_with_reset(broadcasts: DataFrame) -> DataFrame:
    """As sequenced(), but a number below a tenth of the last starts the sender afresh.

    The last number is then no running maximum, so a walk along each sender's arrivals
    in order keeps it; the walk holds one batch of rows at a time.
    """
    out = broadcasts.withColumn("uid_values", positive("uid_values"))
    ordered = out.withColumn("__full", F.size("uid_values") > 0).repartition("sender").sortWithinPartitions("sender", "arrival")
    columns = T.StructType([*out.schema.fields, T.StructField("reason", T.StringType())])
    return ordered.mapInArrow(_walked, columns).withColumn("accepted", F.col("reason") == "accepted")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, last = None, -1
    for batch in batches:
        reasons = []
        for sender, seq, full in zip(*(batch.column(c).to_pylist() for c in ("sender", "seq", "__full")), strict=True):
            if sender != current:
                current, last = sender, -1
            old = seq is not None and seq <= last and not (last > 0 and seq < last // 10)
            if seq is not None and not old:
                last = seq
            reasons.append("missing_seq" if seq is None else "duplicate_or_old_seq" if old else "accepted" if full else "empty_payload")
        yield batch.drop_columns(["__full"]).append_column("reason", pa.array(reasons, pa.string()))


def positive(column: str):
    """The entries of a map above 0."""
    return F.map_filter(F.col(column), lambda k, v: v > 0)


def snapshots(accepted: DataFrame, keep: int = KEEP_BROADCAST_EPOCHS) -> DataFrame:
    """(epoch, sender, uid, value) of each sender's last accepted snapshot of the newest `keep` epochs."""
    last = accepted.groupBy("epoch", "sender").agg(F.max_by("uid_values", "arrival").alias("uid_values"))
    newest = accepted.select("epoch").distinct().orderBy(F.desc("epoch")).limit(keep)
    return last.join(F.broadcast(newest), "epoch", "left_semi").select("epoch", "sender", F.explode("uid_values").alias("uid", "value"))


def without_stale_scheme(snapshots: DataFrame, epoch: int) -> DataFrame:
    """Drop epochs of another numbering: those above twice the epoch that came in."""
    return snapshots.where(F.col("epoch") <= 2 * epoch)


def flushed(snapshots: DataFrame, through: int) -> DataFrame:
    """What is left after all epochs up to `through` are flushed."""
    return snapshots.where(F.col("epoch") > through)


def without_sender(snapshots: DataFrame, sender: str) -> DataFrame:
    return snapshots.where(F.col("sender") != sender)


def totals(snapshots: DataFrame) -> DataFrame:
    """Sums over senders: (epoch, uid, value)."""
    return snapshots.groupBy("epoch", "uid").agg(F.sum("value").alias("value"))


def penalising(snapshots: DataFrame) -> DataFrame:
    """How many senders penalise: (epoch, uid, senders)."""
    return snapshots.where("value > 0").groupBy("epoch", "uid").agg(F.countDistinct("sender").alias("senders"))


def penalised(local: DataFrame, snapshots: DataFrame, quorum: int = QUORUM) -> DataFrame:
    """(epoch, uid, votes) with at least `quorum` votes; local (epoch, uid, value) has one vote."""
    own = local.where("value > 0").select("epoch", "uid").distinct().withColumn("votes", F.lit(1).cast("long"))
    peers = penalising(snapshots).select("epoch", "uid", F.col("senders").alias("votes"))
    return own.unionByName(peers).groupBy("epoch", "uid").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= quorum)


def to_uids(ledger: DataFrame, participants: DataFrame) -> DataFrame:
    """(epoch, uid, value) of registered hotkeys; the first uid of a hotkey counts."""
    registered = participants.groupBy("hotkey").agg(F.min("uid").alias("uid"))
    return ledger.join(registered, "hotkey").select("epoch", "uid", F.col("amount").alias("value"))


def merged_rewards(local: DataFrame, snapshots: DataFrame, participants: DataFrame, blacklist: DataFrame) -> DataFrame:
    """(epoch, uid, value): local points and those of peers, less peers' points for blacklisted hotkeys."""
    barred = participants.join(blacklist, "hotkey", "left_semi").select("uid")
    peers = totals(snapshots).join(barred, "uid", "left_anti").select("epoch", "uid", "value")
    return local.select("epoch", "uid", "value").unionByName(peers).groupBy("epoch", "uid").agg(F.sum("value").alias("value"))


def settled(rewards: DataFrame, penalties: DataFrame, participants: DataFrame) -> DataFrame:
    """(epoch, hotkey, reward): points above 0 that no quorum penalises, else 0; rows stay."""
    out = rewards.join(penalties.select("epoch", "uid", F.lit(True).alias("barred")), ["epoch", "uid"], "left")
    points = F.when((F.col("value") > 0) & F.col("barred").isNull(), F.col("value")).otherwise(F.lit(0))
    return out.join(participants.select("uid", "hotkey"), "uid").select("epoch", "hotkey", points.alias("reward"))


def net_scores(rewards: DataFrame, penalties: DataFrame) -> DataFrame:
    """(epoch, hotkey, score, start_block, stop_block) of all with rewards or penalties."""
    r = rewards.select("epoch", "hotkey", F.col("amount").alias("r"))
    p = penalties.select("epoch", "hotkey", F.col("amount").alias("p"))
    out = r.join(p, ["epoch", "hotkey"], "full_outer")
    score = F.coalesce("r", F.lit(0)) - F.coalesce("p", F.lit(0))
    return out.select("epoch", "hotkey", score.alias("score"), (F.col("epoch") * EPOCH_BLOCKS).alias("start_block"), ((F.col("epoch") + 1) * EPOCH_BLOCKS - 1).alias("stop_block"))
