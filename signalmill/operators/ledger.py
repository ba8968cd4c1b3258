"""Points by epoch: accumulation, retention and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Seconds to a block, blocks to an epoch, and epochs kept.
BLOCK_SECONDS, EPOCH_BLOCKS, KEEP_EPOCHS = 12, 100, 10


def block(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / BLOCK_SECONDS).cast("long")


def epoch(block: Column, blocks: int = EPOCH_BLOCKS) -> Column:
    return F.floor(block / blocks).cast("long")


def accumulated(entries: DataFrame) -> DataFrame:
    """Of (epoch, hotkey, amount): one row per epoch and hotkey with the sum."""
    return entries.groupBy("epoch", "hotkey").agg(F.sum("amount").alias("amount"))


def _ranked_epochs(ledger: DataFrame) -> DataFrame:
    """The distinct epochs, newest first: one small row each."""
    return ledger.select("epoch").distinct().withColumn("age", F.row_number().over(W.orderBy(F.desc("epoch"))))


def retained(ledger: DataFrame, keep: int = KEEP_EPOCHS) -> DataFrame:
    """Rows of the newest `keep` epochs; those few epochs are broadcast."""
    newest = ledger.select("epoch").distinct().orderBy(F.desc("epoch")).limit(keep)
    return ledger.join(F.broadcast(newest), "epoch", "left_semi")


def at_relative_epoch(ledger: DataFrame, back: int) -> DataFrame:
    """Rows of an epoch counted from the newest stored one, which is -1."""
    return ledger.join(_ranked_epochs(ledger).where(F.col("age") == -back).select("epoch"), "epoch", "left_semi")


def points_of(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """Every (epoch, hotkey) of keys with its amount, 0 where the ledger has none."""
    return keys.join(ledger, ["epoch", "hotkey"], "left").withColumn("amount", F.coalesce("amount", F.lit(0)))


def epoch_maps(ledger: DataFrame) -> DataFrame:
    """One row per epoch with a map from hotkey to amount, as snapshots are sent."""
    pairs = F.sort_array(F.collect_list(F.struct("hotkey", "amount")))
    return ledger.groupBy("epoch").agg(F.map_from_entries(pairs).alias("amounts"))
