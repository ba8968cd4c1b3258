"""Points by epoch from a stream of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.ledger import BLOCK_SECONDS, EPOCH_BLOCKS, KEEP_EPOCHS, accumulated, block, epoch, retained
from ..tables import VersionedTable

SECONDS = BLOCK_SECONDS * EPOCH_BLOCKS


def epoch_points(results: DataFrame, delay_epochs: int = 2) -> DataFrame:
    """Of a stream (at, hotkey, amount): (epoch, hotkey, amount), each once it is `delay_epochs` past.

    An epoch is a window of its blocks' seconds; the watermark is what delays settlement.
    """
    kept = results.withWatermark("at", f"{delay_epochs * SECONDS} seconds")
    sums = kept.groupBy(F.window("at", f"{SECONDS} seconds"), "hotkey").agg(F.sum("amount").alias("amount"))
    return sums.select(F.floor(F.unix_seconds("window.start") / SECONDS).cast("long").alias("epoch"), "hotkey", "amount")


def deduplicated(rewards: DataFrame, within: str = "1 hour") -> DataFrame:
    """A stream (at, item_id, ...) with one reward for each item."""
    return rewards.withWatermark("at", within).dropDuplicatesWithinWatermark(["item_id"])


LEDGER = "epoch bigint, hotkey string, amount bigint"


def landing(ledger: VersionedTable, source: str, keep: int = KEEP_EPOCHS) -> Callable[[DataFrame, int], None]:
    """A sink for batches (at, hotkey, amount): their sums are added to the epochs of a ledger, the newest `keep` of which stay.

    A late row lands in its epoch as long as that is kept.  An epoch that is among the newest at the end was so
    whenever it was there, so its sum is whole in whatever order rows come.  Each version of the ledger is marked with the last
    batch of every source, so a batch that is played again, as after a crash between the switch and
    the stream's own commit, changes nothing.
    """

    def land(rows: DataFrame, batch: int) -> None:
        table = VersionedTable(rows.sparkSession, ledger.path, ledger.schema)
        marks = table.marks()
        if marks.get(source, -1) >= batch:
            return
        new = rows.select(epoch(block(F.col("at"))).alias("epoch"), "hotkey", F.col("amount").cast("long").alias("amount"))
        kept = retained(accumulated(table.read().unionByName(accumulated(new))), keep)
        table.replace(kept, **(marks | {source: batch}))

    return land


def into_ledger(results: DataFrame, ledger: VersionedTable, source: str, checkpoint: str, keep: int = KEEP_EPOCHS) -> DataStreamWriter:
    """A stream (at, hotkey, amount) that lands in a ledger, with no watermark; start it with any trigger."""
    return results.writeStream.foreachBatch(landing(ledger, source, keep)).outputMode("update").option("checkpointLocation", checkpoint)
