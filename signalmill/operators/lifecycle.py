"""Work items from being queued to being submitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNPROCESSED, PROCESSING, PROCESSED = "Unprocessed", "Processing", "Processed"
# Seconds that an item may be in processing, by kind, and items kept.
TIMEOUTS = {"post": 300, "chat": 300, "article": 900}
KEEP_ITEMS = 1000


def current(events: DataFrame) -> DataFrame:
    """Of (item_id, seq, event, at, hotkey): the state of every item after its last event.

    Events: add, process (sets the clock and the owner), result (sets the clock, if the item is in processing), done,
    reset (keeps the owner), submitted, rewarded, delete (the item is new from then on).
    """
    since = F.coalesce(F.max(F.when(F.col("event") == "delete", F.col("seq"))).over(W.partitionBy("item_id")), F.lit(-1))
    alive = events.withColumn("__since", since).where(F.col("seq") > F.col("__since"))
    is_ = lambda *names: F.col("event").isin(*names)
    last = lambda value, test: F.max_by(value, F.when(test, F.col("seq")))
    # a result of an item that isn't in processing any more is no delivery
    before = W.partitionBy("item_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    alive = alive.withColumn("__in", F.last(F.when(is_("add", "process", "done", "reset"), F.col("event")), ignorenulls=True).over(before))
    clock = is_("process", "reset") | (is_("result") & (F.col("__in") == "process"))
    state = F.when(is_("process"), PROCESSING).when(is_("done"), PROCESSED).otherwise(UNPROCESSED)
    out = alive.groupBy("item_id").agg(
        last(state, is_("add", "process", "done", "reset")).alias("status"),
        last(F.when(~is_("reset"), F.col("at")), clock).alias("start_time"),
        last(F.col("hotkey"), is_("add", "process") & F.col("hotkey").isNotNull()).alias("hotkey"),
        F.max(is_("submitted")).alias("submitted"),
        F.max(is_("rewarded")).alias("rewarded"),
    )
    return out.withColumn("status", F.coalesce("status", F.lit(UNPROCESSED)))


def inserted(items: DataFrame, new: DataFrame) -> DataFrame:
    """items with those of new whose ids are new; an old one only gets an owner if it has none."""
    owners = new.groupBy("item_id").agg(F.min("hotkey").alias("__owner"))
    kept = items.join(owners, "item_id", "left").withColumn("hotkey", F.coalesce("hotkey", "__owner")).drop("__owner")
    fresh = new.dropDuplicates(["item_id"]).join(items.select("item_id"), "item_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def with_status(items: DataFrame, status: str | None = None, hotkey: str | None = None) -> DataFrame:
    if status is not None:
        items = items.where(F.col("status") == status)
    return items if hotkey is None else items.where(F.col("hotkey") == hotkey)


def looked_up(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Every item_id of ids with its item's columns, null where there is none, and `is_rewarded`, false there."""
    return ids.select("item_id").distinct().join(items, "item_id", "left").withColumn("is_rewarded", F.coalesce("rewarded", F.lit(False)))


def marked(items: DataFrame, ids: DataFrame, **changes: Column) -> DataFrame:
    """items, those of ids with some columns changed; ids that aren't there change nothing."""
    out = items.join(ids.select("item_id").distinct().withColumn("__marked", F.lit(True)), "item_id", "left")
    new = {c: F.when(F.col("__marked"), v).otherwise(F.col(c)) for c, v in changes.items()}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in items.columns])


def submitted(items: DataFrame, ids: DataFrame) -> DataFrame:
    return marked(items, ids, submitted=F.lit(True))


def rewarded(items: DataFrame, ids: DataFrame) -> DataFrame:
    return marked(items, ids, rewarded=F.lit(True))


def deleted(items: DataFrame, ids: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """items without those of ids and those that meet a condition; a condition that is null keeps its row."""
    if ids is not None:
        items = items.join(ids.select("item_id"), "item_id", "left_anti")
    return items if where is None else items.where(~F.coalesce(where, F.lit(False)))


def ready(items: DataFrame) -> DataFrame:
    """Processed and not submitted yet."""
    return items.where((F.col("status") == PROCESSED) & ~F.col("submitted"))


def timed_out(items: DataFrame, as_of: Column, kind: str = "post") -> DataFrame:
    """In processing for longer than the kind may be."""
    return items.where((F.col("status") == PROCESSING) & F.col("start_time").isNotNull() & (F.unix_micros(as_of) - F.unix_micros("start_time") > TIMEOUTS[kind] * 1_000_000))


def requeued(items: DataFrame, as_of: Column, kind: str = "post") -> tuple[DataFrame, DataFrame]:
    """items with those timed out reset, and (hotkey, penalty) of their owners."""
    late = timed_out(items, as_of, kind)
    out = items.join(late.select("item_id", F.lit(True).alias("__late")), "item_id", "left")
    out = out.withColumn("status", F.when(F.col("__late"), UNPROCESSED).otherwise(F.col("status"))).withColumn("start_time", F.when(F.col("__late").isNull(), F.col("start_time"))).drop("__late")
    return out, late.groupBy("hotkey").agg(F.count(F.lit(1)).alias("penalty"))


def pruned(items: DataFrame, as_of: Column, max_age_seconds: int, keep: int = KEEP_ITEMS, nulls_go_first: bool = True) -> DataFrame:
    """Items not submitted, not too old, and of those the newest `keep`.

    nulls_go_first: items without a clock are the first to go (posts) or the last (chat, articles).
    """
    left = items.where(~F.col("submitted")).where(F.col("start_time").isNull() | (F.unix_seconds(as_of) - F.unix_seconds("start_time") <= max_age_seconds))
    newest = F.col("start_time").desc_nulls_last() if nulls_go_first else F.col("start_time").desc_nulls_first()
    return left.orderBy(newest, "item_id").limit(keep)


def accepted_batches(results: DataFrame, items: DataFrame, locked: DataFrame) -> DataFrame:
    """Of (batch, item_id, hotkey): (batch, accepted); a batch falls with any item that is locked, not in processing, another's or unknown. Missing ids are skipped."""
    state = items.select("item_id", "status", F.col("hotkey").alias("owner"))
    out = results.where("item_id is not null").join(state, "item_id", "left").join(locked.select("item_id", F.lit(True).alias("locked")).distinct(), "item_id", "left")
    fine = F.coalesce((F.col("status") == PROCESSING) & (F.col("owner") == F.col("hotkey")), F.lit(False)) & F.col("locked").isNull()
    return out.groupBy("batch").agg(F.bool_and(fine).alias("accepted"))


def rewarded_once(rewards: DataFrame) -> DataFrame:
    """The first reward of each item, by seq."""
    return rewards.withColumn("__r", F.row_number().over(W.partitionBy("item_id").orderBy("seq"))).where("__r = 1").drop("__r")


def pending(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """What was fetched and what is stored unprocessed, repeats and all."""
    return fetched.unionByName(with_status(stored, UNPROCESSED), allowMissingColumns=True)


def new_signals(signals: DataFrame, seen: DataFrame) -> DataFrame:
    """One-shot signals not consumed before, once each."""
    return signals.dropDuplicates(["signal_id"]).join(seen, "signal_id", "left_anti")
