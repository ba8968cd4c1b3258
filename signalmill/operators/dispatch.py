"""Who may work, who is on cooldown, and which worker gets which batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lifecycle import PROCESSING, UNPROCESSED
from .ranges import intervals, numbered, within
from .validation import seeded_order

# Items to a batch, stakes that make a validator, failures that start a cooldown, its lengths in seconds, and batches in flight.
BATCH, STAKE_LIMIT, FAILURES = 3, 4096, 10
BACKOFF = (30, 60, 120, 300, 600)
MAX_IN_FLIGHT, MAX_PENDING, MAX_TARGETS = 4, 256, 32


def validators(participants: DataFrame, threshold: float, manual: DataFrame | None = None) -> DataFrame:
    """Distinct hotkeys with permit and stake, and those of a manual list."""
    out = participants.where(F.col("validator_permit") & (F.col("stake") >= threshold)).select("hotkey")
    return (out if manual is None else out.unionByName(manual.select("hotkey"))).distinct()


def available(participants: DataFrame, limit: float = STAKE_LIMIT) -> DataFrame:
    """Serving, and not a validator by permit and stake."""
    return participants.where(F.col("is_serving") & ~(F.col("validator_permit") & (F.col("stake") > limit)))


def admissions(requests: DataFrame, participants: DataFrame, allow_unregistered: bool = False, need_permit: bool = True) -> DataFrame:
    """requests with reason, null if admitted, and priority by stake."""
    known = participants.select("hotkey", "validator_permit", "stake")
    out = requests.join(known, "hotkey", "left")
    registered = F.col("stake").isNotNull()
    reason = F.when(F.coalesce(F.length("hotkey"), F.lit(0)) == 0, "missing_hotkey").when(F.lit(not allow_unregistered) & ~registered, "unregistered").when(F.lit(need_permit) & ~F.coalesce("validator_permit", F.lit(False)), "no_permit")
    return out.withColumn("reason", reason).withColumn("priority", F.coalesce("stake", F.lit(0.0))).drop("validator_permit", "stake")


def numbered_batches(items: DataFrame, order: str, size: int = BATCH, limit: int = MAX_PENDING) -> DataFrame:
    """The first items by arrival, `limit` batches at most, with their batch number; what is left waits for the next poll."""
    first = items.orderBy(order, "item_id").limit(limit * size)
    place = F.row_number().over(W.orderBy(order, "item_id")) - 1
    return first.withColumn("batch", F.floor(place / size).cast("long"))


def chosen_uids(participants: DataFrame, k: int, seed: str, include: list[int] | None = None, exclude: list[int] | None = None) -> DataFrame:
    """k uids, or all there are: included ones first, then a fixed shuffle of the rest."""
    first = F.when(F.col("uid").isin(include), 0).otherwise(1) if include else F.lit(1)
    rest = participants.where(~F.col("uid").isin(exclude)) if exclude else participants
    return rest.orderBy(first, seeded_order(seed, F.col("uid")), "uid").limit(k)


def cooldowns(events: DataFrame) -> DataFrame:
    """Of (hotkey, at, ok): per hotkey the failures in a row at the end, the level, and until when it cools down.

    A success clears everything; of a run of failures each from the tenth on raises the
    level by one.  Hotkeys whose last event is a success aren't listed.
    """
    # two sums that are combined before the shuffle, so no worker's history meets in one task
    place = F.struct("at", "event_id")
    success = events.where("ok").groupBy("hotkey").agg(F.max(place).alias("__success"))
    since = events.where(~F.col("ok")).join(success, "hotkey", "left").where(F.col("__success").isNull() | (place > F.col("__success")))
    ended = since.groupBy("hotkey").agg(F.count(F.lit(1)).alias("failures"), F.max("at").alias("last_failure"))
    level = F.least(F.greatest(F.col("failures") - (FAILURES - 1), F.lit(0)), F.lit(len(BACKOFF)))
    pause = F.element_at(F.array(*map(F.lit, BACKOFF)), F.greatest(level, F.lit(1)).cast("int"))
    out = ended.withColumn("level", level.cast("int")).withColumn("until", F.when(level > 0, F.timestamp_seconds(F.unix_micros("last_failure") / 1e6 + pause)))
    return out.drop("last_failure")


def cooling(cooldowns: DataFrame, as_of: Column) -> DataFrame:
    return cooldowns.where(F.col("until").isNotNull() & (as_of < F.col("until")))


def cooldown_stats(cooldowns: DataFrame, as_of: Column) -> DataFrame:
    """One row: tracked, on_cooldown."""
    return cooldowns.agg(F.count(F.lit(1)).alias("tracked"), F.count_if(F.col("until").isNotNull() & (as_of < F.col("until"))).alias("on_cooldown"))


def with_room(participants: DataFrame, in_flight: DataFrame, most: int = MAX_IN_FLIGHT) -> DataFrame:
    """Workers with fewer than `most` batches in flight."""
    full = in_flight.groupBy("hotkey").count().where(F.col("count") >= most)
    return participants.join(full, "hotkey", "left_anti")


def assigned(batches: DataFrame, workers: DataFrame, seed: str, me: str | None = None, barred: DataFrame | None = None) -> DataFrame:
    """(batch, hotkey): batches in order with workers in a fixed shuffle, as far as both reach; never oneself nor a barred one."""
    if me is not None:
        workers = workers.where(F.col("hotkey") != me)
    if barred is not None:
        workers = workers.join(barred.select("hotkey"), "hotkey", "left_anti")
    shuffled = workers.select("hotkey", (F.row_number().over(W.orderBy(seeded_order(seed, F.col("hotkey")), "hotkey")) - 1).alias("place"))
    numbers = batches.select("batch").distinct().withColumn("place", F.row_number().over(W.orderBy("batch")) - 1)
    return numbers.join(shuffled, "place").select("batch", "hotkey")


def free_slots(workers: DataFrame, in_flight: DataFrame, each: int, most: int = MAX_IN_FLIGHT) -> DataFrame:
    """(hotkey, slots): batches that a worker may be given now, at most `each` and as many as are missing to `most` in flight."""
    busy = in_flight.groupBy("hotkey").agg(F.count(F.lit(1)).alias("__busy"))
    free = F.least(F.lit(each), F.lit(most) - F.coalesce("__busy", F.lit(0)))
    return workers.select("hotkey").join(busy, "hotkey", "left").select("hotkey", free.alias("slots")).where("slots > 0")


def planned(
    items: DataFrame,
    workers: DataFrame,
    in_flight: DataFrame,
    cooldowns: DataFrame,
    as_of: Column,
    seed: str,
    *,
    order: str = "arrived",
    me: str | None = None,
    barred: DataFrame | None = None,
    each: int = 1,
    size: int = BATCH,
    pending: int | None = MAX_PENDING,
) -> DataFrame:
    """items (item_id and order) with their batch and the hotkey that it goes to, null if it waits for the next poll.

    Items make batches by arrival.  Workers in a fixed shuffle, without oneself, barred ones and those on
    cooldown, offer their free slots: as intervals laid end to end, in which the batches' numbers lie.  With each=1 a batch
    meets one worker by place; with more a worker is filled before the next one is asked.  `pending` bounds
    the batches that go out; None is no bound.
    """
    if me is not None:
        workers = workers.where(F.col("hotkey") != me)
    for out in [cooling(cooldowns, as_of), *([] if barred is None else [barred])]:
        workers = workers.join(out.select("hotkey"), "hotkey", "left_anti")
    offers = intervals(free_slots(workers, in_flight, each), F.col("slots"), seeded_order(seed, F.col("hotkey")), "hotkey")
    batches = numbered(items, order, "item_id").withColumn("batch", F.floor(F.col("ordinal") / size).cast("long")).drop("ordinal")
    numbers = batches.select("batch").distinct()
    if pending is not None:
        numbers = numbers.where(F.col("batch") < pending)
    pairs = within(numbers, "batch", offers, each).select("batch", "hotkey")
    return batches.join(pairs, "batch", "left")


def delivered(plan: DataFrame, replies: DataFrame, as_of: Column, full: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What became of a plan, by replies (batch, code), of which a failure to send has none.

    First its items with status, owner and start_time: accepted ones (200) are in processing; all items of any
    other batch are queued again, as are those whose worker, one of `full`, had no slot left when its turn came.
    Second the workers' events (hotkey, at, event_id, ok) for their cooldowns: a worker that was full wasn't asked, so it has none.
    """
    out = plan.join(replies.select("batch", "code"), "batch", "left")
    taken = F.lit(False)
    if full is not None:
        out = out.join(full.select("hotkey", F.lit(True).alias("__full")).distinct(), "hotkey", "left")
        taken = F.coalesce("__full", F.lit(False))
    sent = F.col("hotkey").isNotNull() & ~taken
    ok = sent & F.coalesce(F.col("code") == 200, F.lit(False))
    rows = out.withColumn("__sent", sent).withColumn("__ok", ok)
    items = rows.select("item_id", "batch", F.when(F.col("__ok"), PROCESSING).otherwise(UNPROCESSED).alias("status"), F.when(F.col("__sent"), F.col("hotkey")).alias("hotkey"), F.when(F.col("__ok"), as_of).alias("start_time"))
    events = rows.where("__sent").groupBy("batch", "hotkey").agg(F.first("__ok").alias("ok"))
    return items, events.select("hotkey", as_of.alias("at"), F.col("batch").alias("event_id"), "ok")


def broadcast_targets(participants: DataFrame, allowlist: DataFrame, me: str, seed: str, most: int = MAX_TARGETS) -> DataFrame:
    """Serving peers on the allowlist, without oneself, at most `most`."""
    peers = participants.where(F.col("is_serving") & (F.col("hotkey") != me)).join(allowlist, "hotkey", "left_semi")
    return peers.orderBy(seeded_order(seed, F.col("uid")), "uid").limit(most)


def poll_backoff(errors: Column, most: int = 300) -> Column:
    """Seconds to wait after errors in a row."""
    return F.least(F.pow(F.lit(2.0), F.least(errors, F.lit(30))), F.lit(float(most)))
