"""Keyed state over streams: sequence numbers, work items and cooldowns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dispatch import BACKOFF, FAILURES
from ..operators.lifecycle import PROCESSED, PROCESSING, TIMEOUTS, UNPROCESSED


def _in_order(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(list(by), kind="stable")


class SequenceProcessor(StatefulProcessor):
    """Per sender: accepts sequence numbers above the last; with resets, one below a tenth of it starts afresh."""

    OUTPUT = "sender string, arrival bigint, seq bigint, accepted boolean, reason string"

    def __init__(self, resets: bool = False):
        self.resets = resets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else -1
        out = []
        for r in _in_order(rows, "arrival").itertuples():
            if pd.isna(r.seq):
                out.append((key[0], int(r.arrival), None, False, "missing_seq"))
                continue
            seq = int(r.seq)
            if seq <= last and not (self.resets and last > 0 and seq < last // 10):
                reason = "duplicate_or_old_seq"
            else:
                reason, last = ("accepted" if r.positive else "empty_payload"), seq
            out.append((key[0], int(r.arrival), seq, reason == "accepted", reason))
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["sender", "arrival", "seq", "accepted", "reason"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


class LifecycleProcessor(StatefulProcessor):
    """Per item: its state after each batch of its events (seq, event, at, hotkey), the same as lifecycle.current() gives.

    An item that is in processing for longer than its kind may be is reset, at a penalty for
    its owner.  The clock is the events' own (`event_time`; the stream then has a watermark on `at`, and the timer fires
    as soon as that has passed) or the machine's.  Rows of an item are numbered by `version`, as the last one holds.
    """

    OUTPUT = "item_id string, status string, hotkey string, reward int, penalty int, version bigint"
    COLUMNS = ("item_id", "status", "hotkey", "reward", "penalty", "version")

    def __init__(self, kind: str = "post", event_time: bool = False):
        self.milliseconds, self.event_time = TIMEOUTS[kind] * 1000, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "status string, hotkey string, rewarded boolean, due bigint, version bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, hotkey, rewarded, timer, version = self.item.get() if self.item.exists() else (UNPROCESSED, None, False, 0, 0)
        reward, due = 0, timer
        for r in _in_order(rows, "seq").itertuples():
            if r.event in ("add", "process") and isinstance(r.hotkey, str):
                hotkey = r.hotkey
            if r.event == "process" or (r.event == "result" and status == PROCESSING):
                now = int(r.at_ms) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
                status, due = PROCESSING, now + self.milliseconds
            elif r.event in ("add", "reset", "done"):
                status, due = (PROCESSED if r.event == "done" else UNPROCESSED), 0
                if r.event == "done" and not rewarded:
                    rewarded, reward = True, reward + 1
            elif r.event == "delete":
                status, hotkey, rewarded, due = UNPROCESSED, None, False, 0
            elif r.event == "rewarded":
                rewarded = True
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        self.item.update((status, hotkey, rewarded, due, version + 1))
        yield pd.DataFrame([(key[0], status, hotkey, reward, 0, version + 1)], columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, hotkey, rewarded, due, version = self.item.get()
        if status == PROCESSING and due == expiredTimerInfo.getExpiryTimeInMs():
            self.item.update((UNPROCESSED, hotkey, rewarded, 0, version + 1))
            yield pd.DataFrame([(key[0], UNPROCESSED, hotkey, 0, 1, version + 1)], columns=self.COLUMNS)

    def close(self) -> None:
        pass


class CooldownProcessor(StatefulProcessor):
    """Per worker: failures in a row, level and end of the cooldown; a success forgets them."""

    OUTPUT = "hotkey string, failures bigint, level int, until timestamp"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "failures bigint, level int, until timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failures, level, until = self.run.get() if self.run.exists() else (0, 0, None)
        for r in _in_order(rows, "at", "event_id").itertuples():
            if r.ok:
                failures, level, until = 0, 0, None
                continue
            failures += 1
            if failures >= FAILURES:
                level = min(level + 1, len(BACKOFF))
                until = r.at + pd.Timedelta(seconds=BACKOFF[level - 1])
        if failures:
            self.run.update((failures, level, until))
            yield pd.DataFrame([(key[0], failures, level, until)], columns=["hotkey", "failures", "level", "until"])
        elif self.run.exists():
            self.run.clear()

    def close(self) -> None:
        pass


def with_state(df: DataFrame, key: str, processor: StatefulProcessor, mode: str = "Append", delay: str = "1 hour") -> DataFrame:
    """The stream through a processor of this module; `delay` is the watermark's, where event time counts."""
    time = "None"
    if isinstance(processor, LifecycleProcessor):
        time = "EventTime" if processor.event_time else "ProcessingTime"
        if processor.event_time:
            df = df.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode=mode, timeMode=time)
