"""Running a stream to its present end, or on and on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..tables import shared_folder

#: Fixed value: seconds between polls.
POLL_SECONDS = 10


def _writer(stream: DataFrame, folder: str):
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that the stream gives for what is there now, written exactly once and read back."""
    folder = shared_folder(stream.sparkSession, name)
    _writer(stream, folder).trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def started(stream: DataFrame, folder: str, seconds: float = POLL_SECONDS) -> StreamingQuery:
    """A query that looks for new rows every so many seconds, until it is stopped; its rows are under `folder`/rows."""
    return _writer(stream, folder).trigger(processingTime=f"{seconds} seconds").start(f"{folder}/rows")
