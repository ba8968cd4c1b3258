"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for timestamps; the last of equal map keys wins; the RocksDB store holds stream state beyond memory.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    return builder.config(map=SETTINGS)
