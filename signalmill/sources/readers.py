"""Reading leases, state and configuration, and writing results."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import version_parts
from ..operators.ledger import EPOCH_BLOCKS
from ..schemas import ARTICLE, CHAT_MESSAGE, POST, camel, with_defaults, with_names
from ..tables import VersionedTable

# Rows of a lease and of a listing.
LEASE, LISTING = 24, 100
KINDS = {"post": POST, "chat": CHAT_MESSAGE, "article": ARTICLE}


def read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", **options: str) -> DataFrame:
    return spark.read.format(fmt).options(**options).schema(schema).load(path)


def leased(spark: SparkSession, path: str, kind: str, limit: int = LEASE, fmt: str = "json") -> DataFrame:
    """The next items of a kind, under either spelling of field names, with defaults filled in."""
    schema = KINDS[kind]
    both = T.StructType([*schema.fields, *[T.StructField(camel(f.name), f.dataType) for f in schema if camel(f.name) not in schema.names]])
    rows = with_names(read(spark, path, both, fmt), schema)
    return (with_defaults(rows) if kind == "post" else rows).orderBy("id").limit(limit)


def stream(spark: SparkSession, path: str, kind: str, files_per_trigger: int = 16, fmt: str = "json") -> DataFrame:
    """The same items as they arrive as files."""
    return spark.readStream.format(fmt).schema(KINDS[kind]).option("maxFilesPerTrigger", files_per_trigger).load(path)


def listing(rows: DataFrame, hotkey: str | None = None, limit: int = LISTING) -> DataFrame:
    """Rewards or penalties, of one hotkey or all, a page at most."""
    return (rows if hotkey is None else rows.where(F.col("hotkey") == hotkey)).limit(limit)


def state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or an empty one before the first save."""
    return VersionedTable(spark, path, schema).read()


def save_state(df: DataFrame, path: str) -> None:
    """Replace a stored table, which df may have been read from; readers see the old one or the new one."""
    VersionedTable(df.sparkSession, path, df.schema).replace(df)


def ledger_from_json(spark: SparkSession, path: str, field: str = "epoch_rewards") -> DataFrame:
    """(epoch, hotkey, amount) of state files that hold them as an object by epoch and hotkey; keys are integers again."""
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))
    rows = spark.read.option("multiLine", True).schema(T.StructType([T.StructField(field, kind)])).json(path)
    epochs = rows.select(F.explode(field).alias("epoch", "amounts")).where(F.col("epoch").try_cast("long").isNotNull())
    return epochs.select(F.col("epoch").cast("long").alias("epoch"), F.explode("amounts").alias("hotkey", "amount"))


def items_from_json(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Work items of state files that hold them as an object by item id, with start_time in seconds."""
    item = T.StructType([*[T.StructField(n, T.StringType()) for n in ("status", "hotkey")], T.StructField("start_time", T.DoubleType()), *[T.StructField(n, T.BooleanType()) for n in ("submitted", "rewarded")]])
    rows = spark.read.option("multiLine", True).schema(T.StructType([T.StructField(field, T.MapType(T.StringType(), item))])).json(path)
    rows = rows.select(F.explode(field).alias("item_id", "x"))
    flag = lambda n: F.coalesce(F.col(f"x.{n}"), F.lit(False)).alias(n)
    return rows.select("item_id", "x.status", F.timestamp_seconds("x.start_time").alias("start_time"), "x.hotkey", flag("submitted"), flag("rewarded"))


def settings(defaults: Mapping[str, str], api: Mapping[str, str | None], overrides: Mapping[str, str | None], spark: SparkSession) -> DataFrame:
    """(key, value): an override, else what the API says, else the default."""
    rows = [(k, overrides.get(k), api.get(k), v) for k, v in defaults.items()]
    return spark.createDataFrame(rows, "key string, override string, api string, fallback string").select("key", F.coalesce("override", "api", "fallback").alias("value"))


def outdated(current: Column, least: Column) -> Column:
    """Whether a version is below another, number by number."""
    return version_parts(current) < version_parts(least)


def price(quotes: DataFrame) -> DataFrame:
    """One row: the latest quote, stale or not."""
    return quotes.orderBy(F.desc("last_updated")).limit(1)


# Seconds that a price is taken as fresh, and seconds to wait after each failed try of a cold start.
PRICE_SECONDS = 300
COLD_START_WAITS = (2, 5)
QUOTE = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("last_updated", T.TimestampType())])


def fetched_price(fetch: Callable[[], float], cache: VersionedTable, as_of: datetime, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The latest quote in a cache (of schema QUOTE), of which a fetched price becomes the only row.

    A fresh quote isn't fetched again.  If fetching fails, the stale quote stays in force; without one it
    is tried twice more, and the last failure raised.
    """
    spark = cache.spark
    old = cache.read().agg(F.max("last_updated").alias("at")).first().at
    now = spark.range(1).select(F.lit(as_of).cast("timestamp").alias("now"))
    if old is not None and now.where(F.unix_micros("now") - F.unix_micros(F.lit(old)) < PRICE_SECONDS * 1_000_000).count():
        return price(cache.read())
    for pause in (None,) if old is not None else (*COLD_START_WAITS, None):
        try:
            found = float(fetch())
        except Exception:  # whatever a source of the caller's raises
            if pause is not None:
                wait(pause)
            elif old is None:
                raise
        else:
            cache.replace(now.select(F.lit(found).alias("price"), F.col("now").alias("last_updated")))
            break
    return price(cache.read())


def with_price(df: DataFrame, quotes: DataFrame) -> DataFrame:
    """df with the latest price in every row; null where there is no quote."""
    return df.withColumn("token_usd", quotes.agg(F.max_by("price", "last_updated")).scalar())


def stored_value(values: DataFrame, module: str, name: str) -> Column:
    """A scalar of chain storage as a subquery, 0 where there is none."""
    one = values.where((F.col("module") == module) & (F.col("name") == name)).agg(F.coalesce(F.max("value"), F.lit(0)))
    return one.scalar()


def completed(items: DataFrame, participants: DataFrame, kind: str = "post") -> DataFrame:
    """What is submitted of items with an analysis: null sentiment is neutral; the worker of a chat message isn't told."""
    target = "sector" if kind == "article" else "asset"
    a = F.col("analysis")
    fields = {"sentiment": F.coalesce(a["sentiment"], F.lit("neutral"))} | {f: a[f] for f in (f"{target}_id", f"{target}_symbol", "content_type", "technical_quality", "market_analysis", "impact_potential")}
    workers = participants.select("hotkey", F.col("uid").alias("worker_uid"))
    out = items.where(a.isNotNull()).join(workers, "hotkey", "left")
    who = [] if kind == "chat" else ["hotkey", "worker_uid"]
    return out.select("item_id", *who, *[c.alias(n) for n, c in fields.items()])


def reward_rows(settled: DataFrame) -> DataFrame:
    """(start_block, stop_block, hotkey, points), zeros included."""
    start = F.col("epoch") * EPOCH_BLOCKS
    return settled.select(start.alias("start_block"), (start + EPOCH_BLOCKS - 1).alias("stop_block"), "hotkey", F.col("reward").cast("double").alias("points"))


def penalty_rows(ledger: DataFrame) -> DataFrame:
    """(hotkey, reason) of counts above 0."""
    return ledger.where("amount > 0").select("hotkey", F.format_string("epoch=%d count=%d", "epoch", "amount").alias("reason"))


def upserted(table: DataFrame, rows: DataFrame, key: str = "hotkey") -> DataFrame:
    return table.join(rows, key, "left_anti").unionByName(rows)


def removed(table: DataFrame, keys: DataFrame, key: str = "hotkey") -> DataFrame:
    return table.join(keys, key, "left_anti")


def submit_once(df: DataFrame, path: str, epoch: int) -> bool:
    """Write an epoch's rows under its own folder unless they are there; whether they were written.

    The folder of an epoch appears with its success mark, so a rerun after a failure writes again.
    """
    spark = df.sparkSession
    target = f"{path}/epoch={epoch}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        return False
    df.write.mode("overwrite").parquet(target)
    return True
