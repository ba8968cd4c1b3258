"""The operators' inputs, made of the driver tables; each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import BLOCK_SECONDS, EPOCH_BLOCKS
from ..sources.registries import Entry

AS_OF = "2024-01-31 00:00:00"
PARTICIPANTS = 150

# A registry of words that the invented texts hold, as the real ones never match there.
FIXTURE = (
    Entry(1, "LICENSE", "Licences", ("license", "licensed"), (), ("$lic",)),
    Entry(2, "FROM", "Origins", ("from", "that", "of"), (), ()),
    Entry(3, "THIS", "Pointers", ("this", "with"), ("This", "Was"), ("### tok",)),
    Entry(4, "ROMANCE", "Romance words", ("pour", "avec", "para", "cómo"), ("Très",), ("él",)),
    Entry(5, "GERMAN", "German words", ("nicht", "und"), ("Der",), ()),
    Entry(9, "OTHER", "Other"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as posts, with counts, a time and an asset that follow from their ids."""
    d = F.col("doc_id")
    return table(spark, folder, "documents").select(
        d, "text", "source", "n_chars",
        F.pmod(F.col("n_chars") * 7, F.lit(6000)).alias("like_count"), F.pmod(F.col("n_chars") * 3, F.lit(1100)).alias("retweet_count"),
        F.pmod(F.col("n_chars"), F.lit(400)).alias("quote_count"), F.pmod(d, F.lit(700)).alias("reply_count"), F.pmod(d * 7919, F.lit(250_000)).alias("followers_count"),
        F.when(F.pmod(d, F.lit(11)) != 0, F.expr(f"timestamp '{AS_OF}' - make_dt_interval(0, cast(pmod(doc_id, 300) as int) - 2)")).alias("created_at"),
        F.pmod(d, F.lit(5)).alias("asset_id"),
    )


POSTS_SQL = f"""
  SELECT doc_id, text, source, n_chars, (n_chars * 7) % 6000 AS like_count, (n_chars * 3) % 1100 AS retweet_count, n_chars % 400 AS quote_count,
    doc_id % 700 AS reply_count, (doc_id * 7919) % 250000 AS followers_count,
    CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '{AS_OF}' - to_hours(CAST(doc_id % 300 - 2 AS INTEGER)) END AS created_at, doc_id % 5 AS asset_id
  FROM documents"""


def participants(spark: SparkSession, folder: str) -> DataFrame:
    """All customers as participants."""
    c = table(spark, folder, "customer")
    uid = (F.col("c_custkey") - 1).cast("int")
    return c.select(uid.alias("uid"), F.concat(F.lit("hk"), uid.cast("string")).alias("hotkey"), F.col("c_acctbal").alias("stake"), (F.col("c_nationkey") % 2 == 0).alias("validator_permit"), (F.col("c_nationkey") % 3 != 0).alias("is_serving"))


PARTICIPANTS_SQL = """
  SELECT CAST(c_custkey - 1 AS INTEGER) AS uid, 'hk' || CAST(c_custkey - 1 AS VARCHAR) AS hotkey, c_acctbal AS stake, c_nationkey % 2 = 0 AS validator_permit, c_nationkey % 3 <> 0 AS is_serving
  FROM customer"""


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with block and epoch; purchases and clicks are accepted results, errors are failures."""
    e = table(spark, folder, "events")
    block = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / BLOCK_SECONDS).cast("long")
    kind = F.when(F.col("event_type").isin("purchase", "click"), "reward").when(F.col("event_type") == "error", "penalty")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.concat(F.lit("hk"), F.col("user_id").cast("string")).alias("hotkey"), "event_type", "value", block.alias("block"), F.floor(block / EPOCH_BLOCKS).cast("long").alias("epoch"), kind.alias("kind"))


EVENTS_SQL = f"""
  SELECT event_id, ts, user_id, 'hk' || CAST(user_id AS VARCHAR) AS hotkey, event_type, value,
    CAST(floor(floor(epoch(ts)) / {BLOCK_SECONDS}) AS BIGINT) AS block, CAST(floor(floor(floor(epoch(ts)) / {BLOCK_SECONDS}) / {EPOCH_BLOCKS}) AS BIGINT) AS epoch,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'reward' WHEN event_type = 'error' THEN 'penalty' END AS kind
  FROM events"""


def ledger(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return events(spark, folder).where(F.col("kind") == kind).groupBy("epoch", "hotkey").agg(F.count(F.lit(1)).alias("amount"))


def ledger_sql(kind: str) -> str:
    return f"SELECT epoch, hotkey, count(*) AS amount FROM e WHERE kind = '{kind}' GROUP BY epoch, hotkey"


def broadcasts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as peers' snapshots of one uid each: sequence numbers that mostly rise, some without points."""
    e = events(spark, folder)
    return e.select(
        F.concat(F.lit("v"), F.pmod("user_id", F.lit(20)).cast("string")).alias("sender"), F.floor(F.col("epoch") / 100).cast("long").alias("epoch"), F.col("event_id").alias("arrival"),
        (F.col("event_id") - F.pmod(F.col("event_id") * 31, F.lit(97)) + F.when(F.pmod("event_id", F.lit(500)) == 0, 100).otherwise(0)).alias("seq"),
        F.create_map(F.pmod("user_id", F.lit(150)).cast("int"), F.pmod(F.floor("value"), F.lit(5)).cast("long")).alias("uid_values"),
    )


BROADCASTS_SQL = """
  SELECT 'v' || CAST(user_id % 20 AS VARCHAR) AS sender, CAST(floor(epoch / 100) AS BIGINT) AS epoch, event_id AS arrival,
    event_id - (event_id * 31) % 97 + CASE WHEN event_id % 500 = 0 THEN 100 ELSE 0 END AS seq, CAST(user_id % 150 AS INTEGER) AS uid, CAST(floor(value) AS BIGINT) % 5 AS value
  FROM e"""


def work_items(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as work items in all states."""
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "Processing").when(F.col("o_orderstatus") == "F", "Processed").otherwise("Unprocessed")
    start = F.when(F.pmod(k, F.lit(13)) != 0, F.expr(f"timestamp '{AS_OF}' - make_dt_interval(0, 0, 0, cast(pmod(o_orderkey * 37, 2000) as int))"))
    return o.select(k.cast("string").alias("item_id"), status.alias("status"), start.alias("start_time"), F.concat(F.lit("hk"), F.pmod("o_custkey", F.lit(PARTICIPANTS)).cast("string")).alias("hotkey"), (F.pmod(k, F.lit(4)) == 0).alias("submitted"), (F.pmod(k, F.lit(5)) == 0).alias("rewarded"))


WORK_ITEMS_SQL = f"""
  SELECT CAST(o_orderkey AS VARCHAR) AS item_id, CASE o_orderstatus WHEN 'O' THEN 'Processing' WHEN 'F' THEN 'Processed' ELSE 'Unprocessed' END AS status,
    CASE WHEN o_orderkey % 13 <> 0 THEN TIMESTAMP '{AS_OF}' - to_seconds((o_orderkey * 37) % 2000) END AS start_time,
    'hk' || CAST(o_custkey % {PARTICIPANTS} AS VARCHAR) AS hotkey, o_orderkey % 4 = 0 AS submitted, o_orderkey % 5 = 0 AS rewarded
  FROM orders"""
