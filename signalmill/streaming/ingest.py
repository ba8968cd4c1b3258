"""Messages that others push: one stream of envelopes of all kinds, routed by kind, with what can't be read kept apart.

An envelope is a JSON object {kind, sender, id, sent_at, body}.  Every micro-batch is one write, into a folder of
its own number, with a part for each kind and one for what was refused and why.  A batch that is played again
replaces its own folder, so every kind's messages are there exactly once, after a restart as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..schemas import ARTICLE, CHAT_MESSAGE, POST

REFUSED = "refused"


def _body(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_POINTS = T.MapType(T.StringType(), T.LongType())
#: Body of each kind.
BODIES = {
    "posts": _body(("items", T.ArrayType(POST))),
    "chat": _body(("items", T.ArrayType(CHAT_MESSAGE))),
    "articles": _body(("items", T.ArrayType(ARTICLE))),
    "rewards": _body(("epoch", T.LongType()), ("seq", T.LongType()), ("uid_values", _POINTS)),
    "penalties": _body(("epoch", T.LongType()), ("seq", T.LongType()), ("uid_values", _POINTS)),
    "score": _body(("block_window_start", T.LongType()), ("block_window_end", T.LongType()), ("rewards", T.LongType()), ("penalties", T.LongType()), ("score", T.DoubleType())),
    "validation_result": _body(("validation_id", T.StringType()), ("post_id", T.StringType()), ("success", T.BooleanType()), ("failure_reason", T.MapType(T.StringType(), T.StringType()))),
    "is_alive": _body(("is_alive", T.BooleanType())),
}
#: Fields without which a body is refused.
NEEDED = {"posts": ("items",), "chat": ("items",), "articles": ("items",), "rewards": ("epoch", "seq", "uid_values"), "penalties": ("epoch", "seq", "uid_values"), "score": ("score",), "validation_result": ("validation_id", "success"), "is_alive": ("is_alive",)}


def routed(envelopes: DataFrame, value: str = "value") -> DataFrame:
    """Of lines of JSON: kind (of refused ones `refused`), sender, message_id, sent_at, body (JSON), and for refused ones said_kind, problem and raw.

    Refused are lines that are null, empty, broken or no object, unknown kinds, messages without a sender, and bodies that lack a
    needed field or have one of another type.
    """
    rows = envelopes.select(F.col(value).alias("raw"), F.try_parse_json(F.col(value)).alias("__v"))
    get = lambda path, kind: F.try_variant_get("__v", path, kind)
    rows = rows.select("raw", get("$.kind", "string").alias("said_kind"), get("$.sender", "string").alias("sender"), get("$.id", "string").alias("message_id"), get("$.sent_at", "timestamp").alias("sent_at"), get("$.body", "variant").alias("__body"), F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False)).alias("__object"))

    def lacking(kind: str) -> Column:
        body = BODIES[kind]
        missing = [F.try_variant_get("__body", f"$.{n}", body[n].dataType.simpleString()).isNull() for n in NEEDED[kind]]
        out = missing[0]
        for m in missing[1:]:
            out = out | m
        return F.when(F.col("said_kind") == kind, F.coalesce(out, F.lit(True)))

    problem = (
        F.when(~F.col("__object"), "no object")
        .when(F.col("said_kind").isNull() | ~F.col("said_kind").isin(*BODIES), "unknown kind")
        .when(F.coalesce(F.length("sender"), F.lit(0)) == 0, "no sender")
        .when(F.coalesce(*map(lacking, BODIES)), "bad body")
    )
    rows = rows.withColumn("problem", problem)
    return rows.select(
        F.when(F.col("problem").isNull(), F.col("said_kind")).otherwise(REFUSED).alias("kind"), "said_kind", "sender", "message_id", "sent_at",
        F.when(F.col("problem").isNull(), F.to_json("__body")).alias("body"), "problem", F.when(F.col("problem").isNotNull(), F.col("raw")).alias("raw"),
    )


COLUMNS = "said_kind string, sender string, message_id string, sent_at timestamp, body string, problem string, raw string, batch bigint, kind string"


def pushed(envelopes: DataFrame, folder: str, value: str = "value") -> DataStreamWriter:
    """A stream of envelopes into folder, to be started with any trigger."""

    def write(rows: DataFrame, batch: int) -> None:
        routed(rows, value).write.partitionBy("kind").mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    return envelopes.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state")


def received(spark: SparkSession, folder: str) -> DataFrame:
    """All that has been written: one row for each envelope, with its batch."""
    return spark.read.schema(COLUMNS).parquet(f"{folder}/rows")


def messages(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Messages of a kind, their bodies as columns; keys of points are integers.  Only this kind's files are read."""
    rows = received(spark, folder).where(F.col("kind") == kind).withColumn("b", F.from_json("body", BODIES[kind]))
    fields = [F.transform_keys("b.uid_values", lambda k, v: k.try_cast("int")).alias(n) if n == "uid_values" else F.col(f"b.{n}").alias(n) for n in BODIES[kind].names]
    return rows.select("batch", "sender", "message_id", "sent_at", *fields)


def refused(spark: SparkSession, folder: str) -> DataFrame:
    return received(spark, folder).where(F.col("kind") == REFUSED).select("batch", "problem", "said_kind", "sender", "raw")
