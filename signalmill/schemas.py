"""Schemas of the records that operators consume; every read names one, none is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    """Fields from "name type, ..." of simple types, ? after a type for nothing else than to read well."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "bool": T.BooleanType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "extra": T.MapType(T.StringType(), T.StringType())}
    return T.StructType([T.StructField(name, kinds[kind.rstrip("?")]) for name, kind in (f.split() for f in ddl.split(","))])


ACCOUNT = _struct("id long, name string?, screen_name string, user_name string?, location string?, description string?, verified bool, is_blue_verified bool, followers_count long, following_count long, statuses_count long, profile_image_url string?, created_at string?")
ANALYSIS = _struct("sentiment string?, asset_id long?, asset_symbol string?, content_type string?, technical_quality string?, market_analysis string?, impact_potential string?, extra extra?")
POST = _struct("id long, type string, url string?, text string?, lang string?, retweet_count long, reply_count long, like_count long, quote_count long, view_count long, bookmark_count long, is_reply bool, in_reply_to_id long?, conversation_id long?, author_id long?, created_at string?, received_at string")
POST = T.StructType([*POST.fields, T.StructField("author", ACCOUNT), T.StructField("analysis", ANALYSIS)])
CONTEXT_MESSAGE = _struct("id string, sender_id long, sender_username string?, sender_name string, content string, created_at string")
CHAT_MESSAGE = _struct("id string, telegram_id long, group_id string, sender_id long, sender_username string?, sender_name string, content string, reply_to_id long?, created_at string, inherited_asset_id long?, inherited_asset_symbol string?")
CHAT_MESSAGE = T.StructType([*CHAT_MESSAGE.fields, T.StructField("context_messages", T.ArrayType(CONTEXT_MESSAGE)), T.StructField("analysis", ANALYSIS)])
ARTICLE_ANALYSIS = _struct("sentiment string?, sector_id long?, sector_symbol string?, content_type string?, technical_quality string?, market_analysis string?, impact_potential string?, relevance_confidence string?")
ARTICLE = T.StructType([*_struct("id long, url string, title string, summary string?, content string?, published string?, source string, topic string?, extra extra?").fields, T.StructField("analysis", ARTICLE_ANALYSIS)])
WORK_ITEM = _struct("item_id string, status string, start_time timestamp?, hotkey string?, submitted bool, rewarded bool")
LEDGER = _struct("epoch long, hotkey string, amount long, kind string")
BROADCAST = T.StructType([*_struct("epoch long, sender string, seq long, arrival long").fields, T.StructField("uid_values", T.MapType(T.IntegerType(), T.LongType()))])
PARTICIPANT = _struct("uid int, hotkey string, stake double, validator_permit bool, is_serving bool, last_update long")
REGISTRY = _struct("id long, symbol string, name string, description string?, unique_identifiers strings, case_sensitive_identifiers strings?, cashtags strings?, distinguishing_features strings?")
COMMITMENT = _struct("hotkey string, block long, data string")
REWARD = _struct("start_block long, stop_block long, hotkey string, points double")
PENALTY = _struct("hotkey string, reason string")

#: Counts and flags that are 0 and false unless given.
POST_DEFAULTS = {f: 0 for f in ("retweet_count", "reply_count", "like_count", "quote_count", "view_count", "bookmark_count")}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.title() for p in rest)


def with_names(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of schema, each from its own name or else its camelCase alias, null if neither is there."""
    have = set(df.columns)
    pick = lambda f: [F.col(n) for n in (camel(f.name), f.name) if n in have] or [F.lit(None)]
    return df.select(*[F.coalesce(*pick(f)).cast(f.dataType).alias(f.name) for f in schema])


def with_defaults(posts: DataFrame) -> DataFrame:
    return posts.na.fill(POST_DEFAULTS).withColumn("type", F.coalesce("type", F.lit("tweet"))).withColumn("is_reply", F.coalesce("is_reply", F.lit(False)))
