"""Text normalisation and assembly."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that count as white space, U+001C to U+001F among them.
SPACE = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: An article's content is read up to so many characters.
CONTENT_CHARS = 3000


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no built-in for it, so only texts beyond Latin-1 go to Python."""

    @F.pandas_udf(T.StringType())
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    # all of Latin-1 is composed already
    return F.when(text.rlike(r"[^\u0000-\u00FF]"), compose(F.when(text.rlike(r"[^\u0000-\u00FF]"), text))).otherwise(text)


def norm_text(text: Column) -> Column:
    """Null as '', composed, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), f"{SPACE}+", " "))


def norm_author(name: Column) -> Column:
    """Null as '', trimmed, lower case; an @ stays."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")))


def article_text(title: Column, summary: Column, content: Column) -> Column:
    """Title, summary and content's beginning, as far as they aren't empty, with blank lines between."""
    full = lambda c: F.when(F.length(c) > 0, c)
    return F.concat_ws("\n\n", title, full(summary), full(F.substring(content, 1, CONTENT_CHARS)))


def conversation_lines(messages: Column) -> Column:
    """array<struct<user, content>> as lines "user: content"."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["user"], F.lit("unknown")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


#: Names under which the fields of a raw message may come, the first that is there taken.
MESSAGE_NAMES = {"id": ("message_id", "id"), "user": ("username", "from"), "content": ("content", "text"), "timestamp": ("timestamp",), "reply_to": ("reply_to",)}
MESSAGE_DEFAULTS = {"id": "", "user": "unknown", "content": ""}


def adapted_messages(raw: Column) -> Column:
    """array<struct<id, user, content, timestamp, reply_to>> of an array of maps under either set of names.

    A name with a null value counts as absent; an absent id is empty, an absent user unknown, absent content
    empty.  A null array stays null, and a null message is one without any name.
    """

    def field(m: Column, name: str) -> Column:
        names = [F.try_element_at(m, F.lit(n)) for n in MESSAGE_NAMES[name]]
        return F.coalesce(*names, F.lit(MESSAGE_DEFAULTS.get(name)).cast("string")).alias(name)

    return F.transform(raw, lambda m: F.struct(*[field(m, name) for name in MESSAGE_NAMES]))


def messages_from_json(raw: Column) -> Column:
    """:func:`adapted_messages` of a JSON array of objects; null where it isn't one."""
    return adapted_messages(F.from_json(raw, "array<map<string,string>>"))


def conversation_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), " ")


def with_context(context: Column, message: Column) -> Column:
    """Context messages in reverse, then the message itself."""
    return F.concat(F.reverse(F.coalesce(context, F.array())), F.array(message))


def display_name(username: Column, name: Column) -> Column:
    return F.coalesce(F.when(F.length(username) > 0, username), name)


def preview(text: Column, n: int = 100) -> Column:
    return F.coalesce(F.substring(text, 1, n), F.lit(""))


def canonical(item_id: Column, content: Column, sentiment: Column, technical: Column, market: Column, impact: Column, confidence: Column, evidence: Column) -> Column:
    """The labels joined by |, then the sorted lower-case evidence."""
    tail = F.array_join(F.array_sort(F.transform(F.coalesce(evidence, F.array().cast("array<string>")), F.lower)), "|")
    head = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("None")) for c in (item_id, content, sentiment, technical, market, impact, confidence)])
    return F.concat(head, F.lit("|"), tail)


def normalised_keys(tokens: Column) -> Column:
    """Trimmed lower-case keys; the last of equal ones wins."""
    entries = F.map_entries(F.coalesce(tokens, F.create_map().cast("map<string,double>")))
    keyed = F.transform(entries, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    start = F.create_map().cast("map<string,double>")
    # map_concat takes the last under LAST_WIN only, so earlier equal keys are filtered out here
    return F.aggregate(keyed, start, lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


def registry_line(symbol: Column, item_id: Column, name: Column, description: Column, identifiers: Column) -> Column:
    """"SYM (id=, name): description | IDs: ..."."""
    return F.concat(symbol, F.lit(" (id="), item_id.cast("string"), F.lit(", "), name, F.lit("): "), F.coalesce(description, F.lit("")), F.lit(" | IDs: "), F.array_join(identifiers, ", "))


def listed(text: Column) -> Column:
    """A comma-separated list, trimmed and without empty entries."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def version_parts(version: Column) -> Column:
    """1.2.10 as numbers, for comparison."""
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))


def auth_message(prefix: str, seconds: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), seconds.cast("long").cast("string"))


def previous(message: Column, conversation: str, order: str, n: int = 2) -> Column:
    """The n messages before a row of its conversation, oldest first."""
    return F.collect_list(message).over(W.partitionBy(conversation).orderBy(order).rowsBetween(-n, -1))


def with_parent(messages: DataFrame, key: str = "id", parent: str = "reply_to", fields: tuple[str, ...] = ("user", "content")) -> DataFrame:
    """messages with `parent_message`, a struct of fields of the message that each replies to; null where there is none."""
    parents = messages.select(F.col(key).alias("__key"), F.struct(*fields).alias("parent_message"))
    return messages.join(parents, F.col(parent) == F.col("__key"), "left").drop("__key")
