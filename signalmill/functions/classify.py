"""Labels of a text in five dimensions, by rules, or by a classifier of the caller's.

The rules are keyword rubrics as column expressions, so that labelling stays in
the JVM and gives the same labels on every run.  A model takes their place as a
function from a batch of texts to rows of labels; distinct texts are labelled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.registries import ARTICLE_CONTENT_TYPES, CONTENT_TYPES, IMPACTS, MARKET_ANALYSES, SENTIMENTS, TECHNICAL_QUALITIES, Entry
from ..tables import VersionedTable, materialised
from .matching import anchors, inherited, match_taken, once, taken
from .scoring import sentiment_value, tokens
from .text import article_text, conversation_text

DIMENSIONS = ("content_type", "sentiment", "technical_quality", "market_analysis", "impact_potential")
DEFAULTS = {"content_type": "other", "sentiment": "neutral", "technical_quality": "none", "market_analysis": "other", "impact_potential": "NONE"}
DOMAINS = {"content_type": CONTENT_TYPES, "sentiment": SENTIMENTS, "technical_quality": TECHNICAL_QUALITIES, "market_analysis": MARKET_ANALYSES, "impact_potential": IMPACTS}
ARTICLE_DOMAINS = DOMAINS | {"content_type": ARTICLE_CONTENT_TYPES}

#: Label by label, words that speak for it; the first label with a word in the text is taken.
RULES = {
    "content_type": {
        "security": "exploit exploits vulnerability vulnerabilities audit hack hacked breach",
        "partnership": "partnership partnered collaboration integration integrates",
        "hiring": "hiring recruiting vacancy",
        "governance": "governance proposal vote voting referendum",
        "tutorial": "tutorial guide walkthrough howto",
        "announcement": "announcing announcement launch launches launched release released",
        "milestone": "milestone achieved surpassed reached",
        "technical_insight": "architecture algorithm protocol benchmark code implementation",
        "market_discussion": "price trading trader chart bullish bearish",
        "fud": "scam rug fraud collapse",
        "meme": "meme lol lmao",
        "hype": "moon huge massive incredible",
        "opinion": "think believe opinion imo",
        "community": "gm community everyone thanks welcome",
    },
    "sentiment": {
        "very_bearish": "crash crashed exploit collapse failure",
        "very_bullish": "moon ath pump explosive",
        "bearish": "concern concerns dump issue issues negative decline",
        "bullish": "growth optimistic positive upward gain gains bullish",
    },
    "market_analysis": {
        "political": "regulation regulatory governance legislation congress",
        "economic": "revenue costs fundamentals earnings inflation",
        "technical": "indicator indicators pattern patterns support resistance chart",
        "social": "narrative viral community influencer",
    },
    "impact_potential": {
        "HIGH": "mainnet exploit critical breach halving",
        "MEDIUM": "launch partnership update integration listing",
        "LOW": "minor patch note reminder",
    },
}
ARTICLE_CONTENT_RULES = {
    "breaking_news": "breaking urgent developing",
    "earnings": "earnings quarterly revenue dividend",
    "regulatory": "regulation regulatory sec legislation compliance",
    "research": "study research paper findings",
    "interview": "interview interviewed",
    "press_release": "announces announced announcement",
    "opinion": "opinion editorial column",
    "analysis": "analysis outlook forecast",
}
SPECIFICS = (r"\bv?[0-9]+\.[0-9]+(\.[0-9]+)?\b", r"\b[0-9]+(\.[0-9]+)? ?(ms|tps|gb|mb|%)", r"https?://", r"\b(api|sdk|endpoint|repo|repository|commit)\b")
TECHNICAL_WORDS = "protocol algorithm code software network model node server"


def _first(words: Column, rules: dict[str, str], default: str) -> Column:
    out = None
    for label, known in rules.items():
        test = F.arrays_overlap(words, F.array(*map(F.lit, known.split())))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def _specifics(lowered: Column) -> Column:
    """How many of SPECIFICS stand in the text.

    A word boundary is dear to look for at each place, so a pattern is tried only in texts with something that each of its matches holds.
    """
    named = reduce(or_, [F.contains(lowered, F.lit(w)) for w in ("api", "sdk", "endpoint", "repo", "commit")])
    signs = (lowered.rlike(r"[0-9]\.[0-9]"), lowered.rlike(r"[0-9] ?(ms|tps|gb|mb|%)"), F.contains(lowered, F.lit("http")), named)
    return sum((F.when(sign & lowered.rlike(p), 1).otherwise(0) for sign, p in zip(signs, SPECIFICS, strict=True)), F.lit(0))


def _rule_words(*rules: dict[str, str]) -> set[str]:
    return {w for known in rules for listed in known.values() for w in listed.split()}


def _rules(article: bool) -> dict[str, dict[str, str]]:
    return RULES | {"content_type": ARTICLE_CONTENT_RULES} if article else RULES


def _label_words(article: bool) -> set[str]:
    return _rule_words(*_rules(article).values()) | set(TECHNICAL_WORDS.split())


def _labels_taken(t: Column, article: bool) -> Column:
    """:func:`rule_labels` of a text as :func:`taken` with the rules' words, and any other, among its words."""
    technical = F.arrays_overlap(t["words"], F.array(*map(F.lit, TECHNICAL_WORDS.split())))
    quality = once(_specifics(t["lower"]), lambda n: F.when(n >= 2, "high").when(n == 1, "medium").when(technical, "low").otherwise("none"))
    labels = {d: _first(t["words"], rules, DEFAULTS[d]) for d, rules in _rules(article).items()}
    return F.struct(*[c.alias(d) for d, c in ({"content_type": labels["content_type"], "technical_quality": quality} | labels).items()])


def rule_labels(text: Column, article: bool = False) -> Column:
    """struct of DIMENSIONS by the rules."""
    return once(taken(text, _label_words(article)), lambda t: _labels_taken(t, article))


def valid_labels(labels: Column, article: bool = False) -> Column:
    """The labels, or null if any is outside its domain."""
    fine = F.lit(True)
    for d, values in (ARTICLE_DOMAINS if article else DOMAINS).items():
        fine = fine & F.coalesce(labels[d].isin(*values), F.lit(False))
    return F.when(fine, labels)


LABELS = T.StructType([T.StructField(d, T.StringType()) for d in DIMENSIONS])


def model_labels(df: DataFrame, text: str, make: Callable[[], Callable[[pd.Series], pd.DataFrame]], out: str = "labels") -> DataFrame:
    """df with labels by a model, asked once for each distinct text.

    make builds the model once for each worker; the model maps texts to a frame of
    DIMENSIONS.  A null text has null labels.
    """

    @F.pandas_udf(LABELS)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield model(batch)[list(DIMENSIONS)]

    asked = df.select(F.col(text).alias("__text")).where("__text is not null").distinct().withColumn(out, ask("__text"))
    return df.join(asked, F.col(text) == F.col("__text"), "left").drop("__text")


#: A remembered label: the text's SHA-256, the model's version, when it was asked, and what it said.
MEMO = T.StructType([T.StructField("text_hash", T.StringType()), T.StructField("model", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("labels", LABELS)])
# Fixed value: seconds that a label is remembered.
MEMO_SECONDS = 300


def remembered_labels(df: DataFrame, text: str, make: Callable[[], Callable[[pd.Series], pd.DataFrame]], memo: VersionedTable, model: str, as_of: Column, *, seconds: int = MEMO_SECONDS, article: bool = False, out: str = "labels") -> DataFrame:
    """df with labels as by :func:`model_labels`, but texts that this version of the model was asked for in the last `seconds` are not asked again, whichever run asked.

    Labels outside their domains are failures: they come out as null and aren't remembered.  The memo (of schema MEMO) is replaced by
    one without expired entries; it holds a hash for each text, so its size follows the texts of that time.
    """
    hashed = df.withColumn("__hash", F.sha2(F.col(text), 256))
    # read once: a memo that is replaced by another run meanwhile would make other texts unseen
    known = materialised(memo.read().where(F.unix_micros(as_of) - F.unix_micros("at") < seconds * 1_000_000), "memo")
    mine = known.where(F.col("model") == model).select(F.col("text_hash").alias("__hash"), F.col("labels").alias("__known"))
    unseen = hashed.where("__hash is not null").dropDuplicates(["__hash"]).select("__hash", F.col(text).alias("__asked")).join(mine, "__hash", "left_anti")
    # written before it is judged, or the model would be asked again for each field that is looked at
    said = materialised(model_labels(unseen, "__asked", make, "__known").select("__hash", "__known"), "labels")
    new = said.withColumn("__known", valid_labels(F.col("__known"), article)).where("__known is not null")
    rows = new.select(F.col("__hash").alias("text_hash"), F.lit(model).alias("model"), as_of.cast("timestamp").alias("at"), F.col("__known").alias("labels"))
    memo.replace(known.unionByName(rows))
    return hashed.join(mine.unionByName(new), "__hash", "left").withColumnRenamed("__known", out).drop("__hash")


def classify_post(text: Column, registry: tuple[Entry, ...], default: Entry) -> Column:
    """struct<id, symbol, confidence, evidence, and DIMENSIONS>; null for a text without characters."""
    return F.when(F.length(text) > 0, _classified(text, registry, default))


def classify_group(messages: Column, inherited_asset: Column, registry: tuple[Entry, ...], default: Entry) -> Column:
    """Of a conversation, array<struct<id, user, content>>; an inherited asset comes before a match."""
    return _classified(conversation_text(messages), registry, default, found=lambda m: inherited(m, inherited_asset, registry))


def last_message_sentiment(messages: Column) -> Column:
    """Sentiment of the last message of array<struct<id, user, content>>, in context; null without messages.

    Words of the message itself decide; where none of them speaks for a sentiment, those of the whole conversation do.
    """
    sentiment = lambda t: _first(taken(t, _rule_words(RULES["sentiment"]))["words"], RULES["sentiment"], DEFAULTS["sentiment"])
    own = sentiment(F.try_element_at(messages, F.lit(-1))["content"])
    return F.when(F.size(messages) > 0, once(own, lambda x: F.when(x != DEFAULTS["sentiment"], x).otherwise(sentiment(conversation_text(messages)))))


def classify_article(title: Column, summary: Column, content: Column, registry: tuple[Entry, ...], default: Entry) -> Column:
    """Null for an article without a title."""
    text = article_text(title, summary, content)
    return F.when(F.length(title) > 0, _classified(text, registry, default, article=True))


def _classified(text: Column, registry: tuple[Entry, ...], default: Entry, *, article: bool = False, found: Callable[[Column], Column] = lambda m: m) -> Column:
    """The match, or what `found` makes of it, with the labels; the text's words are taken once for both."""
    plain, cased = anchors(registry, default.id)

    def both(t: Column) -> Column:
        return F.struct(found(match_taken(t, registry, default)).alias("m"), _labels_taken(t, article).alias("l"))

    def merged(x: Column) -> Column:
        return F.struct(*[x["m"][f].alias(f) for f in ("id", "symbol", "confidence", "evidence")], *[x["l"][d].alias(d) for d in DIMENSIONS])

    return once(once(taken(text, plain | _label_words(article), cased), both), merged)


def complete(classification: Column) -> Column:
    """struct<sentiment as a number, relevance by symbol>."""
    return F.struct(sentiment_value(classification["sentiment"]).alias("sentiment"), tokens(classification["id"], classification["symbol"]).alias("asset_relevance"))
