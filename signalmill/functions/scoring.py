"""Scores of posts and articles, and what a point is worth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.registries import DEFAULT_CREDIBILITY, credibility

# Counts at which a term of the value score is full, hours at which recency is gone, days at which a post is stale.
CAPS = {"like_count": 5000, "retweet_count": 1000, "quote_count": 300, "reply_count": 600, "followers_count": 200_000}
RECENCY_HOURS, STALE_DAYS = 24, 10
# What relevance, value and recency weigh in a score.
WEIGHTS = (0.5, 0.4, 0.1)
# Sentiments as numbers.
SENTIMENT_VALUES = {"very_bullish": 1.0, "bullish": 0.5, "neutral": 0.0, "bearish": -0.5, "very_bearish": -1.0}


def clamp01(x: Column) -> Column:
    """Into [0, 1]; null as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def capped(x: Column, cap: float) -> Column:
    return clamp01(x / F.lit(float(cap)))


def age_hours(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(3.6e9)


def recency(at: Column, as_of: Column) -> Column:
    """1 now or later, 0 from RECENCY_HOURS on, and 0 without a time."""
    return F.when(at.isNull(), 0.0).otherwise(clamp01(1 - age_hours(at, as_of) / RECENCY_HOURS))


def post_value(counts: dict[str, Column]) -> Column:
    """The mean of the capped counts; counts: a column for each name in CAPS."""
    total = F.lit(0.0)
    for name, cap in CAPS.items():
        total = total + capped(counts[name], cap)
    return total / len(CAPS)


def total_score(relevant: Column, value: Column, at: Column, as_of: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """The weighted score; 0 without a time or for what is stale."""
    fresh = at.isNotNull() & (age_hours(at, as_of) <= STALE_DAYS * 24)
    score = clamp01(weights[0] * relevant.cast("double") + weights[1] * value + weights[2] * recency(at, as_of))
    return F.when(fresh, score).otherwise(0.0)


def post_entry(asset_id: Column, value: Column, at: Column, as_of: Column) -> Column:
    """struct<relevance, value, recency, score>, all 0 for what is stale."""
    fresh = at.isNotNull() & (age_hours(at, as_of) <= STALE_DAYS * 24)
    relevant = F.coalesce(asset_id != 0, F.lit(False))
    part = lambda c: F.when(fresh, c).otherwise(0.0)
    return F.struct(part(relevant.cast("double")).alias("relevance"), part(value).alias("value"), part(recency(at, as_of)).alias("recency"), total_score(relevant, value, at, as_of).alias("score"))


def tokens(asset_id: Column, symbol: Column) -> Column:
    """{symbol: 1.0} of an asset, else an empty map."""
    return F.when(F.coalesce(asset_id != 0, F.lit(False)), F.create_map(symbol, F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>"))


def top_relevance(asset_id: Column, symbol: Column) -> Column:
    """array<struct<symbol, relevance>> of at most one entry."""
    entry = F.array(F.struct(symbol.alias("symbol"), F.lit(1.0).alias("relevance")))
    return F.when(F.coalesce(asset_id != 0, F.lit(False)), entry).otherwise(F.array().cast("array<struct<symbol:string,relevance:double>>"))


def with_credibility(articles: DataFrame, source: str = "source") -> DataFrame:
    """articles with the credibility of their source; the table of sources has under a hundred rows."""
    known = credibility(articles.sparkSession).withColumnRenamed("source", "__source")
    return articles.join(F.broadcast(known), F.col(source) == F.col("__source"), "left").drop("__source").withColumn("credibility", F.coalesce("credibility", F.lit(DEFAULT_CREDIBILITY)))


def article_value(credibility: Column, content: Column) -> Column:
    """Mostly credibility, the rest for having content; empty content is none."""
    return 0.6 * credibility + 0.4 * F.when(F.length(content) > 0, 1.0).otherwise(0.5)


def article_weight(content: Column) -> Column:
    """What an article counts, by its length in characters."""
    n = F.length(F.coalesce(content, F.lit("")))
    return F.when(n >= 2000, 3).when(n >= 500, 2).otherwise(1)


def sentiment_value(sentiment: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in SENTIMENT_VALUES.items() for x in (F.lit(k), F.lit(v))]), F.coalesce(sentiment, F.lit("neutral")))


def doubled(query: Column, response: Column) -> Column:
    """1 if the response is twice the query, else 0."""
    return F.when(response == 2 * query, 1.0).otherwise(0.0)


@dataclass(frozen=True)
class Economy:
    """What turns points into shares of the emission."""

    token_usd: float
    subnet_price: float
    emission: float
    usd_per_point: float = 0.040
    epoch_length: int = 100
    min_percent_per_point: float = 0.003

    # The shares of emission that go to workers, blocks a day, and units to a token.
    def worker_alpha(self) -> float:
        return self.emission * 0.82 * 0.5 * 7200 / 2 / 1e9

    def alpha_per_point(self) -> float:
        return self.subnet_price * self.token_usd / self.usd_per_point

    def percent_needed(self, points: Column) -> Column:
        """The percentage of an epoch's emission that is worth the points; 0 where that can't be told."""
        supply = self.worker_alpha() * self.epoch_length
        if not supply or not self.alpha_per_point():
            return F.lit(0.0) * points
        return points / F.lit(self.alpha_per_point()) / F.lit(supply) * 100


def tempo(value: Column) -> Column:
    return F.coalesce(value + 1, F.lit(360))
