"""What a worker sends back: a batch with the classification of each item as its kind's annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("content_type", "technical_quality", "market_analysis", "impact_potential")


def annotation(classification: Column, kind: str, analyzed_at: Column | None = None) -> Column:
    """struct of sentiment, the subject's id and symbol, and labels.

    Of a post and an article without confidence and evidence; an article's subject is a
    sector; a chat's has id 0, which its store replaces, and the time of analysis.
    """
    subject = "sector" if kind == "article" else "asset"
    fields = [
        classification["sentiment"].alias("sentiment"),
        classification["id"].alias(f"{subject}_id"),
        classification["symbol"].alias(f"{subject}_symbol"),
        *[classification[x].alias(x) for x in LABELS],
    ]
    if kind == "chat":
        fields = [F.lit(0).cast("long").alias("id"), *fields, (F.lit(None) if analyzed_at is None else analyzed_at).cast("timestamp").alias("analyzed_at")]
    return F.struct(*fields)


def annotated(items: DataFrame, classification: str, kind: str, analyzed_at: Column | None = None) -> DataFrame:
    """items with `analysis` for the classification in that column; items without one, as those without text, aren't sent."""
    # exploded rather than filtered: a filter on what is computed would compute it twice
    kept = items.withColumn(classification, F.explode(F.array_compact(F.array(classification))))
    return kept.withColumn("analysis", annotation(F.col(classification), kind, analyzed_at)).drop(classification)
