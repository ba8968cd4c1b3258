"""Running sums and places over whole tables, and joins of points with intervals, without a single task or a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import materialised


def intervals(df: DataFrame, size: Column, *order: str | Column) -> DataFrame:
    """df with `start` and `end`: each row's stretch of `size`, laid end to end in this order, which has to tell rows apart.

    Rows are dealt by ranges of the order and summed up within each range; only the ranges' own sums, one number for
    each task, are added up in one place.
    """
    keyed = df.withColumn("__order", F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{k}") for k, c in enumerate(order)]))
    keyed = keyed.withColumn("__size", size.cast("long")).repartitionByRange("__order").withColumn("__part", F.spark_partition_id())
    keyed = materialised(keyed, "ranges")  # a range's number is to stay what it is, so it is computed once
    sums = keyed.groupBy("__part").agg(F.sum("__size").alias("__sum"))
    earlier = F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("__part", earlier.alias("__base"))
    upto = F.sum("__size").over(W.partitionBy("__part").orderBy("__order").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = keyed.withColumn("__upto", upto).join(F.broadcast(base), "__part")
    return out.select(*df.columns, (F.col("__base") + F.col("__upto") - F.col("__size")).alias("start"), (F.col("__base") + F.col("__upto")).alias("end"))


def numbered(df: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """df with each row's place in this order, from 0."""
    return intervals(df, F.lit(1), *order).withColumn(name, F.col("start")).drop("start", "end")


def within(points: DataFrame, at: str, spans: DataFrame, width: int) -> DataFrame:
    """points with the columns of the span (start, end exclusive) that each lies in; those in none are left out.

    Both sides are cut into bins of `width`, which meet by equality: a span no longer than that is in two bins at most.
    """
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    binned = spans.where(F.col("end") > F.col("start")).withColumn("__bin", F.explode(bins))
    met = points.withColumn("__bin", F.floor(F.col(at) / width)).join(binned, "__bin")
    return met.where((F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))).drop("__bin", "start", "end")
