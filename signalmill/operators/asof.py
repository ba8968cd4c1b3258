"""What was in force at the time of each row, where changes come one by one.

Time is cut into bins.  What a bin starts with follows from the last change of every earlier
bin, one row a bin; within a bin, rows and changes are walked in order.  Bins of many rows are
dealt to as many walks as it takes, each with all changes of the bin, so no task gets a busy hour whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a bin; a hundred years are 876,000 bins.
BIN_SECONDS = 3600
#: Rows of one walk.
WALK_ROWS = 1 << 20


def in_force(rows: DataFrame, changes: DataFrame, at: str, since: str, values: list[str], order: list[str] | None = None, *, bin_seconds: int = BIN_SECONDS, walk_rows: int = WALK_ROWS) -> DataFrame:
    """rows and, for each of `values`, what the last change at or before `at` that gives it says; null before any.

    A null in a change leaves what was in force.  Of changes at one time the last by `order` counts, and of
    those alike in that, each value's greatest.  Rows without a time have nulls, changes without one do nothing.  Columns of rows come along,
    whatever their names; a value replaces a column of its name.
    """
    bin_of = lambda c: F.floor(F.unix_seconds(c) / bin_seconds).alias("bin")
    named = [f"v{i}" for i in range(len(values))]
    places = [f"p{i}" for i in range(len(order or []))]
    said = changes.where(F.col(since).isNotNull()).select(
        F.col(since).cast("timestamp").alias("t"), bin_of(F.col(since).cast("timestamp")),
        *[F.col(c).alias(p) for c, p in zip(order or [], places, strict=True)], *[F.col(c).alias(v) for c, v in zip(values, named, strict=True)],
    )
    said = said.groupBy("t", "bin", *places).agg(*[F.max(v).alias(v) for v in named])
    asked = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{at}`").cast("timestamp").alias("t")).withColumn("bin", bin_of(F.col("t")))

    def newest(v: str) -> Column:
        return F.max_by(v, F.when(F.col(v).isNotNull(), F.struct("t", *places, v))).alias(v)

    ends = said.groupBy("bin").agg(*map(newest, named), F.lit(0).cast("bigint").alias("n"))
    sizes = asked.where("bin is not null").groupBy("bin").agg(*[F.lit(None).cast(said.schema[v].dataType).alias(v) for v in named], F.count(F.lit(1)).alias("n"))
    bins = ends.unionByName(sizes).groupBy("bin").agg(*[F.first(v, ignorenulls=True).alias(v) for v in named], F.sum("n").alias("n"))
    before = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    walks = F.greatest(F.ceil(F.col("n") / walk_rows), F.lit(1)).cast("bigint")
    bins = bins.select("bin", walks.alias("walks"), *[F.last(v, ignorenulls=True).over(before).alias(f"{v}_start") for v in named])

    told_apart = [F.col("row")[c] for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]  # these have no hash
    met = asked.join(bins, "bin", "left").withColumn("walk", F.pmod(F.xxhash64("t", *told_apart), F.coalesce("walks", F.lit(1))))
    told = said.join(bins.select("bin", "walks"), "bin").withColumn("walk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("walks") - 1)))
    both = told.withColumn("asks", F.lit(False)).unionByName(met.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    walked = W.partitionBy("bin", "walk").orderBy("t", "asks", *places).rowsBetween(W.unboundedPreceding, 0)
    # rows without a time, however many, stay out of the walk
    timed = both.where("bin is not null").select("asks", "row", *[F.coalesce(F.last(v, ignorenulls=True).over(walked), F.col(f"{v}_start")).alias(v) for v in named]).where("asks").drop("asks")
    out = timed.unionByName(asked.where("bin is null").select("row", *[F.lit(None).cast(said.schema[v].dataType).alias(v) for v in named]))
    kept = [F.col("row")[c].alias(c) for c in rows.columns if c not in values]
    return out.select(*kept, *[F.col(v).alias(c) for c, v in zip(values, named, strict=True)])
