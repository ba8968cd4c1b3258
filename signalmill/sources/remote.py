"""Settings pulled from elsewhere: typed, in force from a time on, reread by every micro-batch, with signals that act once.

A pull is a JSON object {pulled_at, config, blacklisted_hotkeys, min_validator_version, reset_broadcasts_before_epoch,
purge_broadcast_hotkeys, reset_scores_id}; pulls are appended to a folder, in order of time.  A value that is missing, or not of
its setting's type, leaves what was in force.  An override is used instead of all pulls; one of another type leaves the
default.  The list of barred hotkeys and the least version are those of the last pull, whole.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.asof import in_force
from ..tables import VersionedTable

# The settings that may be pulled, with their types and defaults.
SETTINGS: dict[str, tuple[str, int | float]] = {
    "USD_PRICE_PER_POINT": ("double", 0.040),
    "MINER_BATCH_SIZE": ("int", 3),
    "VALIDATION_FETCH_LIMIT": ("int", 24),
    "MIN_PERCENT_PER_POINT": ("double", 0.003),
}
NO_VERSION = "0.0.0"

PULL = T.StructType(
    [
        T.StructField("pulled_at", T.TimestampType()),
        T.StructField("config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("blacklisted_hotkeys", T.ArrayType(T.StringType())),
        T.StructField("min_validator_version", T.StringType()),
        T.StructField("reset_broadcasts_before_epoch", T.LongType()),
        T.StructField("purge_broadcast_hotkeys", T.ArrayType(T.StringType())),
        T.StructField("reset_scores_id", T.StringType()),
    ]
)
SIGNAL = "signal string, before_epoch bigint, hotkeys array<string>, scores boolean, batch bigint"


class Outdated(RuntimeError):
    """This version is below the least that is pulled; what was read stays unprocessed and is read again after an update."""


def pulls(spark: SparkSession, path: str) -> DataFrame:
    """What has been pulled so far; files that are no JSON are pulls without a time, which do nothing."""
    return spark.read.schema(PULL).json(path)


def typed(config: Column, name: str) -> Column:
    return config[name].try_cast(SETTINGS[name][0])


def changes(pulled: DataFrame) -> DataFrame:
    """(pulled_at, a column for each setting): what each pull changes, null where it gives nothing of the right type."""
    return pulled.where("pulled_at is not null").select("pulled_at", *[typed(F.col("config"), n).alias(n) for n in SETTINGS])


def _overridden(name: str, overrides: Mapping[str, str | None]) -> Column:
    """The override, or the default if it isn't of the type."""
    kind, default = SETTINGS[name]
    return F.coalesce(F.lit(overrides[name]).try_cast(kind), F.lit(default).cast(kind))


def settings(pulled: DataFrame, as_of: Column | None = None, overrides: Mapping[str, str | None] | None = None) -> DataFrame:
    """One row: the settings in force at as_of (by default after all pulls), each of its type."""
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    rows = changes(pulled)
    if as_of is not None:
        rows = rows.where(F.col("pulled_at") <= as_of)
    last = rows.agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.struct("pulled_at", n))).alias(n) for n in SETTINGS])
    return last.select(*[(_overridden(n, given) if n in given else F.coalesce(n, F.lit(d).cast(k))).alias(n) for n, (k, d) in SETTINGS.items()])


def with_settings(rows: DataFrame, pulled: DataFrame, at: str, names: list[str] | None = None, order: list[str] | None = None, overrides: Mapping[str, str | None] | None = None) -> DataFrame:
    """rows with the settings that were in force at each one's time; defaults before the first pull and without a time."""
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    names = list(SETTINGS) if names is None else names
    said = pulled.select("pulled_at", *[typed(F.col("config"), n).alias(n) for n in names], *(order or []))
    out = in_force(rows, said, at, "pulled_at", names, order)
    return out.withColumns({n: _overridden(n, given) if n in given else F.coalesce(n, F.lit(SETTINGS[n][1]).cast(SETTINGS[n][0])) for n in names})


def _last(pulled: DataFrame, as_of: Column) -> DataFrame:
    return pulled.where(F.col("pulled_at") == as_of)


def barred(pulled: DataFrame, as_of: Column, override: str | None = None) -> DataFrame:
    """(hotkey) of the last pull's list, or of an override, separated by commas."""
    if override is not None:
        found = [x.strip() for x in override.split(",") if x.strip()]
        return pulled.sparkSession.createDataFrame([(x,) for x in found], "hotkey string").distinct()
    return _last(pulled, as_of).select(F.explode("blacklisted_hotkeys").alias("hotkey")).where("hotkey is not null").distinct()


def signals(pulled: DataFrame) -> DataFrame:
    """(signal, before_epoch, hotkeys, scores): the distinct signals of all pulls; the order and repeats of hotkeys don't matter."""
    epoch = F.coalesce("reset_broadcasts_before_epoch", F.lit(-1).cast("bigint"))
    hotkeys = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("purge_broadcast_hotkeys", F.array().cast("array<string>")))))
    scores = F.coalesce("reset_scores_id", F.lit(""))
    rows = pulled.where("pulled_at is not null").select(epoch.alias("before_epoch"), hotkeys.alias("hotkeys"), scores.alias("scores_id"))
    rows = rows.where((F.col("before_epoch") >= 0) | (F.size("hotkeys") > 0) | (F.col("scores_id") != "")).distinct()
    signal = F.to_json(F.struct("before_epoch", "hotkeys", "scores_id"))
    return rows.select(signal.alias("signal"), "before_epoch", "hotkeys", (F.col("scores_id") != "").alias("scores"))


@dataclass(frozen=True)
class Decision:
    """What a micro-batch works by: settings by name, barred hotkeys, and signals that no batch before it has had."""

    settings: dict[str, int | float]
    barred: DataFrame
    signals: DataFrame


def _parts(version: str) -> list[int] | None:
    """1.2.10 as numbers; None where it isn't all numbers, which gates nothing."""
    found = version.split(".")
    return [int(x) for x in found] if all(x.isdigit() for x in found) else None


def decided(spark: SparkSession, path: str, journal: VersionedTable, batch: int, overrides: Mapping[str, str | None], version: str | None) -> Decision:
    """The decision of a batch, the same whenever it is played again.

    The journal holds the signals that batches have had and, as a mark, which pull the last one worked by.
    """
    marks = journal.marks()
    found = pulls(spark, path)
    if marks.get("batch") != batch:
        newest = found.agg(F.max("pulled_at").cast("string").alias("t")).first().t
        found_until = found.where(F.col("pulled_at") <= F.lit(newest).cast("timestamp"))
        had = journal.read()
        new = signals(found_until).join(had.select("signal"), "signal", "left_anti").withColumn("batch", F.lit(batch).cast("bigint"))
        marks = {"batch": batch, "as_of": newest}
        if version is not None and newest is not None:
            _gate(found, newest, version)
        journal.replace(had.unionByName(new), **marks)
    as_of = F.lit(marks["as_of"]).cast("timestamp")
    return Decision(
        settings(found, as_of, overrides).first().asDict(),
        barred(found, as_of, overrides.get("BLACKLISTED_HOTKEYS")),
        journal.read().where(F.col("batch") == batch).drop("batch"),
    )


def _gate(pulled: DataFrame, as_of: str, version: str) -> None:
    least = _last(pulled, F.lit(as_of).cast("timestamp")).agg(F.max("min_validator_version").alias("v")).first().v or NO_VERSION
    have, need = _parts(version), _parts(least)
    if have is not None and need is not None and have < need:
        raise Outdated(f"version {version} is below {least}")


def governed(rows: DataFrame, path: str, folder: str, apply: Callable[[DataFrame, Decision, int], None], *, overrides: Mapping[str, str | None] | None = None, version: str | None = None) -> DataStreamWriter:
    """A stream whose every batch works by what is pulled when it starts; start it with any trigger.

    apply gets the rows, the decision and the batch's number.  It should write under that number, as a batch that is
    played again comes with the same rows, settings and signals.
    """
    spark = rows.sparkSession
    journal = VersionedTable(spark, f"{folder}/signals", SIGNAL)

    def run(batch_rows: DataFrame, batch: int) -> None:
        session = batch_rows.sparkSession
        apply(batch_rows, decided(session, path, VersionedTable(session, journal.path, journal.schema), batch, overrides or {}, version), batch)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/state")
