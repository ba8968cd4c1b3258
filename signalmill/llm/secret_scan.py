"""Secret scans over an incremental ledger of content-addressed blobs.

A text is a blob named by the SHA-256 of its bytes.  The ledger is a folder of
Parquet files with one row per scanned blob and rule version; a scan touches
only pairs that the ledger lacks, once per blob however many paths or versions
carry it, and findings are joined back to all of them.

Defined results: a null text is the empty blob, without findings; equal rows
each get their findings; of kinds that start together the order is that of KINDS; several texts under one doc_id are versions, each with
its own; a text is scanned whole, whatever its length; extra columns come along, and
names that begin with __secret_ are the operator's; an empty table gives an empty
result and leaves an empty ledger.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import text_batches
from .storage import smaller


#: Kinds in the order that spans at one start take; the first three are the base.
KINDS = ("assign", "access", "hex", "private_key", "jwt", "forge_token", "cloud_key", "url_login")
BASE = KINDS[:3]
RULE_VERSION = "2"

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ASSIGN_GATES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Signatures of well-known credential formats, each with a literal that every match holds.
FORMATS = (
    ("private_key", "-----BEGIN ", re.compile(r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----")),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.A)),
    ("forge_token", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}", re.A)),
    ("forge_token", "glpat-", re.compile(r"\bglpat-[A-Za-z0-9_-]{20,}", re.A)),
    ("cloud_key", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}", re.A)),
    ("cloud_key", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}", re.A)),
    ("url_login", "://", re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@[A-Za-z0-9.-]+", re.A)),
)
ORDER = {k: i for i, k in enumerate(KINDS)}


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then kind."""
    out = []
    folded = text.lower()
    if any(g in folded for g in ASSIGN_GATES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, gate, pattern in FORMATS:
        if gate in text:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


@F.arrow_udf(T.ArrayType(SPAN))
def scan_text(text: pa.Array) -> pa.Array:
    return pa.array(
        [[{"kind": k, "start": a, "end": b} for k, a, b in find(x.decode())] for _, part in text_batches(text) for x in part],
        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])),
    )


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class BlobLedger:
    """Findings of every blob seen, kept under one folder."""

    SCHEMA = "blob_id string, rule_version string, spans array<struct<kind:string,start:bigint,end:bigint>>"

    def __init__(self, spark: SparkSession, path: str, rule_version: str = RULE_VERSION):
        self.spark, self.path, self.rule_version = spark, path, rule_version

    def _rows(self) -> DataFrame | None:
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.where(F.col("rule_version") == self.rule_version)

    def findings(self) -> DataFrame | None:
        """One row per blob scanned under this rule version; None before the first scan."""
        rows = self._rows()
        # a scan that is run again after a lost commit may have appended the same blobs twice
        return None if rows is None else rows.dropDuplicates(["blob_id"])

    def scan(self, versions: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Scan the blobs of these versions that the ledger lacks, each once.

        Only ids travel to find the new blobs and a row that carries each; the
        texts move once, to meet the chosen rows.
        """
        rows = versions.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("blob_id", blob_id(F.col("text")))
        # a text without any version key still needs a row to be read from
        first = rows.groupBy("blob_id").agg(F.min("key").alias("key"))
        if (known := self._rows()) is not None:  # what is there twice bars a blob no more than once
            first = first.join(known.select("blob_id"), "blob_id", "left_anti")
        keyed = rows.alias("r").join(first.alias("f"), (F.col("r.blob_id") == F.col("f.blob_id")) & F.col("r.key").eqNullSafe(F.col("f.key")), "left_semi")
        found = keyed.select("blob_id", F.lit(self.rule_version).alias("rule_version"), scan_text("text").alias("spans"))
        found.write.mode("append").partitionBy("rule_version").parquet(self.path)

    def join(self, versions: DataFrame, text: str = "text", prefix: str = "__secret_") -> DataFrame:
        """Every row of versions with, under prefix, the blob and spans of its text; blobs without findings stay out of the join."""
        blob, spans = f"{prefix}blob", f"{prefix}spans"
        found = self._rows().where(F.size("spans") > 0).dropDuplicates(["blob_id"]).select(F.col("blob_id").alias(blob), F.col("spans").alias(spans))
        out = versions.withColumn(blob, blob_id(F.col(text))).join(smaller(found, F.size(spans)), blob, "left")
        return out.withColumn(spans, F.coalesce(spans, F.array().cast(found.schema[spans].dataType)))


def span_list(spans: Column) -> Column:
    """kind:start:end joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
