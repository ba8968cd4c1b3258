"""Tables in shared storage: written once and read back, or replaced whole by a new version.

A versioned table is a folder with one sub-folder for each version and a pointer file for each switch.  A
version is written first; then its pointer is renamed into place under the next number, which
storage refuses if another writer took it.  Readers follow the highest pointer, so they see the old version or
the new one and nothing in between, a job may replace the table that it reads from, and one that is
killed before the switch leaves the old version in force.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Versions that stay readable for whoever still reads them.
KEEP_VERSIONS = 2


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only for a local master without that setting, as in tests."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="signalmill-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/signalmill/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to the shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class TableChanged(RuntimeError):
    """Another writer has replaced the table meanwhile."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _storage(self):
        return self._file("").getFileSystem(self._conf)

    def _pointers(self) -> list[int]:
        folder = self._file("pointers")
        if not self._storage().exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._storage().listStatus(folder) if f.getPath().getName().isdigit())

    def _pointer(self, number: int) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/pointers/{number}").collect()))

    def version(self) -> int:
        """The number of the version in force, 0 before the first."""
        return max(self._pointers(), default=0)

    def marks(self) -> dict:
        """What the version in force was marked with."""
        number = self.version()
        return self._pointer(number)["marks"] if number else {}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the one in force; none before the first."""
        number = self.version() if version is None else version
        if not number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._pointer(number)['folder']}")

    def replace(self, df: DataFrame, **marks) -> int:
        """Write a new version and switch to it; df may read the one in force.  The new version's number."""
        number = self.version() + 1
        folder = f"rows-{uuid.uuid4().hex}"
        df.select(*[df[f.name].cast(f.dataType) for f in self.schema]).write.parquet(f"{self.path}/{folder}")
        self._switch(number, {"folder": folder, "marks": marks})
        self._forget(number - KEEP_VERSIONS)
        return number

    def _switch(self, number: int, content: dict) -> None:
        fs = self._storage()
        draft = self._file(f"pointers/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(self._file(f"pointers/{number}")), options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise TableChanged(f"version {number} of {self.path} is there already") from e

    def _forget(self, last: int) -> None:
        for number in self._pointers():
            if number <= last:
                self._storage().delete(self._file(self._pointer(number)["folder"]), True)
                self._storage().delete(self._file(f"pointers/{number}"), False)
