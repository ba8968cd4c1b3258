"""A streaming source of validators' commitments, block by block, over an HTTP API.

The API has {url}/head, a list of one object with the last `block`, and
{url}/commitments?after=A&upto=B, the commitments of the blocks after A up to B.  A stream's offset is a block number,
so one that is started again goes on with the blocks after those it has committed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .rest import fetched

#: Blocks that one task asks for, and blocks that one batch takes at most.
TASK_BLOCKS, BATCH_BLOCKS = 100, 10_000


class BlockRange(InputPartition):
    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


class CommitmentStream(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, {k.lower(): v for k, v in options.items()}  # as Spark spells options
        self.task_blocks, self.batch_blocks = int(self.options.get("taskblocks", TASK_BLOCKS)), int(self.options.get("batchblocks", BATCH_BLOCKS))
        self.reached = int(self.options.get("startblock", "0"))

    def _get(self, path: str) -> list[dict]:
        headers = {"Authorization": self.options["token"]} if "token" in self.options else {}
        return fetched(f"{self.options['url']}/{path}", headers, int(self.options.get("retries", "3")), float(self.options.get("delay", "1")))

    def initialOffset(self) -> dict:
        return {"block": int(self.options.get("startblock", "0"))}

    def latestOffset(self) -> dict:
        # a head that falls back, as behind a slow node, takes nothing back
        self.reached = max(self.reached, min(int(self._get("head")[0]["block"]), self.reached + self.batch_blocks))
        return {"block": self.reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = max(self.reached, end["block"])
        cuts = [*range(start["block"], end["block"], self.task_blocks), end["block"]]
        return [BlockRange(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: BlockRange) -> Iterator[tuple]:
        for row in self._get(f"commitments?after={partition.after}&upto={partition.upto}"):
            yield tuple(row.get(f.name) for f in self.schema)


class CommitmentSource(DataSource):
    """spark.dataSource.register(CommitmentSource); spark.readStream.format("commitments").option("url", ...).load()."""

    @classmethod
    def name(cls) -> str:
        return "commitments"

    def schema(self) -> str:
        return "hotkey string, block bigint, data string"

    def streamReader(self, schema: StructType) -> CommitmentStream:
        return CommitmentStream(schema, dict(self.options))
