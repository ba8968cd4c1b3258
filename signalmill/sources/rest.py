"""A batch source over an HTTP API that leases items as JSON lists."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: What each refusal means to the caller.
REFUSALS = {401: "not authenticated", 403: "not allowed", 404: "not found"}


class ApiError(RuntimeError):
    pass


def fetched(url: str, headers: dict[str, str], retries: int = 3, delay: float = 1.0, timeout: float = 30.0, opener: Callable = urllib.request.urlopen, wait: Callable = time.sleep) -> list[dict]:
    """The list behind a URL.  Only failures to connect are tried again, after a longer delay each time."""
    for attempt in range(retries + 1):
        try:
            with opener(urllib.request.Request(url, headers=headers), timeout=timeout) as response:
                return json.loads(response.read())
        except urllib.error.HTTPError as e:
            raise ApiError(REFUSALS.get(e.code, f"status {e.code}")) from e
        except (urllib.error.URLError, TimeoutError) as e:
            if attempt == retries:
                raise ApiError("no connection") from e
            wait(delay * (attempt + 1))
    raise AssertionError("unreachable")


class LeaseReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        # a lease marks its rows, so it is asked for once
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url = f"{self.options['url']}?limit={self.options.get('limit', '24')}"
        headers = {"Authorization": self.options["token"]} if "token" in self.options else {}
        for item in fetched(url, headers, int(self.options.get("retries", "3")), float(self.options.get("delay", "1"))):
            yield tuple(item.get(f.name) for f in self.schema)


class LeaseSource(DataSource):
    """spark.dataSource.register(LeaseSource); spark.read.format("lease").schema(...).option("url", ...)."""

    @classmethod
    def name(cls) -> str:
        return "lease"

    def schema(self) -> str:
        return "id bigint, text string"

    def reader(self, schema: StructType) -> LeaseReader:
        return LeaseReader(schema, dict(self.options))
