"""WARC archives: pages written as records, and records read back in parallel from any place of a file.

Writing.  A payload that an earlier page has as well is not stored again: of equal payloads
the page with the smallest id is the response, and the others are revisits that refer
to it.  Each task writes files of its own, at most FILE_BYTES and a record long.

Reading, by boundary-chain verification.  A record can only be found by the bytes that it begins
with, and a payload may hold the same bytes.  So files are cut into ranges; each task looks for
these bytes in its range and emits, for each candidate, the place of the record that would follow,
and where the chain of such records leaves the range.  Pointers from range to range are then followed from
the start of every file by pointer jumping, each round twice as far, until it is known in which place each range is
entered.  Only what is reached from there is a record; candidates inside payloads are left out.

Defined results: a null html is an empty payload; pages of equal payload and equal smallest id
are all responses, as are those of which no page has an id; a page without an id is otherwise a revisit.
A null url is left out; spaces and control characters of a url are percent-encoded.  Payloads of any
length are kept whole.  A file that is cut off or damaged gives the records before the damage, and :func:`chains`
tells how far each file is whole.  An empty table gives no file and no record; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh_path, smaller, trimmed, written

MAGIC, BREAK = b"WARC/1.1\r\n", b"\r\n\r\n"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Length at which a file is closed, bytes to a range, bytes read at once beyond a range, bytes of files for a reading task.
FILE_BYTES, RANGE_BYTES, STEP_BYTES, TASK_BYTES = 1 << 26, 1 << 22, 1 << 16, 1 << 24
#: Groups with more than one row of so many are hot; there are no more of them than this.
HOT_SHARE = 1000
RECORDS = "page_id bigint, target_uri string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return "<urn:page:>" if page_id is None else f"<urn:page:{page_id}>"


def _page_id(urn: str) -> int | None:
    number = urn.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """A whole record; a revisit has the headers of its response, but not the payload again."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": REVISIT if revisit else RESPONSE,
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "WARC-Refers-To": _urn(refers_to) if revisit else None,
        "WARC-Profile": PROFILE if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return MAGIC + head.encode() + b"\r\n" + block + BREAK


def fields_of(head: bytes) -> dict[str, str]:
    """Lower-case names and values of header lines."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def content_length(head: bytes) -> int | None:
    found = re.search(rb"\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", head, re.I)
    return int(found[1]) if found else None


def parsed(content: bytes, at: int) -> dict:
    """The row of a record, of its bytes up to its block's end and where its header ends."""
    fields, block = fields_of(content[:at]), content[at + len(BREAK) :]
    http, _, payload = block.partition(BREAK)
    revisit = fields["warc-type"] == REVISIT
    size = content_length(http + b"\r\n") if revisit else len(payload)
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "target_uri": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:") if revisit else payload_digest(payload),
        "refers_to": _page_id(fields["warc-refers-to"]) if revisit else None,
    }


def with_first(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with `revisit` and, for revisits, `refers_to`.

    Payloads are told apart by SHA-256, of which only those that repeat are looked up: by broadcast if
    they are few; else the few with over a thousandth of all rows each by broadcast, the
    others by key, so that no key brings many rows into one task.
    """
    key = F.when(F.octet_length("payload") >= least_bytes, F.unhex(F.sha2("payload", 256)))
    keyed = pages.withColumn("__key", key)
    groups = keyed.where("__key is not null").groupBy("__key").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    groups = written(groups, "payloads")
    held = smaller(groups)
    if held is not groups:
        out = keyed.join(held, "__key", "left")
    else:
        bound = F.lit(max(1, pages.count() // HOT_SHARE))
        hot = F.broadcast(groups.where(F.col("__n") > bound))
        few = keyed.join(hot, "__key")
        rest = keyed.where("__key is not null").join(hot.select("__key"), "__key", "left_anti").join(groups.where(F.col("__n") <= bound), "__key", "left")
        short = keyed.where("__key is null").select("*", F.lit(None).cast("bigint").alias("__first"), F.lit(None).cast("bigint").alias("__n"))
        out = few.unionByName(rest).unionByName(short)
    revisit = F.col("__n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return out.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("__first")).alias("refers_to"))


MANIFEST = "path string, length bigint"


def write(pages: DataFrame, folder: str, *, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives in folder; returns (path, length) of the files.

    Payloads of fewer than `least_bytes` bytes are never revisits.  Each attempt of a task
    writes files of its own; the manifest, which Spark commits, names those of the attempts that finished.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))

    def work(chunks):
        name = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        file, length, number = None, 0, 0
        for chunk in chunks:
            done = []
            for row in zip(*(chunk.column(c).to_pylist() for c in ("page_id", "url", "payload", "revisit", "refers_to")), strict=True):
                if file is None:
                    fs, path = pafs.FileSystem.from_uri(f"{name}-{number:05d}.warc")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    file = fs.open_output_stream(path)
                whole = record(*row)
                file.write(whole)
                length += len(whole)
                if length >= file_bytes:
                    file.close()
                    done.append((f"{name}-{number:05d}.warc", length))
                    file, length, number = None, 0, number + 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "length"])
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{number:05d}.warc"]), pa.array([length])], names=["path", "length"])
        trimmed()

    return written(with_first(rows, least_bytes).mapInArrow(work, MANIFEST), "archives")


def listed(spark, folder: str) -> DataFrame:
    """(path, length) of the files of a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").option("recursiveFileLookup", "true").load(folder).select("path", "length")


class Window:
    """Bytes of a file from one place on, read further as far as they are asked for."""

    def __init__(self, path: str, start: int, end: int):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        self.size = self.file.size()
        self.start = start
        self.file.seek(start)
        self.content = self.file.read(min(end, self.size) - start)

    @property
    def end(self) -> int:
        return self.start + len(self.content)

    def reach(self, end: int) -> bool:
        """Have the bytes up to a place; whether there are so many."""
        if end > self.end:
            self.content += self.file.read(min(max(end, self.end + STEP_BYTES), self.size) - self.end)
        return end <= self.end

    def head_end(self, at: int) -> int | None:
        """Where the blank line behind the header at this place begins."""
        look = at
        while (found := self.content.find(BREAK, look - self.start)) < 0:
            look = max(at, self.end - len(BREAK) + 1)
            if not self.reach(self.end + 1):
                return None
        return self.start + found

    def successor(self, at: int) -> tuple[int, int] | None:
        """Of a record at this place: the end of its header, and where the next one begins; null if there can't be a record."""
        if not self.reach(at + len(MAGIC)) or self.content[at - self.start : at - self.start + len(MAGIC)] != MAGIC:
            return None
        stop = self.head_end(at)
        length = None if stop is None else content_length(self.content[at - self.start : stop - self.start])
        after = None if length is None else stop + 2 * len(BREAK) + length
        return None if after is None or after > self.size else (stop, after)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def scan(path: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """Candidates of a range: (place, successor, where the chain from there leaves the range, -1 if it breaks off)."""
    found: list[tuple[int, int]] = []
    first = max(0, start - len(BREAK))
    with Window(path, first, end + len(MAGIC) - 1) as window:
        limit, last = window.end, min(end, window.size)
        at = window.content.find(MAGIC, start - first)
        while at >= 0 and first + at < min(end, limit):
            place = first + at
            if place == 0 or window.content[max(0, at - len(BREAK)) : at] == BREAK:
                after = window.successor(place)
                if after:
                    found.append((place, after[1]))
            at = window.content.find(MAGIC, at + 1)
    leaves: dict[int, int] = {}
    for place, after in reversed(found):
        leaves[place] = after if after >= last else leaves.get(after, -1)
    return [(place, after, leaves[place]) for place, after in found]


CANDIDATES = "path string, range bigint, place bigint, successor bigint, leaves bigint"


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a few numbers that stand for `size` bytes of files, over as many tasks as that takes."""
    return rows.repartition(max(1, math.ceil(size / TASK_BYTES)))


def candidates(files: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All places of files (path, length) that look like the beginning of a record, with what would follow."""
    size = files.agg(F.sum("length")).first()[0] or 0
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / range_bytes).cast("bigint"))).alias("range"))

    def work(chunks):
        for chunk in chunks:
            for path, number in zip(chunk.column("path").to_pylist(), chunk.column("range").to_pylist(), strict=True):
                found = scan(path, number * range_bytes, (number + 1) * range_bytes)
                places = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([number] * len(found), pa.int64()), *places], names=["path", "range", "place", "successor", "leaves"])
            trimmed()

    return written(_dealt(ranges, size).mapInArrow(work, CANDIDATES), "candidates")


def entries(found: DataFrame) -> DataFrame:
    """(path, range, place, leaves) of the candidates at which the chain from a file's start enters a range.

    Pointer jumping over those that a chain from another range, or the file's start, points at:
    each round a pointer skips as many ranges again, and what a reached one points at is reached.
    """
    # a chain enters a range once, so most candidates are no one's target and need no round
    targets = found.where("leaves >= 0").select("path", F.col("leaves").alias("place")).distinct()
    entered = found.join(targets, ["path", "place"], "left_semi").where("place > 0").unionByName(found.where("place = 0"))
    hops = entered.select("path", "range", "place", "leaves", F.col("leaves").alias("jump"), (F.col("place") == 0).alias("reached"))
    last = found.agg(F.max("range")).first()[0] or 0
    for _ in range(math.ceil(math.log2(last + 1))):
        hops = written(hops, "hops")
        onto = hops.select("path", F.col("place").alias("jump"), F.col("jump").alias("further"))
        marks = hops.where("reached").select("path", F.col("jump").alias("place"), F.lit(True).alias("mark")).distinct()
        hops = hops.join(onto, ["path", "jump"], "left").join(marks, ["path", "place"], "left")
        hops = hops.select("path", "range", "place", "leaves", F.col("further").alias("jump"), (F.col("reached") | F.col("mark").isNotNull()).alias("reached"))
    return written(hops.where("reached").select("path", "range", "place", "leaves"), "entries")


def walk(path: str, place: int, end: int) -> Iterator[dict]:
    """The records from a verified place to the end of its range; the bytes of the range are read once."""
    with Window(path, place, end) as window:
        while place < min(end, window.size):
            after = window.successor(place)
            if after is None or not window.reach(after[1]):
                return
            first = place - window.start
            yield parsed(window.content[first : after[1] - window.start - len(BREAK)], after[0] - place)
            place = after[1]


def records(files: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of archives (path, length): page_id, target_uri, record_type, payload (null of a revisit), payload_bytes, payload_digest, refers_to."""
    size = files.agg(F.sum("length")).first()[0] or 0

    def work(chunks):
        for chunk in chunks:
            for path, number, place in zip(*(chunk.column(c).to_pylist() for c in ("path", "range", "place")), strict=True):
                held, weight = [], 0
                for row in walk(path, place, (number + 1) * range_bytes):
                    held.append(row)
                    weight += row["payload_bytes"]
                    if weight >= STEP_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=RECORD_SCHEMA)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=RECORD_SCHEMA)
            trimmed()

    return _dealt(entries(candidates(files, range_bytes=range_bytes)).select("path", "range", "place"), size).mapInArrow(work, RECORDS)


RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def chains(files: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, length, whole): whether the chain from a file's start ends at its end."""
    ends = entries(candidates(files, range_bytes=range_bytes)).groupBy("path").agg(F.max("leaves").alias("last"))
    return files.join(ends, "path", "left").select("path", "length", ((F.col("length") == 0) | F.coalesce(F.col("last") == F.col("length"), F.lit(False))).alias("whole"))


def round_trip(pages: DataFrame, folder: str | None = None, *, least_bytes: int = 0, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write pages into archives, by default in a fresh shared folder, and read their records back."""
    files = write(pages, folder or fresh_path(pages.sparkSession, "warc"), least_bytes=least_bytes, file_bytes=file_bytes)
    return records(files, range_bytes=range_bytes)
