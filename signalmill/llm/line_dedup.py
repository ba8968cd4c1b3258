"""Line dedup by content-defined chunks of lines.

What goes: a line that lies in a run of consecutive lines (blank ones left out) of
50 words or more, if a document of smaller id holds that run, too.  Whether a run
goes depends on nothing else: not on what stands around it, nor on where texts are
cut.  A run of fewer words stays.

How it is found: a rolling hash over the last four line hashes cuts a text after
about one line in eight, so chunks of several lines begin anew soon after any
insertion.  Chunks are grouped over all documents by their bytes; one that a
document of smaller id holds goes whole.  Runs whose ends lie inside chunks are
found by windows, the shortest runs of 50 words that begin or end at each line: a
run is the union of its windows, and only windows that no copied chunk covers are
looked up.  A window is told by a cryptographic digest of 128 bits.

Defined results: a null text stays null and an empty one empty; a text without line
breaks is one line; rows of one doc_id are one document, so a run is never removed
for standing in it twice; null doc_ids neither lose lines nor make others lose
them; blank lines within what goes go with it, and don't count; of equal rows each
loses the same; extra columns come along, and names under the prefix are the
result's; an empty table gives an empty result.  A text of any length is hashed in
pieces of bounded size.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import hasher, mixed, stream, text_batches
from .storage import BROADCAST_ROWS, smaller, written

#: A run of so many words is a passage.
PASSAGE = 50
#: Lines that the rolling hash covers; of its values, one in CUT cuts; fewest and most lines of a chunk.
ROLL, CUT, LEAST_LINES, MOST_LINES = 4, 8, 2, 32
#: Rows of one chunk or window to a key of a join.
HOT = 1000


class Lines:
    """The lines with a word of a batch of texts: where they are, their words, and whether the rolling hash cuts after them."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.raw, np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        gaps = hasher().spaces[data]
        words = np.flatnonzero(~gaps[1:] & gaps[:-1]) + 1
        if not gaps[0]:
            words = np.concatenate([[0], words])
        count = np.searchsorted(words, ends) - np.searchsorted(words, starts)
        full = count > 0
        self.starts, self.ends, self.words = starts[full], ends[full], count[full]
        limits = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.at = np.searchsorted(self.starts, limits)
        hashes = hasher().spans(data, self.starts, self.ends)
        first = np.repeat(self.at[:-1], np.diff(self.at))
        place = np.arange(len(hashes))
        rolled = np.zeros(len(hashes), np.uint64)
        for k, factor in enumerate((stream(31, ROLL) | np.uint64(1)).tolist()):
            inside = place - k >= first
            rolled[inside] += hashes[place[inside] - k] * np.uint64(factor)
        self.cuts = mixed(rolled) % np.uint64(CUT) == 0

    def bytes(self, first: int, last: int) -> bytes:
        """The lines from first to last, without blank ones."""
        a, b = self.starts[first : last + 1], self.ends[first : last + 1]
        if (a[1:] == b[:-1] + 1).all():
            return self.raw[a[0] : b[-1]]
        return b"\n".join(self.raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True))

    def chunks(self, text: int) -> list[tuple[int, int]]:
        """First and last line of each chunk of a text."""
        a, b = int(self.at[text]), int(self.at[text + 1])
        after = (np.flatnonzero(self.cuts[a:b]) + a + 1).tolist()
        out, start = [], a
        while start < b:
            k = bisect_left(after, start + LEAST_LINES)
            end = min(after[k] if k < len(after) else b, start + MOST_LINES, b)
            out.append((start, end - 1))
            start = end
        return out

    def passages(self, text: int) -> list[tuple[int, int, int, bytes]]:
        """(first, last, hash, bytes) of the chunks of several lines and PASSAGE words."""
        a, b = int(self.at[text]), int(self.at[text + 1])
        if b - a < 2 or self.words[a:b].sum() < PASSAGE:
            return []
        out = []
        for first, last in self.chunks(text):
            if first < last and self.words[first : last + 1].sum() >= PASSAGE:
                content = self.bytes(first, last)
                out.append((first, last, int.from_bytes(blake2b(content, digest_size=8).digest(), "little", signed=True), content))
        return out

    def windows(self, text: int) -> list[tuple[int, int]]:
        """First and last line of the shortest runs of PASSAGE words that begin or end at each line."""
        a, b = int(self.at[text]), int(self.at[text + 1])
        before = np.concatenate([[0], np.cumsum(self.words[a:b])])
        if before[-1] < PASSAGE:
            return []
        lines = np.arange(b - a)
        ends = np.searchsorted(before, before[:-1] + PASSAGE) - 1
        starts = np.searchsorted(before, before[1:] - PASSAGE, side="right") - 1
        good = ends < b - a
        out = set(zip(lines[good].tolist(), ends[good].tolist(), strict=True))
        good = before[1:] >= PASSAGE
        out |= set(zip(starts[good].tolist(), lines[good].tolist(), strict=True))
        return sorted((a + i, a + j) for i, j in out)


CHUNK = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("chunk", T.BinaryType())]))
RUNS = T.StructType(
    [
        T.StructField("chunks", T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
        T.StructField("windows", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("hash", T.LongType())]))),
    ]
)
CLEANED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed_lines", T.LongType()), T.StructField("n_removed_words", T.LongType())])


def once(function):
    """Lest the optimiser copy the function into a filter on its result, and compute it twice."""
    return function.asNondeterministic()


@once
@F.arrow_udf(CHUNK)
def chunks_of(texts: pa.Array) -> pa.Array:
    """The distinct chunks of each text that may go by themselves."""
    offsets, hashes, parts = [0], [], []
    for _, some in text_batches(texts):
        lines = Lines(some)
        for i in range(len(some)):
            found = {h: content for _, _, h, content in lines.passages(i)}
            hashes += found
            parts += found.values()
            offsets.append(len(hashes))
    flat = pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(parts, pa.binary())], ["hash", "chunk"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


@once
@F.arrow_udf(RUNS)
def runs_of(texts: pa.Array) -> pa.Array:
    """Where those chunks are, by numbers of lines with a word, and the windows, each with the chunk that holds it whole."""
    chunk_ends, window_ends = [0], [0]
    chunks: list[tuple] = []
    windows: list[tuple] = []
    for _, some in text_batches(texts):
        lines = Lines(some)
        for i in range(len(some)):
            base = int(lines.at[i])
            passages = lines.passages(i)
            chunks += [(h, first - base, last - base) for first, last, h, _ in passages]
            begins = [p[0] for p in passages]
            for first, last in lines.windows(i):
                digest = blake2b(lines.bytes(first, last), digest_size=16).digest()
                k = bisect_left(begins, first + 1) - 1
                inside = passages[k][2] if k >= 0 and last <= passages[k][1] else None
                windows.append((first - base, last - base, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), inside))
            chunk_ends.append(len(chunks))
            window_ends.append(len(windows))
    out = []
    for rows, ends, kind in ((chunks, chunk_ends, RUNS["chunks"]), (windows, window_ends, RUNS["windows"])):
        fields = kind.dataType.elementType.fields
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        flat = pa.StructArray.from_arrays([pa.array(c, pa.int64() if isinstance(f.dataType, T.LongType) else pa.int32()) for c, f in zip(columns, fields, strict=True)], [f.name for f in fields])
        out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
    return pa.StructArray.from_arrays(out, ["chunks", "windows"])


def cleaned_text(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without these runs of lines with a word, and the number of such lines and of words that went."""
    lines = text.split(b"\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    gone = bytearray(len(lines))
    for first, last in runs:
        a, b = full[first], full[last] + 1
        gone[a:b] = b"\1" * (b - a)
    words = [len(lines[i].split()) for i in full if gone[i]]
    return b"\n".join([x for x, g in zip(lines, gone, strict=True) if not g]), len(words), sum(words)


@once
@F.arrow_udf(CLEANED)
def clean(texts: pa.Array, runs: pa.Array) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]) if len(runs) else [0]
    flat = runs.flatten()
    first, last = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
    rows = []
    for k, t in enumerate(texts.cast(pa.binary())):
        a, b = int(ends[k]), int(ends[k + 1])
        rows.append((t.as_py(), 0, 0) if a == b else cleaned_text(t.as_py(), list(zip(first[a:b].tolist(), last[a:b].tolist(), strict=True))))
    text, lines, words = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(text, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(words, pa.int64())], ["text", "n_removed_lines", "n_removed_words"])


def _meet(rows: DataFrame, shared: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows joined to what is shared (keys, home, n: rows of that key); rows of a hot key are spread over as many keys as it takes."""
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(shared.drop("n")), keys, how)
    salts = F.ceil(F.col("n") / HOT)
    hot = smaller(written(shared.where(F.col("n") > HOT).select(*keys, salts.alias("salts")), "hot"))
    zero = F.lit(0).cast("bigint")
    spread = rows.join(hot, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("salts")), zero)).drop("salts")
    keyed = shared.select(*keys, "home", F.explode(F.sequence(zero, salts - 1)).alias("salt"))
    return spread.join(keyed, [*keys, "salt"], how).drop("salt")


def copied_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, runs array<struct<first, last>>) of documents that lose lines; lines with a word are counted from 0."""
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    posts = rows.select("doc_id", chunks_of("text").alias("c")).select("doc_id", F.explode("c").alias("c")).select("doc_id", "c.hash", "c.chunk")
    # the bytes are part of the key: chunks are equal only if these are; copies are combined before the shuffle
    equal = posts.groupBy("hash", "chunk").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("until"), F.count(F.lit(1)).alias("n"))
    alone = equal.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.min("home").alias("home"), F.max("until").alias("until"), F.sum("n").alias("n"))
    # where different bytes have one hash, windows decide
    shared = written(alone.where("texts = 1 and home < until").select("hash", "home", "n"), "shared-chunks")
    found = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), runs_of("text").alias("r")).select("doc_id", "text_hash", "r.chunks", "r.windows")
    found = written(found.where(F.size("windows") > 0), "line-runs")
    place = ["doc_id", "text_hash", "first", "last"]
    whole = _meet(found.select("doc_id", "text_hash", F.inline("chunks")), shared, ["hash"], "inner").where("doc_id > home").select(place)
    windows = found.select("doc_id", "text_hash", F.inline("windows"))
    inside = _meet(windows.where("hash is not null"), shared, ["hash"], "left").where("home is null or doc_id <= home")
    asked = windows.where("hash is null").select(*place, "a", "b").unionByName(inside.select(*place, "a", "b"))
    asked = written(asked, "line-windows")
    homes = asked.groupBy("a", "b").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("until"), F.count(F.lit(1)).alias("n"))
    homes = written(homes.where("home < until").drop("until"), "shared-windows")
    parts = _meet(asked, homes, ["a", "b"], "inner").where("doc_id > home").select(place)
    return whole.unionByName(parts).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def deduplicated(documents: DataFrame, prefix: str = "__lines_") -> DataFrame:
    """All columns of documents and, under prefix: text (cleaned), n_removed_lines, n_removed_words."""
    names = {c: f"{prefix}{c}" for c in ("doc_id", "text_hash", "runs")}
    found = copied_runs(documents.select("doc_id", "text")).withColumnsRenamed(names)
    same = (documents["doc_id"] == found[names["doc_id"]]) & (F.xxhash64(documents["text"]) == found[names["text_hash"]])
    out = documents.join(found, same, "left").withColumn(f"{prefix}out", clean("text", names["runs"])).drop(*names.values())
    parts = {f"{prefix}{c}": F.col(f"{prefix}out")[c] for c in CLEANED.names}
    return out.withColumns(parts).drop(f"{prefix}out")
