"""Importance resampling: documents drawn so that their words look like a target's.

A document's weight is the sum of its features' gains, an array by bucket that is
learnt from counts over all documents and all target texts.  Gumbel noise, seeded by
doc_id, turns the weights into scores, and the highest scores are a draw without replacement.

The draw is an external merge sort that stops early.  Each task writes its eligible rows as
a sorted run of fixed-size records into the shared folder.  Tournament trees merge
up to FAN_IN runs at a time into longer ones while there are more; none reads past the
draw.  Then the runs are cut at common keys, and a tree for each range of keys
merges its slices and numbers them: counts by range tell where each range's ranks
begin, ranges behind the last rank aren't opened, and the one that holds it ends there.

Defined results: a null text has no features; a null doc_id is the empty one in the noise's
seed and comes last among equal scores.  Rows of one score and doc_id are ranked by a hash of their
texts, and equal rows in any order, each with a rank of its own.  A text of any length is counted
whole.  Without eligible rows, or with an empty table, nobody is drawn; without a target all counts
of it are 0.  Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import text_batches
from .storage import dropped, fresh_path, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BUCKETS, SHORTEST, LONGEST, LEAST_WORDS, SEED = 10_000, 1, 1, 20, 2024
#: Records to a run at most, runs that a tree merges, records that it reads of a run at once, and records between fences.
RUN_RECORDS, FAN_IN, BLOCK, FENCE = 1 << 20, 64, 1 << 12, 1 << 10
#: Records that a range holds in the mean.
RANGE_RECORDS = 1 << 18

# A record sorts by its bytes: falling score, rising doc_id with null last, hash of the text, place; n_features and weight follow.
RECORD = np.dtype([("score", ">u8"), ("null", "u1"), ("doc_id", ">u8"), ("text", ">u8"), ("place", ">u8"), ("n_features", ">i8"), ("weight", ">i8")])
KEY, SIZE = 33, RECORD.itemsize
TOP = np.int64(np.iinfo(np.int64).min)


def features(text: bytes, shortest: int, longest: int) -> tuple[list[bytes], int]:
    """All runs of so many words, joined by a space, and the number of words."""
    words = WORD.findall(text.translate(LOWER))
    out = words if shortest == 1 else []
    for n in range(max(shortest, 2), longest + 1):
        out = out + [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
    return out, len(words)


def buckets_of(found: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % buckets


def bucket_counts(texts: DataFrame, text: str = "text", *, buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): features of all texts by bucket, added up within each task first."""

    def work(chunks):
        total = np.zeros(buckets, np.int64)
        for chunk in chunks:
            for _, some in text_batches(chunk.column(0)):
                found = [f for t in some for f in features(t, shortest, longest)[0]]
                total += np.bincount(buckets_of(found, buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    return texts.select(text).mapInArrow(work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: how much likelier it is in the target, in thousandths of a nat."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    one = lambda s, t: math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
    return np.array([one(float(s), float(t)) for s, t in zip(source, target, strict=True)], np.int64)


def noise(seed: int, doc_id: str) -> int:
    """Standard Gumbel noise in thousandths, from a seed and an id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint, text_hash bigint"


def scored(documents: DataFrame, by_bucket: np.ndarray, *, seed: int = SEED, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score and a hash of the text."""

    def work(chunks):
        for chunk in chunks:
            ids = chunk.column("doc_id").to_pylist()
            sizes = []
            for _, some in text_batches(chunk.column("text")):
                for t in some:
                    found, n_words = features(t, shortest, longest)
                    sizes.append((n_words, len(found), int(by_bucket[buckets_of(found, len(by_bucket))].sum())))
            n_words, n_features, weights = (np.array(x, np.int64) for x in zip(*sizes, strict=True)) if sizes else (np.zeros(0, np.int64),) * 3
            added = np.array([noise(seed, "" if d is None else str(d)) for d in ids], np.int64)
            columns = [pa.array(ids, pa.int64()), *map(pa.array, (n_words, n_features, weights, weights + added)), chunk.column("text_hash")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score", "text_hash"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(work, SCORED)


def packed(chunk: pa.RecordBatch) -> np.ndarray:
    """Rows as records, unsorted."""
    out = np.zeros(chunk.num_rows, RECORD)
    lifted = lambda c: (c.to_numpy(zero_copy_only=False).astype(np.int64) ^ TOP).view(np.uint64)
    ids = chunk.column("doc_id")
    out["score"] = ~lifted(chunk.column("score"))
    out["null"] = ids.is_null().to_numpy(zero_copy_only=False)
    out["doc_id"] = lifted(ids.fill_null(0))
    out["text"] = lifted(chunk.column("text_hash"))
    for name in ("place", "n_features", "weight"):
        out[name] = chunk.column(name).to_numpy()
    return out


def rows_of(records: np.ndarray) -> dict[str, pa.Array]:
    """Columns of records."""
    r = records.view(RECORD)
    back = lambda x: x.astype(np.uint64).view(np.int64) ^ TOP
    return {
        "doc_id": pa.array(back(r["doc_id"]), pa.int64(), mask=r["null"].astype(bool)),
        "n_features": pa.array(r["n_features"].astype(np.int64)),
        "weight": pa.array(r["weight"].astype(np.int64)),
        "score": pa.array(back(~r["score"].astype(np.uint64))),
        "text_hash": pa.array(back(r["text"])),
        "place": pa.array(r["place"].astype(np.int64)),
    }


def flat(records: np.ndarray) -> np.ndarray:
    """Records as byte strings, which compare as they sort."""
    return np.ascontiguousarray(records).view(f"S{SIZE}").reshape(-1)


class Slice:
    """Records from `start` to `end` of a run, read a block at a time."""

    def __init__(self, path: str, start: int, end: int):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        self.file.seek(start * SIZE)
        self.left, self.at, self.block = end - start, 0, np.zeros(0, f"S{SIZE}")
        self.more()

    def more(self) -> None:
        """The next block, empty at the end."""
        n = min(BLOCK, self.left)
        self.left -= n
        self.block, self.at = np.frombuffer(self.file.read(n * SIZE), f"S{SIZE}"), 0
        if not n:
            self.file.close()

    @property
    def head(self) -> bytes | None:
        return self.block[self.at] if self.at < len(self.block) else None

    def until(self, bound: bytes | None) -> np.ndarray:
        """What this block holds up to a key that another slice has, taken off."""
        to = len(self.block) if bound is None else max(self.at + 1, int(np.searchsorted(self.block, bound)))
        out, self.at = self.block[self.at : to], to
        if to == len(self.block):
            self.more()
        return out


class Tournament:
    """A tree of losers over slices: the winner is the slice with the least head."""

    def __init__(self, slices: list[Slice]):
        self.slices, self.n = slices, len(slices)
        self.losers = [0] * self.n
        won = [0] * self.n + list(range(self.n))
        for node in range(self.n - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (a, b) if self.beats(a, b) else (b, a)
        self.winner = won[1] if self.n > 1 else 0

    def beats(self, a: int, b: int) -> bool:
        x, y = self.slices[a].head, self.slices[b].head
        return x is not None and (y is None or x <= y)

    def replayed(self) -> None:
        """The winner's head has changed: matches on its way to the root are played again."""
        at, node = self.winner, (self.winner + self.n) // 2
        while node:
            if self.beats(self.losers[node], at):
                self.losers[node], at = at, self.losers[node]
            node //= 2
        self.winner = at

    def runner_up(self) -> bytes | None:
        """The least head of the others: the winner has beaten it on its way."""
        heads, node = [], (self.winner + self.n) // 2
        while node:
            heads.append(self.slices[self.losers[node]].head)
            node //= 2
        return min((h for h in heads if h is not None), default=None)

    def merged(self, most: int) -> Iterator[np.ndarray]:
        """Records of all slices in order, `most` of them at most."""
        while most > 0 and self.slices[self.winner].head is not None:
            some = self.slices[self.winner].until(self.runner_up())[:most]
            most -= len(some)
            yield some
            self.replayed()


def gathered(pieces: Iterator[np.ndarray], n: int) -> Iterator[np.ndarray]:
    """Pieces put together to blocks of n records or a little more."""
    held, size = [], 0
    for p in pieces:
        held.append(p)
        size += len(p)
        if size >= n:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


RUNS = "path string, n bigint, fences array<binary>"


class RunWriter:
    """One run in the shared folder, its own for each attempt of a task; only a manifest that Spark commits makes it count."""

    def __init__(self, folder: str, number: int):
        task = TaskContext.get()
        self.path = f"{folder}/run-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.bin"
        fs, name = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        self.file, self.n, self.fences = fs.open_output_stream(name), 0, []

    def add(self, records: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(records).tobytes())
        first = -self.n % FENCE
        self.fences += [bytes(r).ljust(SIZE, b"\0")[:KEY] for r in records[first::FENCE]]
        self.n += len(records)

    def closed(self) -> pa.RecordBatch:
        self.file.close()
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([self.n], pa.int64()), pa.array([self.fences], pa.list_(pa.binary()))], names=["path", "n", "fences"])


def sorted_runs(rows: DataFrame, folder: str, most: int) -> DataFrame:
    """Write the rows of each task as sorted runs, each cut after `most` records; returns (path, n, fences)."""

    def work(chunks):
        held, size, number = [], 0, 0

        def close():
            run = RunWriter(folder, number)
            run.add(np.sort(np.concatenate(held))[:most])  # of byte strings: joined structures lose their byte order
            return run.closed()

        for chunk in chunks:
            if chunk.num_rows:
                held.append(flat(packed(chunk)))
                size += chunk.num_rows
            if size >= RUN_RECORDS:
                yield close()
                held, size, number = [], 0, number + 1
        if size:
            yield close()

    return written(rows.mapInArrow(work, RUNS), "runs")


def merged_runs(runs: DataFrame, folder: str, most: int) -> DataFrame:
    """Runs merged FAN_IN at a time, each result cut after `most` records."""

    def work(chunks):
        for chunk in chunks:
            for number, group in enumerate(chunk.column("runs").to_pylist()):
                out = RunWriter(folder, number)
                tree = Tournament([Slice(r["path"], 0, r["n"]) for r in group])
                for some in gathered(tree.merged(most), BLOCK):
                    out.add(some)
                yield out.closed()

    # as many groups as it takes: a hash of the path deals runs out, groups that come out too large are cut
    n = math.ceil(2 * runs.count() / FAN_IN)
    lists = runs.select(F.pmod(F.xxhash64("path"), F.lit(n)).alias("g"), F.struct("path", "n").alias("r")).groupBy("g").agg(F.sort_array(F.collect_list("r")).alias("r"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.size("r") - 1) / FAN_IN).cast("int")))
    cut = lists.select("r", at.alias("at")).select(F.slice("r", F.col("at") * FAN_IN + 1, F.lit(FAN_IN)).alias("runs"))
    return written(cut.repartition(n).mapInArrow(work, RUNS), "runs")


def range_ends(runs: DataFrame, eligible: int) -> list[bytes]:
    """Keys that cut all records into ranges of about RANGE_RECORDS: every FENCE-th record of each run, dealt by Spark's own range partitioner.

    One key a range comes to the driver: 33 bytes for a quarter of a million documents.
    """
    ranges = math.ceil(eligible / RANGE_RECORDS)
    if ranges < 2:
        return []
    fences = runs.select(F.explode("fences").alias("key")).repartitionByRange(ranges, "key")
    firsts = fences.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    return sorted(bytes(r.key) for r in firsts.collect())[1:]


def sliced(runs: DataFrame, ends: list[bytes]) -> DataFrame:
    """(range, path, start, end): where each range lies in each run, found by halving."""

    def work(chunks):
        for chunk in chunks:
            for path, n in zip(chunk.column("path").to_pylist(), chunk.column("n").to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:

                    def place(key: bytes, low: int) -> int:
                        high = n
                        while low < high:
                            mid = (low + high) // 2
                            f.seek(mid * SIZE)
                            low, high = (mid + 1, high) if f.read(KEY) < key else (low, mid)
                        return low

                    cuts = [0]
                    for key in ends:
                        cuts.append(place(key, cuts[-1]))
                starts, stops = np.array(cuts), np.array([*cuts[1:], n])
                there = np.flatnonzero(stops > starts)
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([path] * len(there), pa.string()), pa.array(starts[there], pa.int64()), pa.array(stops[there], pa.int64())], names=["range", "path", "start", "end"])

    return written(runs.select("path", "n").mapInArrow(work, "range int, path string, start bigint, end bigint"), "slices")


DRAWN = "doc_id bigint, n_features bigint, weight bigint, score bigint, text_hash bigint, place bigint, rank bigint"


def ranked(slices: DataFrame, most: int) -> DataFrame:
    """The first `most` records of all slices with their ranks: a tree for each range that reaches into the draw."""
    before, firsts = 0, []  # a number for each range, as many as keys in range_ends
    for r in slices.groupBy("range").agg(F.sum(F.col("end") - F.col("start")).alias("n")).orderBy("range").collect():
        if before >= most:
            break
        firsts.append((r["range"], before))
        before += r.n
    spark = slices.sparkSession
    firsts = spark.createDataFrame(firsts, "range int, first bigint")
    lists = slices.join(F.broadcast(firsts), "range").groupBy("range", "first").agg(F.sort_array(F.collect_list(F.struct("path", "start", "end"))).alias("slices"))

    def work(chunks):
        for chunk in chunks:
            for first, group in zip(chunk.column("first").to_pylist(), chunk.column("slices").to_pylist(), strict=True):
                tree = Tournament([Slice(s["path"], s["start"], s["end"]) for s in group])
                for some in gathered(tree.merged(most - first), BLOCK):
                    columns = rows_of(some) | {"rank": pa.array(np.arange(first + 1, first + 1 + len(some)))}
                    first += len(some)
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return lists.select("first", "slices").repartition(max(1, firsts.count())).mapInArrow(work, DRAWN)


def drawn(rows: DataFrame, most: int) -> DataFrame:
    """Of (doc_id, n_features, weight, score, text_hash, place), places being unique: the `most` highest scores, ranked."""
    spark: SparkSession = rows.sparkSession
    folder = fresh_path(spark, "draw")
    runs = sorted_runs(rows.select("doc_id", "n_features", "weight", "score", "text_hash", "place"), folder, most)
    while (n := runs.count()) > FAN_IN:
        longer = merged_runs(runs, f"{folder}/{n}", most)
        dropped(spark, runs)
        runs = longer
    held = runs.agg(F.sum("n")).first()[0] or 0
    return written(ranked(sliced(runs, range_ends(runs, held)), most), "drawn")


def behind(last) -> F.Column:
    """Whether a row comes after another by score, doc_id, hash and place."""
    after = F.col("place") > last.place
    after = (F.col("text_hash") > last.text_hash) | ((F.col("text_hash") == last.text_hash) & after)
    same = F.col("doc_id").eqNullSafe(F.lit(last.doc_id).cast("bigint"))
    greater = F.lit(False) if last.doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") > last.doc_id)
    after = greater | (same & after)
    return (F.col("score") < last.score) | ((F.col("score") == last.score) & after)


def counts_array(counts: DataFrame, buckets: int) -> np.ndarray:
    """A number for each bucket, whatever the corpus."""
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():
        out[r.bucket] = r.n
    return out


def resampled(
    documents: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, shortest: int = SHORTEST, longest: int = LONGEST
) -> DataFrame:
    """Every row of documents (doc_id, text): doc_id, n_features, weight, score, and rank of those drawn.

    Drawn are `percent` of 100 of the documents with `least_words` words or more.
    """
    size = {"buckets": buckets, "shortest": shortest, "longest": longest}
    by_bucket = gains(counts_array(bucket_counts(documents, **size), buckets), counts_array(bucket_counts(target, **size), buckets))
    # places are kept with the rows, so that no later reading numbers them anew
    rows = written(scored(documents, by_bucket, seed=seed, shortest=shortest, longest=longest).withColumn("place", F.monotonically_increasing_id()), "scored")
    eligible = F.col("n_words") >= least_words
    most = percent * rows.where(eligible).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    if not most:
        return rest
    first = drawn(rows.where(eligible), most)
    last = first.where(F.col("rank") == most).first()
    rest = rows.where(~eligible | behind(last)).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return first.select(*columns, "rank").unionByName(rest)
