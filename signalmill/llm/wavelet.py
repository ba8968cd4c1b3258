"""Token-id files: a wavelet matrix for each shard of documents.

A shard holds the ids of consecutive documents, each closed by an end id.  Its
file keeps one bit plane per bit of an id, most significant first; after each
plane the ids are dealt stably into those with bit 0 and then those with bit 1.
With a count of ones per block of a plane, rank takes one popcount within a
block and select a binary search, so single ids, counts of an id and its
occurrences are found without expanding the shard.

File, little-endian:
    8 bytes   magic "SMWVM02\\n"
    u32 x 5   ids per shard, documents, planes, ids per rank block, bytes per piece of a plane
    u32 each  lengths of the zstd frames that follow
    frames    document ids (i64, and a byte each for null); document ends (u32,
              exclusive); the number of zeros of each plane (u32); per plane its
              block counts (u32, ones before each block); then per plane its bits
              (packed, first bit highest), a frame for each piece
A question to an open file reads, of each plane, the counts and the pieces that hold
the blocks it needs.

Defined results: a null text is encoded as an empty one (the end id alone);
null doc_ids come first; rows with equal doc_id follow by text; a text of any
length lies whole in one shard, which it closes if it takes it to its size; an empty
table gives no files and no rows; columns but doc_id and text are not read.
"""

from __future__ import annotations

import io
import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import vocabulary_file
from .hashing import hasher, text_batches
from .parts import PartMemo, split_stops
from .storage import fresh_path, worker_state

MAGIC = b"SMWVM02\n"
BLOCK = 4096
#: Bytes of a plane to a frame, a multiple of a block's.
PIECE = 1 << 14
HEADER = "<5I"
#: A shard is closed with the document that takes it to this many ids.
SHARD_IDS = 1 << 21


class WaveletMatrix:
    """Bit planes over ids below 2**planes."""

    def __init__(self, n: int, zeros: np.ndarray, planes: list[np.ndarray], counts: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.counts = n, zeros, planes, counts

    @classmethod
    def of(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        n = len(ids)
        zeros, planes, counts = np.zeros(width, np.uint32), [], []
        v, dealt = ids.copy(), np.empty_like(ids)
        for level in range(width):
            ones = (v & ids.dtype.type(1 << (width - 1 - level))) != 0
            low, high = np.flatnonzero(~ones), np.flatnonzero(ones)
            zeros[level] = len(low)
            planes.append(np.packbits(ones))
            sums = np.add.reduceat(ones, np.arange(0, n, BLOCK), dtype=np.uint32) if n else np.zeros(0, np.uint32)
            counts.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(sums, dtype=np.uint32)]))
            np.take(v, low, out=dealt[: len(low)], mode="clip")
            np.take(v, high, out=dealt[len(low) :], mode="clip")
            v, dealt = dealt, v
        return cls(n, zeros, planes, counts)

    def ids(self) -> np.ndarray:
        """All ids in order, from the last plane up."""
        width = len(self.planes)
        v = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        dealt = np.empty_like(v)
        for level in range(width - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            z = int(self.zeros[level])
            v[z:] |= v.dtype.type(1 << (width - 1 - level))
            dealt[np.flatnonzero(~ones)] = v[:z]
            dealt[np.flatnonzero(ones)] = v[z:]
            v, dealt = dealt, v
        return v

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        b = i // BLOCK
        at = b * BLOCK
        part = self.planes[level][at >> 3 : (i + 7) >> 3]
        return int(self.counts[level][b]) + int(np.unpackbits(part, count=i - at).sum() if i > at else 0)

    def select(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        ends = np.minimum(np.arange(len(self.counts[level]), dtype=np.int64) * BLOCK, self.n)
        before = self.counts[level].astype(np.int64) if one else ends - self.counts[level]
        b = int(np.searchsorted(before, k, side="right")) - 1
        at = b * BLOCK
        bits = np.unpackbits(self.planes[level][at >> 3 : (min(at + BLOCK, self.n) + 7) >> 3], count=min(BLOCK, self.n - at))
        return at + int(np.flatnonzero(bits == one)[k - int(before[b])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(len(self.planes)):
            one = self.bit(level, i)
            r = self.rank1(level, i)
            i = int(self.zeros[level]) + r if one else i - r
            out = out << 1 | one
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        width = len(self.planes)
        if token < 0 or token >> width:
            return 0, 0
        for level in range(width):
            a, b = self.rank1(level, start), self.rank1(level, end)
            if token >> (width - 1 - level) & 1:
                start, end = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id stands in [start, end)."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - level) & 1
            i = self.select(level, i - int(self.zeros[level]) if one else i, bool(one))
        return i


def packed(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, width: int) -> bytes:
    """The file of one shard."""
    m = WaveletMatrix.of(ids, width)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    parts = [names, np.asarray(ends, "<u4").tobytes(), m.zeros.astype("<u4").tobytes()]
    parts += [counts.astype("<u4").tobytes() for counts in m.counts]
    parts += [plane[at : at + PIECE].tobytes() for plane in m.planes for at in range(0, len(plane), PIECE)]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    frames = [squeeze(p) for p in parts]
    return MAGIC + struct.pack(HEADER, m.n, len(doc_ids), width, BLOCK, PIECE) + np.array([len(f) for f in frames], "<u4").tobytes() + b"".join(frames)


class _Lazy:
    """A sequence whose items are made when they are asked for, and kept."""

    def __init__(self, n: int, make):
        self.n, self.make, self.known = n, make, {}

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int):
        if not 0 <= i < self.n:
            raise IndexError(i)
        if i not in self.known:
            self.known[i] = self.make(i)
        return self.known[i]


class _Plane:
    """The bytes of one plane, of which only pieces asked for are read."""

    def __init__(self, pieces: _Lazy, size: int):
        self.pieces, self.size = pieces, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if not isinstance(at, slice):
            return self.pieces[at // PIECE][at % PIECE]
        start, stop, _ = at.indices(self.size)
        if start >= stop:
            return np.zeros(0, np.uint8)
        first = start // PIECE
        parts = [self.pieces[k] for k in range(first, (stop - 1) // PIECE + 1)]
        whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return whole[start - first * PIECE : stop - first * PIECE]


class ShardFile(WaveletMatrix):
    """An open file (anything with read, seek and close), which answers without being expanded."""

    def __init__(self, file):
        self.file = file
        head = file.read(len(MAGIC) + struct.calcsize(HEADER))
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token-id file")
        n, self.docs, width, block, piece = struct.unpack_from(HEADER, head, len(MAGIC))
        if (block, piece) != (BLOCK, PIECE):
            raise ValueError(f"rank blocks of {block} ids in pieces of {piece} bytes")
        size = (n + 7) // 8
        per = -(-size // PIECE)
        sizes = np.frombuffer(file.read(4 * (3 + width + width * per)), "<u4").astype(np.int64)
        self._at = len(head) + 4 * len(sizes) + np.concatenate([[0], np.cumsum(sizes)])
        self._expand = zstandard.ZstdDecompressor().decompress
        self._pieces = width, size, per
        planes = _Lazy(width, lambda level: _Plane(_Lazy(per, lambda k: np.frombuffer(self._frame(3 + width + level * per + k), np.uint8)), size))
        super().__init__(n, np.frombuffer(self._frame(2), "<u4"), planes, _Lazy(width, lambda level: np.frombuffer(self._frame(3 + level), "<u4")))

    def _frame(self, k: int) -> bytes:
        self.file.seek(int(self._at[k]))
        return self._expand(self.file.read(int(self._at[k + 1] - self._at[k])))

    def ids(self) -> np.ndarray:
        """All ids in order; planes are read one at a time and let go."""
        width, size, per = self._pieces
        whole = _Lazy(width, lambda level: _Plane(_Lazy(per, lambda k: np.frombuffer(self._frame(3 + width + level * per + k), np.uint8)), size)[:])
        whole.known = _Forgetful()
        return WaveletMatrix(self.n, self.zeros, whole, self.counts).ids()

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_ids, and where documents end."""
        raw = self._frame(0)
        names, nulls = np.frombuffer(raw, "<i8", self.docs), raw[8 * self.docs :]
        return [None if gone else int(d) for d, gone in zip(names, nulls, strict=True)], np.frombuffer(self._frame(1), "<u4")

    def __enter__(self) -> ShardFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


class _Forgetful(dict):
    """Keeps the last item only."""

    def __setitem__(self, key, value) -> None:
        self.clear()
        super().__setitem__(key, value)


def opened(path: str) -> ShardFile:
    """A file of the manifest, to be asked for single ids, counts and occurrences."""
    fs, name = pafs.FileSystem.from_uri(path)
    return ShardFile(fs.open_input_file(name))


def unpacked(content: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """Matrix, doc_ids and document ends of a file's bytes."""
    shard = ShardFile(io.BytesIO(content))
    return shard, *shard.documents()


class WordEncoder:
    """Ids of whole texts by the tokenizers library, asked once for each distinct word.

    The vocabulary's normaliser drops white space and its pre-tokenizer puts symbols that
    follow a letter or digit in a pre-token of their own.  So the ids of a text are
    those of its parts in a row: runs between ASCII white space, less the run of symbols
    that may end them, and that run.  Parts are told apart by 64-bit hashes, for
    whole batches at once.
    """

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and a pool of threads its own heaps
        self.library = Tokenizer.from_buffer(content)
        self.library.no_padding()
        self.library.no_truncation()
        self.width = max(1, (self.library.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.kind = np.dtype("<u2" if self.width <= 16 else "<u4")
        self.closing = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(self.library.get_vocab_size(with_added_tokens=True))])
        self.memo = PartMemo(self.kind, self._learn)

    def _learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of letters alone are asked in sentences, whose ids tell where words close."""
        words = [p.decode() for p in parts]
        sizes, offsets = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flat, used = [], 0
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        rest = [i for i, w in enumerate(words) if not w.isalpha()]
        asked = [plain[at : at + 500] for at in range(0, len(plain), 500)]
        for some, e in zip(asked, self.library.encode_batch_fast([" ".join(words[i] for i in some) for some in asked], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            ends = np.concatenate([[0], np.flatnonzero(self.closing[ids]) + 1])
            if len(ends) == len(some) + 1 and ends[-1] == len(ids):
                offsets[some], sizes[some] = used + ends[:-1], np.diff(ends)
                flat.append(ids)
                used += len(ids)
            else:
                rest += some
        for at in range(0, len(rest), 1000):
            some = rest[at : at + 1000]
            for i, e in zip(some, self.library.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                ids = e.ids
                offsets[i], sizes[i] = used, len(ids)
                flat.append(np.array(ids, self.kind))
                used += len(ids)
        return np.concatenate(flat), offsets, sizes

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each closed by end_id, and the number of ids of each."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        gaps = hasher().spaces[data]
        before = np.empty_like(gaps)
        before[0], before[1:] = True, gaps[:-1]
        starts, ends = split_stops(data, np.flatnonzero(before & ~gaps), np.flatnonzero(gaps & ~before))
        at = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        if not len(starts):
            return np.full(len(texts), end_id, self.kind), np.ones(len(texts), np.int64)
        ids, placed = self.memo.ids(data, starts, ends)
        placed = np.concatenate([[0], placed])[at]
        return np.insert(ids, placed[1:], end_id), np.diff(placed) + 1


def encoder_of(shared) -> WordEncoder:
    state = worker_state().setdefault("words", {})
    content = shared.value
    key = (len(content), hash(content))
    if key not in state:
        state.clear()
        state[key] = WordEncoder(content)
    return state[key]


def put(path: str, content: bytes) -> None:
    """Write a file. Its name is no other attempt's, and only files that a finished task lists in the manifest count."""
    fs, name = pafs.FileSystem.from_uri(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name) as f:
        f.write(content)


MANIFEST = "part int, shard int, path string, n_docs bigint, n_ids bigint"


def write_shards(documents: DataFrame, tokenizer: str, folder: str, *, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of all documents in ascending doc_id as files in folder; returns their manifest.

    Documents are dealt by ranges of doc_id, so a task holds one range and one
    open shard at a time.  Each attempt of a task writes files of its own; the manifest,
    which Spark commits, names those of the attempts that finished.
    """
    spark = documents.sparkSession
    shared = vocabulary_file(spark, tokenizer)

    def work(chunks):
        encoder = encoder_of(shared)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        names: list[int | None] = []
        encoded: list[np.ndarray] = []
        size = shard = 0

        def close():
            ids = np.concatenate(encoded)
            ends = np.cumsum([len(e) for e in encoded])
            path = f"{folder}/shard-{part:06d}-{shard:05d}-{attempt}.wvm"
            put(path, packed(ids, names, ends, encoder.width))
            return {"part": part, "shard": shard, "path": path, "n_docs": len(names), "n_ids": len(ids)}

        for chunk in chunks:
            doc_ids = chunk.column("doc_id").to_pylist()
            for first, texts in text_batches(chunk.column("text")):
                ids, sizes = encoder.encode(texts, end_id)
                for d, n, e in zip(doc_ids[first:], sizes.tolist(), np.split(ids, np.cumsum(sizes)[:-1])):
                    names.append(d)
                    encoded.append(e)
                    size += n
                    if size >= shard_ids:
                        yield pa.RecordBatch.from_pylist([close()], schema=manifest)
                        names, encoded, size, shard = [], [], 0, shard + 1
        if names:
            yield pa.RecordBatch.from_pylist([close()], schema=manifest)

    manifest = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    # rows of one id, or of none, are ranges of their own by how their texts begin, which agrees with the order
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id", F.substring("text", 1, 64))
    rows.sortWithinPartitions("doc_id", "text").mapInArrow(work, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids (binary, 32-bit little-endian).

    start needs a running sum over one small row per shard.
    """
    order = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    tasks = max(1, manifest.count())  # one for each file

    def work(chunks):
        for chunk in chunks:
            for path, base in zip(chunk.column("path").to_pylist(), chunk.column("base").to_pylist(), strict=True):
                with opened(path) as shard:
                    doc_ids, ends = shard.documents()
                    ids = shard.ids().astype("<u4").tobytes()
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1].astype(np.int64)])
                for at in range(0, len(doc_ids), 1024):
                    to = min(at + 1024, len(doc_ids))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids[at:to], pa.int64()),
                            pa.array(starts[at:to] + base),
                            pa.array(ends[at:to] - starts[at:to], pa.int64()),
                            pa.array([ids[4 * s : 4 * e] for s, e in zip(starts[at:to], ends[at:to], strict=True)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return based.repartition(tasks).mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_counts(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n_docs, n) over all files: how many documents hold a token, and how often it stands in all.

    Documents are found by the token's occurrences: the first, and then the first after each document that holds it.
    """
    wanted = sorted(set(tokens))

    def holding(shard: ShardFile, ends: np.ndarray, token: int, n: int) -> int:
        docs = k = 0
        while k < n:
            docs += 1
            k = shard.count(token, 0, int(ends[np.searchsorted(ends, shard.occurrence(token, k), side="right")]))
        return docs

    def work(chunks):
        for chunk in chunks:
            for path in chunk.column("path").to_pylist():
                with opened(path) as shard:
                    ends = shard.documents()[1]
                    n = [shard.count(t) for t in wanted]
                    docs = [holding(shard, ends, t, c) for t, c in zip(wanted, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(docs, pa.int64()), pa.array(n, pa.int64())], names=["token", "n_docs", "n"])

    found = manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(work, "token bigint, n_docs bigint, n bigint")
    return found.groupBy("token").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def store(documents: DataFrame, tokenizer: str, *, end_id: int, folder: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the files, by default in a fresh shared folder, and read them back."""
    spark: SparkSession = documents.sparkSession
    return read_shards(write_shards(documents, tokenizer, folder or fresh_path(spark, "token-ids"), end_id=end_id, shard_ids=shard_ids))
