"""Byte-level BPE: encoding by a queue of merge ranks, decoding by the vocabulary.

A pre-token is a doubly linked list of symbols.  A heap holds (rank, position)
of adjacent pairs; a popped entry whose pair has changed meanwhile is stale and
skipped.  Texts are cut at white space before a non-space, where no pre-token
crosses, and ids per part are kept in a bounded memo.

Defined results: a null text is encoded as an empty one, which has no ids and
decodes to ''; any text round-trips, as every byte has a symbol, and is encoded whole,
whatever its length; rows are encoded one by one, whatever ids repeat; extra columns
come along, and names under the prefix are the result's; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import batches, hasher, text_batches
from .parts import PartMemo, split_stops
from .storage import worker_state

#: Text parts that a worker remembers.
MEMO = 800_000

#: The pre-token pattern of byte-level BPE, with white space as Unicode has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: A part that is one pre-token at sight.
LETTERS = re.compile(rb" ?[A-Za-z]+")
#: Bytes that begin no white space; those of U+0085, U+00A0, U+1680, U+20xx and U+3000 might.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BytePairCodec:
    """Encoder and decoder of one vocabulary file's content."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocabulary = spec["model"]["vocab"]
        letters = byte_letters()
        bytes_of = {c: b for b, c in letters.items()}
        self.first = [vocabulary[letters[b]] for b in range(256)]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocabulary[a] << 32 | vocabulary[b]] = rank
            self.merged.append(vocabulary[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: bytes(bytes_of[c] for c in t) for t, i in vocabulary.items()}
        self.strings |= {i: t.encode() for t, i in self.added.items()}
        strings = [self.strings.get(i, b"") for i in range(1 + max(self.strings))]
        self.letters = np.frombuffer(b"".join(strings), np.uint8)
        self.lengths = np.array([len(t) for t in strings], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.pretokens = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.marks = [t.encode() for t in self.added]
        self.memo = PartMemo(np.dtype(np.int32), self._learn, MEMO)

    def merge(self, data: bytes) -> list[int]:
        """Symbols of one pre-token."""
        symbols = [self.first[b] for b in data]
        n = len(symbols)
        if n == 1:
            return symbols
        rank_of, merged = self.ranks.get, self.merged
        bits = n.bit_length()
        mask = (1 << bits) - 1
        # an entry is a rank over the position of the pair's left symbol
        queue = [r << bits | i for i in range(n - 1) if (r := rank_of(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heapq.heappop(queue)
            i, rank = entry & mask, entry >> bits
            j = after[i]
            if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != rank:
                continue  # stale
            new = merged[rank]
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << 32 | symbols[k])) is not None:
                    heapq.heappush(queue, r << bits | i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbols[h] << 32 | new)) is not None:
                heapq.heappush(queue, r << bits | h)
        return [s for s in symbols if s >= 0]

    def _learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out, ends = array("i"), [0]
        for p in parts:
            if LETTERS.fullmatch(p):
                out.extend(self.merge(p))
            else:
                for t in self.pretokens.findall(p.decode()):
                    out.extend(self.merge(t.encode()))
            ends.append(len(out))
        at = np.array(ends, np.int64)
        return np.array(out, np.int32), at[:-1], np.diff(at)

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without added tokens, in a row, and the number of ids of each.

        A single white-space byte before a non-space begins a part; unless it is a space,
        it is one by itself.  Bytes that may begin other white space are not relied on.
        """
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        limits = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = hasher().spaces[data]
        cuts[:-1] &= SOLID[data[1:]]
        cuts[limits[1:] - 1] = False
        alone = np.flatnonzero(cuts & (data != 32)) + 1
        cuts[alone] = True
        cuts[limits[:-1]] = True
        cuts[limits[1:] - 1] = True  # the newlines between texts, which are left out
        bounds = np.flatnonzero(cuts)
        starts, ends = bounds, np.append(bounds[1:], len(data))
        inside = np.ones(len(starts), bool)
        inside[np.searchsorted(starts, limits[1:] - 1)] = False
        starts, ends = split_stops(data, starts[inside], ends[inside])
        at = np.searchsorted(starts, limits)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        ids, placed = self.memo.ids(data, starts, ends)
        return ids, np.diff(np.concatenate([[0], placed])[at])

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of one text, added tokens in it included."""
        out = []
        for k, part in enumerate(self.specials.split(text.decode()) if self.specials else [text.decode()]):
            out.append(np.array([self.added[part]], np.int32) if k % 2 else self.encode_batch([part.encode()])[0])
        return np.concatenate(out)

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each."""
        flat, sizes = [], []
        for _, part in batches(texts):
            if any(m in t for t in part for m in self.marks):
                found = [self.encode(t) for t in part]
                flat += found
                sizes.append(np.array([len(f) for f in found], np.int64))
            else:
                ids, n = self.encode_batch(part)
                flat.append(ids)
                sizes.append(n)
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids[:ends[0]], ids[ends[0]:ends[1]] and so on."""
        out: list[str] = []
        first = 0
        for k in range(0, len(ends), 256):
            some = ends[k : k + 256]
            part = ids[first : some[-1]]
            sizes = self.lengths[part]
            placed = np.cumsum(sizes)
            at = np.repeat(self.offsets[part] - placed + sizes, sizes)
            at += np.arange(len(at))
            raw = self.letters[at].tobytes()
            cuts = np.concatenate([[0], placed])[np.concatenate([[first], some]) - first].tolist()
            out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
            first = some[-1]
        return out


def vocabulary_file(spark: SparkSession, path: str):
    """A broadcast of the file's bytes: a vocabulary has a fixed size of a few MB, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def codec_of(shared) -> BytePairCodec:
    """This worker's codec of a broadcast vocabulary, made once."""
    state = worker_state().setdefault("bpe", {})
    content = shared.value
    key = (len(content), hash(content))
    if key not in state:
        state.clear()
        state[key] = BytePairCodec(content)
    return state[key]


def encoder(spark: SparkSession, path: str):
    """A function of a text column: its ids, array<int>."""
    shared = vocabulary_file(spark, path)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        codec = codec_of(shared)
        parts = [codec.encode_all(part) for _, part in text_batches(texts)]
        ids, sizes = (np.concatenate([np.zeros(0, np.int64 if k else np.int32), *[p[k] for p in parts]]) for k in (0, 1))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))

    return encode


def decoder(spark: SparkSession, path: str):
    """A function of an array<int> column: the text; null for null."""
    shared = vocabulary_file(spark, path)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out = codec_of(shared).decode_all(ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths))
        return pa.array(out, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))

    return decode


def round_trip(documents: DataFrame, path: str, prefix: str = "__bpe_") -> DataFrame:
    """All columns of documents and, under prefix: ids and decoded."""
    spark = documents.sparkSession
    out = documents.withColumn(f"{prefix}ids", encoder(spark, path)("text"))
    return out.withColumn(f"{prefix}decoded", decoder(spark, path)(f"{prefix}ids"))
