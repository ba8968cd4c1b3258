"""Vectorised hashes of words, word shingles and lines over batches of texts."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

from .storage import trimmed, worker_state

#: Bytes of text that are hashed at once; a longer text is a batch of its own, hashed in pieces of this size.
BATCH_BYTES = 1 << 18
#: Words of more bytes are told by a digest: sums modulo 2**64 are equal for some pairs of long words, whatever the base.
LONG_WORD = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n well-spread 64-bit words that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


class TextHasher:
    """Polynomial hashes modulo 2**64 of byte spans, by prefix sums; digests of long words."""

    BASE = 0xD6E8FEB86659FD93
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self):
        self.letters = stream(7, 256)
        self.spaces = np.zeros(256, bool)
        self.spaces[[9, 10, 11, 12, 13, 32]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        powers = [np.full(2 * BATCH_BYTES + 1, base, np.uint64) for base in (self.BASE, self.INVERSE)]
        for p in powers:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
        self.powers, self.inverses = powers

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], for non-empty spans in ascending order; memory follows BATCH_BYTES, not data."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            first = int(starts[i])
            if int(ends[i]) - first > BATCH_BYTES:
                out[i] = self._long(data, first, int(ends[i]))
                i += 1
                continue
            j = i + int(np.searchsorted(ends[i:], first + 2 * BATCH_BYTES, side="right"))
            last = int(ends[j - 1])
            sums = np.empty(last - first + 1, np.uint64)
            sums[0] = 0
            np.cumsum(self.letters[data[first:last]] * self.powers[: last - first], out=sums[1:])
            a, b = starts[i:j] - first, ends[i:j] - first
            out[i:j] = (sums[b] - sums[a]) * self.inverses[a] + (b - a).astype(np.uint64)
            i = j
        return mixed(out)

    def _long(self, data: np.ndarray, start: int, end: int) -> np.uint64:
        """What one span adds up to, piece by piece."""
        total, factor = 0, 1
        for at in range(start, end, BATCH_BYTES):
            piece = data[at : min(at + BATCH_BYTES, end)]
            total += int((self.letters[piece] * self.powers[: len(piece)]).sum(dtype=np.uint64)) * factor
            factor = factor * pow(self.BASE, len(piece), 1 << 64) % (1 << 64)
        return np.uint64((total + end - start) % (1 << 64))

    def words(self, texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's words begin (one entry more than texts).

        Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; fold lower-cases A-Z.
        """
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if fold:
            data = self.lower[data]
        gaps = self.spaces[data]
        before = np.empty_like(gaps)
        before[0], before[1:] = True, gaps[:-1]
        starts, ends = np.flatnonzero(before & ~gaps), np.flatnonzero(gaps & ~before)
        limits = np.cumsum([0] + [len(t) + 1 for t in texts])
        hashes = self.spans(data, starts, ends)
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            hashes[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return hashes, np.searchsorted(starts, limits)


def hasher() -> TextHasher:
    state = worker_state()
    if "hasher" not in state:
        state["hasher"] = TextHasher()
    return state["hasher"]


def batches(texts: list[bytes]):
    """Consecutive (first, texts) of about BATCH_BYTES; afterwards, freed memory is given back."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_BYTES:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]
    trimmed()


def text_batches(column: pa.Array):
    """Consecutive (first, texts) of about BATCH_BYTES of a column of texts, null as empty; only one of them is copied at a time."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)) if len(column) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes + 1)
    first = 0
    while first < len(column):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
        yield first, column.slice(first, last - first).to_pylist()
        first = last
    trimmed()


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words; of the whole sequence if it is shorter, none without words."""
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    out = np.full(n - k + 1, k if k < width else 0, np.uint64)
    for j, factor in enumerate(stream(11, width)[:k]):
        out = (out ^ words[j : n - k + 1 + j]) * (factor | np.uint64(1))
        out ^= out >> np.uint64(29)
    return mixed(out)
