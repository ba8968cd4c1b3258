"""Ids of text parts, remembered for whole batches at once: found by 64-bit hash, then compared byte by byte."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .hashing import BATCH_BYTES, hasher

#: Parts, and bytes of them, that a worker remembers unless told otherwise; beyond that it starts afresh.
MEMO, MEMO_BYTES = 1_000_000, 1 << 26
STOP, PLAIN = np.zeros(256, bool), np.zeros(256, bool)
STOP[list(rb"""!"#$%&()*+,-./:;=?@[\]^_`{}~""")] = True  # without apostrophes, and what marks added tokens
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = True


def split_stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans cut before the run of symbols that ends them, where a letter or digit of ASCII is before it."""
    last = ends - 1
    stopped = np.flatnonzero(STOP[data[last]])
    if not len(stopped):
        return starts, ends
    # step back over the stops, all spans at once
    last, open_ = last[stopped], np.arange(len(stopped))
    while len(open_):
        last[open_] -= 1
        open_ = open_[(last[open_] >= starts[stopped[open_]]) & STOP[data[last[open_]]]]
    splits = last[(last >= starts[stopped]) & PLAIN[data[last]]] + 1
    return np.sort(np.concatenate([starts, splits])), np.sort(np.concatenate([ends, splits]))


class PartMemo:
    """learn: gives ids of some parts, and where and how many those of each part are.

    Hashes are kept sorted in plain arrays, at some 40 bytes a part with its own.
    """

    def __init__(self, kind: np.dtype, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = MEMO):
        self.kind, self.learn, self.most = kind, learn, most
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.lengths, self.offsets = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 18, self.kind), 0
        self.texts, self.written = np.zeros(1 << 18, np.uint8), 0
        self.text_at, self.text_size = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _keep(self, places: np.ndarray, parts: list[bytes]) -> None:
        text = np.frombuffer(b"".join(parts), np.uint8)
        if self.written + len(text) > len(self.texts):
            self.texts = np.concatenate([self.texts, np.zeros(max(len(text), len(self.texts) // 2), np.uint8)])
        self.texts[self.written : self.written + len(text)] = text
        sizes = np.array([len(p) for p in parts])
        self.text_at = np.insert(self.text_at, places, self.written + np.cumsum(sizes) - sizes)
        self.text_size = np.insert(self.text_size, places, sizes)
        self.written += len(text)

    def _are(self, at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Whether the remembered parts have the bytes of the spans."""
        sizes = ends - starts
        if not np.array_equal(self.text_size[at], sizes):
            return False
        placed = np.cumsum(sizes)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(placed, placed[i] - sizes[i] + BATCH_BYTES, side="right")))
            n, begin = sizes[i:j], placed[i:j] - sizes[i:j] - (placed[i] - sizes[i])
            steps = np.arange(int(n.sum()))
            if not np.array_equal(self.texts[steps + np.repeat(self.text_at[at[i:j]] - begin, n)], data[steps + np.repeat(starts[i:j] - begin, n)]):
                return False
            i = j
        return True

    def _add(self, keys: np.ndarray, places: np.ndarray, parts: list[bytes]) -> None:
        flat, offsets, sizes = self.learn(parts)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(flat), len(self.flat) // 2), self.kind)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.keys = np.insert(self.keys, places, keys)
        self.lengths = np.insert(self.lengths, places, sizes)
        self.offsets = np.insert(self.offsets, places, self.used + offsets)
        self.used += len(flat)
        self._keep(places, parts)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of data[start:end], in a row, and where those of each span end."""
        distinct, first, back = np.unique(hasher().spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most or self.written > MEMO_BYTES:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        if not known.all():
            raw, spans = data.tobytes(), first[~known]
            self._add(distinct[~known], at[~known], [raw[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)])
            at += np.cumsum(~known) - ~known
        at = at[back]
        if not self._are(at, data, starts, ends):
            return self._asked(data, starts, ends)
        return _gathered(self.flat, self.offsets[at], self.lengths[at])

    def _asked(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ids(), without the memory: two parts of this batch, or one and a remembered one, have one hash."""
        raw = data.tobytes()
        parts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        number = {p: i for i, p in enumerate(dict.fromkeys(parts))}
        flat, offsets, sizes = self.learn(list(number))
        at = np.array([number[p] for p in parts])
        return _gathered(flat, offsets[at], sizes[at])


def _gathered(flat: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat in a row, and where each ends."""
    placed = np.cumsum(sizes, dtype=np.int64)
    from_ = np.repeat(offsets - placed + sizes, sizes)
    from_ += np.arange(len(from_))
    return flat[from_], placed
