"""Batches of texts as ragged numpy arrays of chunks, and a bounded store of what was computed for a chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from millrace.llm.hashing import HashTable

SLICE_BYTES = 256 << 10  # text that is held as arrays at once
SHORT = 64               # chunks up to this many bytes are found again by their key
CACHE_BITS = 20          # slots for them; the store starts anew when half are taken
STORE_ENTRIES = 1 << 22  # values in the store, at most, before it starts anew
BASE = 0x2545F4914F6CDD1F


def ragged(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices offsets[i], offsets[i] + 1, ... of counts[i] entries each, behind each other."""
    return np.repeat(offsets - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Grown:
    """An array that is appended to."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.data):
            self.data = np.concatenate([self.data[:self.size], np.zeros(self.size + len(more), self.data.dtype)])
        self.data[self.size:self.size + len(more)] = more
        self.size += len(more)


class ChunkStore:
    """Subclasses cut texts into chunks (`bounds`) and compute values of new chunks (`encode_chunks`).

    A chunk must have the same values wherever it stands. `kinds` are the types of its lists of values. `bounds`
    gets the bytes of several texts, each followed by `separator`, and the places where they begin.
    """

    separator = b""

    def __init__(self, kinds: tuple):
        self.kinds = kinds
        self.powers = np.multiply.accumulate(np.concatenate([[1], np.full(SHORT, BASE)]).astype(np.uint64))
        # Random odd 64-bit values for bytes and lengths: keys of two short chunks agree by chance only.
        self.byte_value = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.clear()

    def clear(self) -> None:
        self.table = HashTable(CACHE_BITS)
        self._offsets = [Grown(np.int64) for _ in self.kinds]
        self._counts = [Grown(np.int64) for _ in self.kinds]
        self._values = [Grown(k) for k in self.kinds]
        self._view()

    def _view(self) -> None:
        self.offsets, self.counts, self.values = ([g.data for g in x] for x in (self._offsets, self._counts, self._values))

    def bounds(self, data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def encode_chunks(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        raise NotImplementedError

    def keys(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """A 64-bit key of each chunk; chunks of one length are taken together, byte by byte."""
        out = np.zeros(len(starts), np.uint64)
        by_len = np.argsort(lens, kind="stable")
        cut = np.searchsorted(lens[by_len], np.arange(SHORT + 2))
        for n in range(1, SHORT + 1):
            group = by_len[cut[n]:cut[n + 1]]
            if len(group):
                at = starts[group]
                acc = np.zeros(len(group), np.uint64)
                for k in range(n):
                    acc += self.byte_value[data[at + k]] * self.powers[k]
                out[group] = acc + self.byte_value[n:n + 1] * self.powers[SHORT]
        return out

    def rows_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The store row of each chunk, after entering the new ones."""
        lens = ends - starts
        short, long_ = np.flatnonzero(lens <= SHORT), np.flatnonzero(lens > SHORT)
        keys = self.keys(data, starts[short], lens[short])
        if not self.table.room(len(short)) or self._values[0].size > STORE_ENTRIES:
            self.clear()
        rows = np.full(len(starts), -1, np.int64)
        rows[short] = self.table.get(keys)
        new = short[rows[short] < 0]
        fresh, first, back = np.unique(keys[rows[short] < 0], return_index=True, return_inverse=True)
        at = np.concatenate([new[first], long_])
        if len(at):
            raw = data.tobytes()
            parts = self.encode_chunks([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            base = self._counts[0].size
            for (values, counts), offsets, had, store in zip(parts, self._offsets, self._counts, self._values):
                offsets.add(store.size + np.cumsum(counts) - counts)
                had.add(counts)
                store.add(values)
            self._view()
            self.table.put(fresh, base + np.arange(len(fresh)))
            rows[new] = base + back
            rows[long_] = base + len(fresh) + np.arange(len(long_))
        return rows

    def slices(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the texts: text number and store row of each chunk, in order.

        A text longer than a slice is cut before a space that follows a printable ASCII character.
        """
        batch: list[bytes] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            begin = 0
            while begin < len(text):
                end = len(text)
                if end - begin > SLICE_BYTES:
                    end = self._cut(text, begin)
                batch.append(text[begin:end])
                owners.append(i)
                size += end - begin
                begin = end
                if size >= SLICE_BYTES:
                    yield self._slice(batch, owners)
                    batch, owners, size = [], [], 0
        if batch:
            yield self._slice(batch, owners)

    @staticmethod
    def _cut(text: bytes, begin: int) -> int:
        at = begin + SLICE_BYTES
        while (at := text.find(b" ", at)) > 0:
            if 32 < text[at - 1] < 127:
                return at
            at += 1
        return len(text)

    def _slice(self, batch: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, batch), np.int64, len(batch)) + len(self.separator)
        data = np.frombuffer(self.separator.join(batch) + self.separator, np.uint8)
        stops = np.cumsum(lens)
        starts, ends = self.bounds(data, stops - lens)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.searchsorted(stops, starts, side="right")
        return np.asarray(owners, np.int64)[owner], self.rows_of(data, starts, ends)

    def joined(self, texts: list[bytes]) -> list[list[np.ndarray]]:
        """For each kind of values: those of each text's chunks behind each other."""
        out: list[list[list[np.ndarray]]] = [[[] for _ in texts] for _ in self.kinds]
        for owner, rows in self.slices(texts):
            if not len(owner):
                continue
            last = np.flatnonzero(np.diff(owner, append=-1))
            for k, into in enumerate(out):
                counts = self.counts[k][rows]
                values = self.values[k][ragged(self.offsets[k][rows], counts)]
                for i, part in zip(owner[last].tolist(), np.split(values, np.cumsum(counts)[last][:-1])):
                    into[i].append(part)
        return [[p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, kind) for p in into]
                for into, kind in zip(out, self.kinds)]
