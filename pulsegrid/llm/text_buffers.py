"""Texts of Arrow columns as byte buffers, and a memo of what short pieces of them encode to.

Work on a piece of text (a word, a pre-token) is done once per distinct piece that a worker has not seen: pieces are
told apart by 64-bit hashes, which NumPy computes for all pieces of a buffer at once, and results are gathered by
index. Pieces longer than ``LONG`` bytes are compared as bytes and never remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pulsegrid.llm.hashing import segment_hashes

LONG = 48
#: Pieces a worker remembers before it starts afresh.
MEMO_PIECES = 1_500_000


def buffers(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, bounds) of consecutive texts, about ``most_bytes`` at a time and one text at least.

    Text i of a group is bytes[bounds[i]:bounds[i + 1]]; a null is empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, values = column.buffers()
    rows = len(column)
    if not rows:
        return
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most_bytes, side="right")) - 1)
        yield lo, hi, data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo]
        lo = hi


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


class PieceMemo:
    """What pieces encode to: unsigned 32-bit numbers, as many as the piece gives.

    ``encode`` takes distinct pieces and returns (numbers one after the other, how many each piece gave)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.entry = np.zeros(0, dtype=np.int64)
        self.values, self.first, self.count = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, first, count): piece i encodes to numbers[first[i]:first[i] + count[i]]."""
        first, count = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        is_long = ends - starts > LONG
        short = np.flatnonzero(~is_long)
        if len(short):
            if len(self.hashes) > MEMO_PIECES:
                self._forget()
            found = segment_hashes(data, starts[short], ends[short])
            names, at, inverse = np.unique(found, return_index=True, return_inverse=True)
            self._learn(data, names, starts[short[at]], ends[short[at]])
            entry = self.entry[np.searchsorted(self.hashes, names)][inverse]
            first[short], count[short] = self.first[entry], self.count[entry]
        if len(short) == len(starts):
            return self.values, first, count
        spans = np.flatnonzero(is_long)
        pieces = [data[a:b].tobytes() for a, b in zip(starts[spans].tolist(), ends[spans].tolist())]
        number = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        values, counts = self.encode(list(number))
        at = np.array([number[p] for p in pieces])
        first[spans], count[spans] = len(self.values) + (np.cumsum(counts) - counts)[at], counts[at]
        return np.concatenate([self.values, values]), first, count

    def _learn(self, data: np.ndarray, names: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        at = np.searchsorted(self.hashes, names)
        known = np.zeros(len(names), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == names[inside]
        new = np.flatnonzero(~known)
        if not len(new):
            return
        raw = data.tobytes()
        values, counts = self.encode([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        entries = len(self.count) + np.arange(len(new))
        self.first = np.concatenate([self.first, len(self.values) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.values = np.concatenate([self.values, values])
        self.hashes = np.insert(self.hashes, at[new], names[new])
        self.entry = np.insert(self.entry, at[new], entries)
